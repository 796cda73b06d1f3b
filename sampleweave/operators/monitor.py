"""What passes a point of a stream: counts, tags and changes of settings as tables, and the delivery of data sets that are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counted(samples: DataFrame) -> DataFrame:
    """Of each stream the number of samples, and its first and last index: a sink that only counts."""
    return samples.groupBy("stream_id").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def tag_monitor(tags: DataFrame) -> DataFrame:
    """Tags (stream_id, idx, name, seq) as they were seen: each one's number among those of its name, and the samples since the last of them."""
    w = Window.partitionBy("stream_id", "name").orderBy("idx", "seq")
    return tags.withColumn("nth", F.row_number().over(w).cast("long")).withColumn("apart", F.col("idx") - F.lag("idx").over(w))


def settings_changes(samples: DataFrame, names: list[str]) -> DataFrame:
    """Records (stream_id, idx, name, before, after) of the settings, columns of samples, that differ from the sample before; at a stream's first sample before is null."""
    w = Window.partitionBy("stream_id").orderBy("idx")
    pairs = samples.select("stream_id", "idx", F.row_number().over(w).alias("_n"), *(F.struct(F.lit(c).alias("name"), F.lag(c).over(w).cast("double").alias("before"), F.col(c).cast("double").alias("after")).alias(c) for c in names))
    rows = pairs.select("stream_id", "idx", "_n", F.explode(F.array(*names)).alias("r")).select("stream_id", "idx", "_n", "r.*")
    return rows.filter((F.col("_n") == 1) | ~F.col("before").eqNullSafe(F.col("after"))).drop("_n")


def delivered(sets: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame]:
    """Data sets (ds, axis, values) that a listener asked for, and for the others the number and the samples that went by."""
    rest = sets.filter(~F.coalesce(wanted, F.lit(False)))
    return sets.filter(wanted), rest.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("values")), F.lit(0)).cast("long").alias("n_samples"))


def tag_sink(samples: DataFrame, tags: DataFrame, expected: int | None = None) -> DataFrame:
    """What reached the end of each stream: n, n_tags, its first and last tag's index, and whether n is the number expected (null: none asked for)."""
    seen = tags.groupBy("stream_id").agg(F.count("*").alias("n_tags"), F.min("idx").alias("first_tag"), F.max("idx").alias("last_tag"))
    whole = samples.groupBy("stream_id").agg(F.count("*").alias("n")).join(seen, "stream_id", "left")
    right = F.col("n") == expected if expected is not None else F.lit(None).cast("boolean")
    return whole.select("stream_id", "n", F.coalesce("n_tags", F.lit(0)).cast("long").alias("n_tags"), "first_tag", "last_tag", right.alias("complete"))


def expected(samples: DataFrame) -> DataFrame:
    """The last value and the number of samples of each stream."""
    return samples.groupBy("stream_id").agg(F.max_by("value", "idx").alias("last_value"), F.count("*").alias("n"))


def vectors(samples: DataFrame, size: int) -> DataFrame:
    """Samples as arrays of a stated size (the last one of a stream may be shorter): stream_id, part, values."""
    lists = samples.groupBy("stream_id", F.expr(f"idx div {size}").alias("part")).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_x"))
    return lists.select("stream_id", "part", F.transform("_x", lambda s: s["value"]).alias("values"))
