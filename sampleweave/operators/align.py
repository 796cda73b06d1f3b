"""Alignment of several streams and of data sets: by index, by tolerance of tag times, as of a time, along an axis."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleweave.functions.scalars import MATH, linear_interpolate
from sampleweave.model import carried

PIECE = 256  #: samples of a port that meet the segments of one block


def sync_ports(streams: Sequence[DataFrame]) -> DataFrame:
    """Sample k of every stream side by side (v0, v1, ...), as far as the shortest goes."""
    named = [s.select("stream_id", "idx", F.col("value").alias(f"v{i}")) for i, s in enumerate(streams)]
    return reduce(lambda a, b: a.join(b, ["stream_id", "idx"]), named)


def attach_tags(samples: DataFrame, tags: DataFrame) -> DataFrame:
    """Samples with the list of their tags (null for none)."""
    other = [c for c in tags.columns if c not in ("stream_id", "idx")]
    lists = tags.groupBy("stream_id", "idx").agg(F.array_sort(F.collect_list(F.struct(*other))).alias("tags"))
    return samples.join(lists, ["stream_id", "idx"], "left")


def as_of(rows: DataFrame, presets: DataFrame, key: str, time: str, value: str, valid_from: str = "valid_from", bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows with the value of their key's last preset that began at or before their time.

    A union and a forward fill in place of a range join. A key is filled in one task, unless bucket is given: a function of
    the time that never falls as it grows (such as its month). Then a task fills a bucket of a key, which starts with the
    last preset of the buckets before it, one row for each bucket.
    """
    side = presets.select(F.col(key).alias("_k"), F.col(valid_from).alias("_t"), F.struct(F.col(value).alias("v")).alias("_preset"), F.lit(0).alias("_order"), F.lit(None).cast(rows.schema.simpleString()).alias("_row"))
    main = rows.select(F.col(key).alias("_k"), F.col(time).alias("_t"), F.lit(None).cast(side.schema["_preset"].dataType.simpleString()).alias("_preset"), F.lit(1).alias("_order"), F.struct(*rows.columns).alias("_row"))
    both = side.union(main).withColumn("_b", bucket(F.col("_t")) if bucket else F.lit(0))
    w = Window.partitionBy("_k", "_b").orderBy("_t", "_order").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_found", F.last("_preset", ignorenulls=True).over(w)).filter("_order = 1")
    if bucket:
        ends = side.withColumn("_b", bucket(F.col("_t"))).groupBy("_k", "_b").agg(F.max_by("_preset", "_t").alias("_end"))
        held = both.select("_k", "_b").distinct().join(ends, ["_k", "_b"], "left")
        earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        held = held.select("_k", "_b", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
        filled = filled.join(held, ["_k", "_b"]).withColumn("_found", F.coalesce("_found", "_before"))
    return filled.select("_row.*", F.col("_found.v").alias(value))


def matched_tags(tags: DataFrame, ports: int, tolerance: int) -> DataFrame:
    """Groups of sync tags, one of each port, of one name and with all times within tolerance of a candidate time.

    tags: stream_id, port, idx, name, time. A tag meets the candidates of its own and the neighbouring bins of time, in
    an equi-join. A group is the candidate of a port's tag that finds every port; the earliest candidate of a tag stands.
    """
    width = max(1, tolerance)
    near = tags.select("stream_id", "port", "idx", "name", "time", F.explode(F.array(*(F.expr(f"time div {width} + ({d})") for d in (-1, 0, 1)))).alias("_bin"))
    candidates = tags.select("stream_id", "name", F.col("time").alias("_at"), F.expr(f"time div {width}").alias("_bin")).distinct()
    met = near.join(candidates, ["stream_id", "name", "_bin"]).filter(F.abs(F.col("time") - F.col("_at")) < tolerance)
    best = met.groupBy("stream_id", "name", "_at", "port").agg(F.min_by(F.struct("idx", "time"), F.struct(F.abs(F.col("time") - F.col("_at")), "idx")).alias("_hit"))
    whole = best.groupBy("stream_id", "name", "_at").agg(F.count("*").alias("_n"), F.map_from_entries(F.collect_list(F.struct("port", "_hit.idx"))).alias("at")).filter(F.col("_n") == ports)
    once = whole.groupBy("stream_id", "name", F.array_sort(F.map_values("at")).alias("_same")).agg(F.min("_at").alias("time"), F.min_by("at", "_at").alias("at"))
    return once.select("stream_id", "name", "time", "at")


def sync_block(samples: DataFrame, tags: DataFrame, ports: int, tolerance: int = 5) -> tuple[DataFrame, DataFrame]:
    """Aligns ports on their sync tags. samples: stream_id, port, idx, value; tags: stream_id, port, idx, name, time.

    Every port, whose idx has no gap, is cut at its matched tags. Before the first the last common samples stay, between two the first common
    ones, after the last the first common ones. Returns the aligned samples, by a common idx, and each port's drops:
    the index of its first kept sample after a gap and the number of samples dropped there.
    """
    groups = matched_tags(tags, ports, tolerance)
    cuts = groups.withColumn("_seg", F.row_number().over(Window.partitionBy("stream_id").orderBy("time")))
    cut = cuts.select("stream_id", "_seg", F.explode("at").alias("port", "_from"))
    sizes = samples.groupBy("stream_id", "port").agg(F.min("idx").alias("_lead"), (F.max("idx") + 1).alias("_end"))
    lead = F.struct(F.lit(0).alias("seg"), F.col("_lead").alias("first"))
    own = F.struct(F.col("_seg").alias("seg"), F.col("_from").alias("first"))
    cut = cut.join(sizes, ["stream_id", "port"]).withColumn("_s", F.explode(F.when(F.col("_seg") == 1, F.array(lead, own)).otherwise(F.array(own))))
    of_port, of_segment = Window.partitionBy("stream_id", "port").orderBy("_seg"), Window.partitionBy("stream_id", "_seg")
    plan = cut.select("stream_id", "port", F.col("_s.seg").alias("_seg"), F.col("_s.first").alias("_first"), "_end")
    plan = plan.withColumn("_n", F.greatest(F.lit(0), F.lead("_first").over(of_port).isNull().cast("int") * F.col("_end") + F.coalesce(F.lead("_first").over(of_port), F.lit(0)) - F.col("_first")))
    # a port without a sample has no segment and leaves nothing to align
    plan = plan.withColumn("_kept", F.when(F.count("*").over(of_segment) == ports, F.min("_n").over(of_segment)).otherwise(0))
    plan = plan.withColumn("_start", F.coalesce(F.sum("_kept").over(of_port.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    begin = F.col("_first") + F.when(F.col("_seg") == 0, F.col("_n") - F.col("_kept")).otherwise(0)
    # samples meet their segment in an equi-join on short blocks of idx: no more candidates than a block has samples
    pieces = plan.filter("_kept > 0").select("stream_id", "port", begin.alias("_begin"), "_kept", "_start")
    pieces = pieces.withColumn("_block", F.explode(F.expr(f"sequence(_begin div {PIECE}, (_begin + _kept - 1) div {PIECE})")))
    out = samples.withColumn("_block", F.expr(f"idx div {PIECE}")).join(pieces, ["stream_id", "port", "_block"])
    place = F.col("idx") - F.col("_begin")
    aligned = out.filter((place >= 0) & (place < F.col("_kept"))).select("stream_id", "port", (F.col("_start") + place).cast("long").alias("idx"), "value")
    lost = plan.withColumn("_lost", F.col("_n") - F.col("_kept")).withColumn("_last", F.max("_seg").over(Window.partitionBy("stream_id")))
    # a gap shows at the first sample after it: the start for the lead, the next sync sample for the others; what follows the last tag is open
    where = F.when(F.col("_seg") == 0, F.lit(0)).otherwise(F.col("_start") + F.col("_kept"))
    drops = lost.filter("_lost > 0 and (_seg = 0 or _seg < _last)").select("stream_id", "port", where.cast("long").alias("idx"), F.col("_lost").cast("long").alias("n_dropped_samples"))
    return aligned, drops


def dataset_operation(first: DataFrame, second: DataFrame, op: str) -> DataFrame:
    """op over two data sets given as rows (ds, x, y): at equal x by an equi-join, elsewhere with the second's y
    interpolated at the first's x (its end values beyond its axis)."""
    pairs = second.withColumn("_x1", F.lead("x").over(Window.partitionBy("ds").orderBy("x"))).withColumn("_y1", F.lead("y").over(Window.partitionBy("ds").orderBy("x")))
    marks = pairs.select("ds", F.col("x").alias("t"), F.struct("x", "y", "_x1", "_y1").alias("_pair"), F.lit(0).alias("_order"), F.lit(None).cast("double").alias("y"))
    asked = first.select("ds", F.col("x").alias("t"), F.lit(None).cast(marks.schema["_pair"].dataType.simpleString()).alias("_pair"), F.lit(1).alias("_order"), "y")
    w = Window.partitionBy("ds").orderBy("t", "_order")
    both = marks.union(asked)
    both = both.withColumn("_at", F.last("_pair", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("_next", F.first("_pair", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).filter("_order = 1")
    y2 = F.when(F.col("_at").isNull(), F.col("_next.y")).when(F.col("_at._x1").isNull() | (F.col("_at.x") == F.col("t")), F.col("_at.y")).otherwise(linear_interpolate(F.col("_at.x"), F.col("_at._x1"), F.col("_at.y"), F.col("_at._y1"), F.col("t")))
    return both.select("ds", F.col("t").alias("x"), MATH[op](F.col("y"), y2).alias("y"))


def merge_datasets(rows: DataFrame, strict: bool = True) -> DataFrame:
    """Stacks one-signal data sets (group, name, axis, values) of each group, in order of name. Axes that differ are an
    error; with strict off every signal keeps its own values, and the axis is that of the first."""
    axis = F.min_by("axis", F.struct("name"))
    if strict:
        axis = F.when(F.size(F.collect_set("axis")) == 1, F.first("axis")).otherwise(F.raise_error(F.lit("the axes of data sets to merge differ")).cast("array<double>"))
    return rows.groupBy("group").agg(axis.alias("axis"), F.array_sort(F.collect_list(F.struct("name", "values"))).alias("signals"))


def drop_history(samples: DataFrame, most: int) -> DataFrame:
    """The last `most` samples of each stream and port: what a bounded history keeps while nothing is in sync."""
    keys = [c for c in ("stream_id", "port") if c in samples.columns]
    ends = samples.groupBy(*keys).agg(F.max("idx").alias("_last"))
    return samples.join(ends, keys).filter(F.col("idx") > F.col("_last") - most).drop("_last")


def apply_settings(samples: DataFrame, settings: DataFrame, name: str, default: float) -> DataFrame:
    """Samples with a setting that tags change mid-stream: settings (stream_id, idx, value) hold from their sample on."""
    joined = samples.join(settings.select("stream_id", "idx", F.col("value").alias("_set")), ["stream_id", "idx"], "left")
    return carried(joined, F.col("_set"), name, F.lit(default)).drop("_set")



def async_ports(streams: Sequence[DataFrame]) -> DataFrame:
    """Ports that do not wait for one another: stream_id, port, idx, value, each port's samples under its own idx, however many there are."""
    named = [s.select("stream_id", F.lit(i).alias("port"), "idx", "value") for i, s in enumerate(streams)]
    return reduce(DataFrame.unionByName, named)
