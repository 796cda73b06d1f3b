"""Tags as maps: lookup, merge, the keys that propagate, and how tags move through operators that change the rate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleweave.model import TAG_PREFIX


def get(tag: Column, key: str) -> Column:
    """A canonical key with its prefix, or else bare."""
    return F.coalesce(F.element_at(tag, F.lit(TAG_PREFIX + key)), F.element_at(tag, F.lit(key)))


def put(tag: Column, key: str, value: Column) -> Column:
    return merged(tag, F.create_map(F.lit(key), value))


def merged(tag: Column, other: Column) -> Column:
    """Both maps; where they share a key the other's value stands."""
    return F.map_concat(F.map_filter(tag, lambda k, v: ~F.map_contains_key(other, k)), other)


def propagating(tag: Column, supplement: Sequence[str] = ()) -> Column:
    return F.map_filter(tag, lambda k, v: k.startswith(TAG_PREFIX) | k.isin(*supplement) if supplement else k.startswith(TAG_PREFIX))


def moved(tags: DataFrame, policy: str, size: int, made: int = 1, supplement: Sequence[str] = ()) -> DataFrame:
    """tags (stream_id, idx, seq, tag) behind an operator that makes `made` samples of every `size`.

    default and Backward: at the start of their chunk's output; Forward: at the start of the next chunk's unless at the
    start of one; Merge: one map per chunk, the last value of a key stands; None: dropped.
    """
    if policy == "None":
        return tags.limit(0)
    kept = tags.withColumn("tag", propagating(F.col("tag"), supplement)).filter(F.size("tag") > 0)
    if policy == "Forward":
        return kept.withColumn("idx", F.expr(f"(idx + {size} - 1) div {size} * {made}"))
    place = F.expr(f"idx div {size} * {made}")
    if policy != "Merge":
        return kept.withColumn("idx", place)
    flat = kept.select("stream_id", place.alias("out"), "idx", "seq", F.explode("tag").alias("key", "value"))
    last = flat.groupBy("stream_id", "out", "key").agg(F.max_by("value", F.struct("idx", "seq")).alias("value"))
    return last.groupBy("stream_id", F.col("out").alias("idx")).agg(F.lit(0).alias("seq"), F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("tag"))


def once(ports: Sequence[DataFrame]) -> DataFrame:
    """The tags of several inputs, each different one once per sample."""
    out = ports[0]
    for p in ports[1:]:
        out = out.unionByName(p)
    flat = out.withColumn("_same", F.array_sort(F.map_entries("tag")))
    return flat.groupBy("stream_id", "idx", "_same").agg(F.min("seq").alias("seq"), F.first("tag").alias("tag")).drop("_same")
