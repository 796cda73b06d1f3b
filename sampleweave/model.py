"""The data model: ordered samples (stream_id, idx, value), tags (stream_id, idx, name, context, time, ...), data sets.

Long streams are cut into blocks of idx, so that one stream never has to fit one task: finite windows see a halo of the
neighbouring blocks, and running values carry one summary row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 16  #: samples of a stream that one window partition holds, without its halo

SAMPLES = T.StructType([T.StructField("stream_id", T.StringType()), T.StructField("idx", T.LongType()), T.StructField("value", T.DoubleType())])
#: The canonical tag keys and their prefix.
TAG_PREFIX = "gr:"
TAG_KEYS = ["sample_rate", "frequency", "signal_name", "num_channels", "signal_quantity", "signal_unit", "signal_min", "signal_max", "n_dropped_samples", "rx_overflow", "trigger_name", "trigger_time", "trigger_time_error", "trigger_offset", "trigger_meta_info", "user_data", "context", "ctx_time", "local_time", "reset_default", "store_default", "end_of_stream"]
DATASET = "struct<timestamp:bigint,axis_names:array<string>,axis_units:array<string>,axis_values:array<array<double>>,extents:array<int>,layout:string,signal_names:array<string>,signal_quantities:array<string>,signal_units:array<string>,signal_values:array<double>,signal_ranges:array<struct<min:double,max:double>>,meta:array<map<string,string>>,timing_events:array<array<struct<idx:bigint,tag:map<string,string>>>>>"


def with_index(df: DataFrame, stream: str | Column, order: Sequence[str | Column], bucket: Column | None = None) -> DataFrame:
    """df with stream_id and idx, the place in its stream from 0. The order must be total for the index to be defined.

    A stream is sorted in one task, unless bucket is given: a column that never falls along the order (such as the day of
    its time). Then every bucket of a stream is sorted by itself and starts at the sum of the counts before it.
    """
    made = df.withColumn("stream_id", F.col(stream) if isinstance(stream, str) else stream)
    if bucket is None:
        return made.withColumn("idx", (F.row_number().over(Window.partitionBy("stream_id").orderBy(*order)) - 1).cast("long"))
    made = made.withColumn("_bucket", bucket)
    earlier = Window.partitionBy("stream_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = made.groupBy("stream_id", "_bucket").agg(F.count("*").alias("_n")).select("stream_id", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("stream_id", "_bucket").orderBy(*order)) - 1
    return made.withColumn("_place", place).join(starts, ["stream_id", "_bucket"]).withColumn("idx", F.col("_start") + F.col("_place")).drop("_bucket", "_place", "_start", "_n")


def in_order() -> WindowSpec:
    return Window.partitionBy("stream_id").orderBy("idx")


def blocked(samples: DataFrame, before: int, after: int, compute: Callable[[DataFrame, WindowSpec], DataFrame], block: int = BLOCK) -> DataFrame:
    """compute(rows, window) over blocks with a halo of before and after samples; the halo's own rows are dropped.

    A sample goes to its block and to those whose halo it is in, so a window frame within the halo is whole at every row.
    """
    block = max(block, before + after + 1)
    home = F.expr(f"idx div {block}")
    copies = F.array(home, F.expr(f"(idx + {before}) div {block}"), F.when(F.col("idx") >= after, F.expr(f"(idx - {after}) div {block}")).otherwise(F.lit(0).cast("long")))
    rows = samples.withColumn("_block", F.explode(F.array_distinct(copies))) if before or after else samples.withColumn("_block", home)
    made = compute(rows, Window.partitionBy("stream_id", "_block").orderBy("idx"))
    return made.filter(F.col("_block") == home).drop("_block")


def carried(samples: DataFrame, marker: Column, name: str, first: Column | None = None, block: int = BLOCK) -> DataFrame:
    """samples with the last marker other than null at or before each of them (a forward fill), in parallel within a stream.

    Each block fills by itself; what it starts with comes from the last markers of the blocks before, one row per block.
    """
    rows = samples.withColumn("_block", F.expr(f"idx div {block}")).withColumn("_marker", marker)
    w = Window.partitionBy("stream_id", "_block").orderBy("idx")
    filled = rows.withColumn("_own", F.last("_marker", ignorenulls=True).over(w))
    ends = rows.groupBy("stream_id", "_block").agg(F.max_by("_marker", F.when(F.col("_marker").isNotNull(), F.col("idx"))).alias("_end"))
    earlier = Window.partitionBy("stream_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("stream_id", "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    value = F.coalesce("_own", "_before") if first is None else F.coalesce("_own", "_before", first)
    return filled.join(ends, ["stream_id", "_block"]).withColumn(name, value).drop("_block", "_marker", "_own", "_before")


def running_sum(samples: DataFrame, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """samples with the sum of value up to and with each of them, in parallel within a stream."""
    rows = samples.withColumn("_block", F.expr(f"idx div {block}")).withColumn("_add", value)
    w = Window.partitionBy("stream_id", "_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("stream_id", "_block").agg(F.sum("_add").alias("_total"))
    earlier = Window.partitionBy("stream_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("stream_id", "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    return rows.withColumn("_own", F.sum("_add").over(w)).join(totals, ["stream_id", "_block"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_block", "_add", "_own", "_before")
