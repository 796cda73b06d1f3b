"""Selection: head, decimation, routing of several streams, and the triggered acquisition modes of a sink."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def head(samples: DataFrame, n: int) -> DataFrame:
    """The first n samples of each stream, by index: a filter that reaches the scan."""
    return samples.filter(F.col("idx") < n)


def decimate(samples: DataFrame, factor: int, keep_rest: bool = False) -> DataFrame:
    """Every factor-th sample, from the first; one whose chunk is not whole is dropped unless keep_rest."""
    out = samples
    if not keep_rest and factor > 1:
        ends = samples.groupBy("stream_id").agg((F.max("idx") + 1).alias("_n"))
        out = samples.filter(F.col("idx") % factor == 0).join(ends, "stream_id").filter(F.expr(f"idx < _n div {factor} * {factor}")).drop("_n")
    return out.filter(F.col("idx") % factor == 0).withColumn("idx", F.expr(f"idx div {factor}"))


def selector(ports: Sequence[DataFrame], routes: Sequence[tuple[int, int]], interleave: bool = True) -> dict[int, DataFrame]:
    """Routes inputs to outputs. Inputs that share an output alternate, sample by sample, up to the shortest of them; or
    follow each other as wholes where interleave is off."""
    if len(set(routes)) != len(routes):
        raise ValueError("a route is given twice")
    out: dict[int, DataFrame] = {}
    for port in sorted({o for _, o in routes}):
        inputs = [ports[i] for i, o in routes if o == port]
        k = len(inputs)
        if k == 1:
            out[port] = inputs[0]
            continue
        tagged = reduce(DataFrame.unionByName, [s.withColumn("_place", F.lit(i)) for i, s in enumerate(inputs)])
        sizes = tagged.groupBy("stream_id", "_place").agg((F.max("idx") + 1).alias("_n"))
        if interleave:
            least = sizes.groupBy("stream_id").agg(F.min("_n").alias("_least"), F.count("*").alias("_ports"))
            rows = tagged.join(least.filter(F.col("_ports") == k), "stream_id").filter("idx < _least").withColumn("idx", F.col("idx") * k + F.col("_place")).drop("_least", "_ports")
        else:
            before = Window.partitionBy("stream_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
            starts = sizes.select("stream_id", "_place", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
            rows = tagged.join(starts, ["stream_id", "_place"]).withColumn("idx", F.col("idx") + F.col("_start")).drop("_start")
        out[port] = rows.drop("_place")
    return out


def triggered(samples: DataFrame, triggers: DataFrame, before: int, after: int, block: int = 4096) -> DataFrame:
    """For each trigger (stream_id, idx) the samples from before ones ahead of it to after ones from it on, as (seg, pos): ranges may overlap.

    Trigger ranges and samples meet in an equi-join on blocks of idx, not in a range join.
    """
    span = triggers.select("stream_id", F.col("idx").alias("_at")).distinct()
    blocks = F.sequence(F.expr(f"greatest(_at - {before}, 0) div {block}"), F.expr(f"greatest(_at + {after} - 1, 0) div {block}"))
    span = span.withColumn("_block", F.explode(blocks))
    met = samples.withColumn("_block", F.expr(f"idx div {block}")).join(span, ["stream_id", "_block"])
    met = met.filter((F.col("idx") >= F.col("_at") - before) & (F.col("idx") < F.col("_at") + after))
    return met.withColumn("seg", F.col("_at")).withColumn("pos", F.col("idx") - F.greatest(F.col("_at") - before, F.lit(0))).drop("_at", "_block")


def multiplexed(samples: DataFrame, start: Column, stop: Column, most: int = 0) -> DataFrame:
    """A start opens a range, a stop or the next start closes it; at most `most` samples of each (0: all)."""
    from sampleweave.model import carried

    rows = samples.withColumn("_mark", F.when(start, F.col("idx")).when(stop, F.lit(-1)))
    rows = carried(rows, F.col("_mark"), "seg").filter("seg >= 0").drop("_mark")
    rows = rows.withColumn("pos", F.col("idx") - F.col("seg"))
    return rows.filter(F.col("pos") < most) if most else rows


def snapshot(samples: DataFrame, triggers: DataFrame, delay: int) -> DataFrame:
    """The sample `delay` samples after each trigger."""
    at = triggers.select("stream_id", F.col("idx").alias("trigger_idx"), (F.col("idx") + delay).alias("idx"))
    return samples.join(at, ["stream_id", "idx"])


def stopped(ports: Sequence[DataFrame], limits: Sequence[int | None]) -> list[DataFrame]:
    """Ports of one block, of which some ask to stop after a number of samples (None: never): all end with the first to stop."""
    given = [n for n in limits if n is not None]
    return [head(p, min(given)) if given else p for p in ports]
