"""Electrical power: metrics of sampled voltage and current, power factor, unbalance between phases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleweave.operators.design import iir_design
from sampleweave.operators.recursive import iir


def power_factor(p: Column, s: Column) -> tuple[Column, Column]:
    """P / S within -1 and 1 (0 where S is 0), and its angle."""
    factor = F.when(s == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p / F.nullif(s, F.lit(0.0)))))
    return factor, F.acos(factor)


def unbalance(phases: Sequence[Column]) -> Column:
    """The greatest deviation from the mean in percent of it; 0 unless the mean is above 0."""
    mean = reduce(lambda a, b: a + b, phases) / len(phases)
    return F.when(mean > 0, 100 * F.greatest(*(F.abs(p - mean) for p in phases)) / F.nullif(mean, F.lit(0.0))).otherwise(0.0)


def power_metrics(samples: DataFrame, sample_rate: float = 10_000.0, high_pass: float = 2.0, low_pass: float = 90.0, decimate: int = 100) -> DataFrame:
    """Of one phase per stream (stream_id, idx, u, i): every decimate-th P, Q, S, u_rms, i_rms after the removal of offsets.

    Five parallel recursions per stream over its blocks; the last step is an expression.
    """
    high = iir_design("HIGHPASS", 2, high_pass, sample_rate / 4, sample_rate)
    low = iir_design("LOWPASS", 2, low_pass, sample_rate / 4, sample_rate)
    ac = [iir(samples.select("stream_id", "idx", F.col(c).alias("value")), *high).withColumnRenamed("value", c) for c in ("u", "i")]
    both = ac[0].join(ac[1], ["stream_id", "idx"])
    products = {"p": F.col("u") * F.col("i"), "u2": F.col("u") * F.col("u"), "i2": F.col("i") * F.col("i")}
    smooth = [iir(both.select("stream_id", "idx", e.alias("value")), *low).filter(F.col("idx") % decimate == 0).withColumnRenamed("value", n) for n, e in products.items()]
    rows = reduce(lambda a, b: a.join(b, ["stream_id", "idx"]), smooth)
    u, i = F.sqrt(F.greatest("u2", F.lit(0.0))), F.sqrt(F.greatest("i2", F.lit(0.0)))
    s = u * i
    q = F.sqrt(F.greatest(s * s - F.col("p") * F.col("p"), F.lit(0.0)))
    return rows.select("stream_id", F.expr(f"idx div {decimate}").alias("idx"), F.col("p").alias("P"), q.alias("Q"), s.alias("S"), u.alias("u_rms"), i.alias("i_rms"))


def system_unbalance(rows: DataFrame, voltages: Sequence[str], currents: Sequence[str], powers: Sequence[str]) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.col(p) for p in powers])
    return rows.select("stream_id", "idx", total.alias("total_active_power"), unbalance([F.col(v) for v in voltages]).alias("voltage_unbalance"), unbalance([F.col(c) for c in currents]).alias("current_unbalance"))
