"""Finite-memory operators: FIR filters, moving statistics, derivative, chunks and strides, Savitzky-Golay.

Windows run over blocks of a stream with a halo, so one long stream spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleweave.model import BLOCK, blocked


def fir(samples: DataFrame, taps: Sequence[float], block: int = BLOCK) -> DataFrame:
    """y[n] = sum of taps[k] * x[n - k]; samples before the first are zero."""

    def compute(rows: DataFrame, w) -> DataFrame:
        if len(taps) <= 16:
            terms = [F.lit(float(b)) * F.coalesce(F.lag("value", k).over(w) if k else F.col("value"), F.lit(0.0)) for k, b in enumerate(taps)]
            out = terms[0]
            for t in terms[1:]:
                out = out + t
            return rows.withColumn("_y", out)
        recent = F.collect_list("value").over(w.rowsBetween(-(len(taps) - 1), 0))
        weights = F.array(*(F.lit(float(b)) for b in taps))
        return rows.withColumn("_y", F.aggregate(F.zip_with(F.reverse(recent), weights, lambda x, b: F.coalesce(x, F.lit(0.0)) * b), F.lit(0.0), lambda s, x: s + x))

    return blocked(samples, len(taps) - 1, 0, compute, block).withColumn("value", F.col("_y")).drop("_y")


def moving(samples: DataFrame, statistic: str, size: int, block: int = BLOCK) -> DataFrame:
    """mean, median, rms (the deviation of the population), ptp (peak to peak) over size // 2 samples on both sides, fewer at the ends."""
    half = size // 2

    def compute(rows: DataFrame, w) -> DataFrame:
        frame = w.rowsBetween(-half, half)
        value = {
            "mean": lambda: F.avg("value").over(frame),
            "median": lambda: F.percentile("value", 0.5).over(frame),
            "rms": lambda: F.stddev_pop("value").over(frame),
            "ptp": lambda: F.max("value").over(frame) - F.min("value").over(frame),
        }[statistic]()
        return rows.withColumn("_y", value)

    return blocked(samples, half, half, compute, block).withColumn("value", F.col("_y")).drop("_y")


def derivative(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """x[i] - x[i - 1]; one sample fewer, and the index counts from 0 again."""
    made = blocked(samples, 1, 0, lambda rows, w: rows.withColumn("_y", F.col("value") - F.lag("value").over(w)), block)
    return made.filter("idx > 0").select("stream_id", (F.col("idx") - 1).alias("idx"), F.col("_y").alias("value"))


def strided(samples: DataFrame, size: int, stride: int = 0, keep_rest: bool = False) -> DataFrame:
    """Every sample with the windows that hold it: win, pos. stride 0 or size: back to back; less: overlapping; more: with gaps.

    Windows that the end cuts short are dropped unless keep_rest.
    """
    stride = stride or size
    rows = samples
    if stride >= size:
        rows = rows.filter(F.col("idx") % stride < size).withColumn("win", F.expr(f"idx div {stride}"))
    else:
        first = F.greatest(F.lit(0), F.expr(f"(idx - {size} + {stride}) div {stride}"))
        rows = rows.withColumn("win", F.explode(F.sequence(F.when(F.col("idx") < size, F.lit(0)).otherwise(first).cast("long"), F.expr(f"idx div {stride}"))))
    rows = rows.withColumn("pos", F.col("idx") - F.col("win") * stride).filter(F.col("pos") < size)
    if keep_rest:
        return rows
    ends = samples.groupBy("stream_id").agg((F.max("idx") + 1).alias("_n"))
    return rows.join(ends, "stream_id").filter(F.col("win") * stride + size <= F.col("_n")).drop("_n")


def chunk_aggregate(samples: DataFrame, size: int, aggregates: dict[str, Column], stride: int = 0, keep_rest: bool = False) -> DataFrame:
    """Aggregates of every window: stream_id, win and the named columns."""
    return strided(samples, size, stride, keep_rest).groupBy("stream_id", "win").agg(*(c.alias(n) for n, c in aggregates.items()))


def stride_stream(samples: DataFrame, size: int, stride: int) -> DataFrame:
    """The stream that a block sees that reads windows one after the other."""
    rows = strided(samples, size, stride, keep_rest=True)
    return rows.select("stream_id", (F.col("win") * size + F.col("pos")).alias("idx"), "value")


def savgol_coefficients(size: int, order: int, derivative: int = 0, rate: float = 1.0, at: int | None = None) -> np.ndarray:
    """Least-squares weights of the samples of a window for the polynomial's derivative at one of them (the middle)."""
    at = size // 2 if at is None else at
    x = np.arange(size) - at
    basis = np.vander(x, order + 1, increasing=True)
    return np.linalg.pinv(basis)[derivative] * float(np.prod(np.arange(1, derivative + 1))) * rate**derivative


def savitzky_golay(samples: DataFrame, size: int = 11, order: int = 4, derivative: int = 0, rate: float = 1.0, causal: bool = False) -> DataFrame:
    """Polynomial smoothing as a FIR filter: causal fits at the newest sample; centred is the fit at the window's middle, as late as half a window."""
    weights = savgol_coefficients(size, order, derivative, rate, size - 1 if causal else None)
    return fir(samples, weights[::-1].tolist())


def reflected(x: np.ndarray, half: int, policy: str = "Reflect") -> np.ndarray:
    if policy == "Replicate" or len(x) < 2:
        return np.concatenate([np.full(half, x[0]), x, np.full(half, x[-1])])
    return np.pad(x, half, mode="reflect")


def savgol_zero_phase(x: np.ndarray, size: int = 11, order: int = 4, derivative: int = 0, rate: float = 1.0, policy: str = "Reflect") -> np.ndarray:
    """A centred filter, run forward and then backward over a data set's values."""
    weights = savgol_coefficients(size, order, derivative, rate)

    def once(v: np.ndarray) -> np.ndarray:
        return np.correlate(reflected(v, size // 2, policy), weights, "valid")

    return once(once(np.asarray(x, float))[::-1])[::-1]
