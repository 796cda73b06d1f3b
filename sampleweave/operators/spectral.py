"""Spectra of chunks: a discrete Fourier transform as a join with a twiddle table, or by numpy; magnitude, phase, unwrapping."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleweave.functions import windows
from sampleweave.operators.window import strided


LOWEST = -float(np.finfo(np.float64).max)  #: stands for the level of nothing


def dft(samples: DataFrame, size: int, window: str = "Hann") -> DataFrame:
    """For small sizes without Python: each sample meets the bins 0 to size / 2 - 1 and sums make re and im (stream_id, win, bin)."""
    rows = strided(samples, size).withColumn("_x", F.col("value") * windows.column(window, F.col("pos"), size))
    rows = rows.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(max(0, size // 2 - 1)))))
    angle = -2 * math.pi / size * ((F.col("bin") * F.col("pos")) % size)
    return rows.groupBy("stream_id", "win", "bin").agg(F.sum(F.col("_x") * F.cos(angle)).alias("re"), F.sum(F.col("_x") * F.sin(angle)).alias("im"))


def magnitude(re: Column, im: Column, size: int, in_db: bool = False) -> Column:
    m = F.hypot(re, im) * (2.0 / size)
    return F.when(m > 0, 20 * F.log10(F.when(m > 0, m))).otherwise(LOWEST) if in_db else m


def unwrapped(spectrum: DataFrame, phase: str = "phase") -> DataFrame:
    """Phases without jumps of a full turn between neighbouring bins."""
    w = Window.partitionBy("stream_id", "win").orderBy("bin")
    d = F.col(phase) - F.lag(phase).over(w)
    jump = F.when(d > math.pi, -2 * math.pi * F.ceil((d - math.pi) / (2 * math.pi))).when(d < -math.pi, 2 * math.pi * F.ceil((-d - math.pi) / (2 * math.pi))).otherwise(0.0)
    return spectrum.withColumn("_jump", jump).withColumn(phase, F.col(phase) + F.sum("_jump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")


def fft(samples: DataFrame, size: int = 1024, window: str = "Hann", sample_rate: float = 1.0, in_db: bool = False, in_degrees: bool = False, unwrap: bool = False) -> DataFrame:
    """One data set per chunk: frequency axis and magnitude, phase, re, im of the bins 0 to size / 2 - 1. Chunks are dealt by (stream, chunk), so a stream spreads over tasks."""
    weights = windows.values(window, size)

    def transform(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("pos")["value"].to_numpy(float) * weights
        z = np.fft.fft(x)[: size // 2]
        size_ = np.abs(z) * 2.0 / size
        phase = np.angle(z)
        if unwrap:
            phase = np.unwrap(phase)
        shown = np.where(size_ > 0, 20 * np.log10(np.where(size_ > 0, size_, 1.0)), LOWEST) if in_db else size_
        return pd.DataFrame({"stream_id": [pdf["stream_id"].iloc[0]], "win": [pdf["win"].iloc[0]], "frequency": [np.arange(size // 2) * sample_rate / size], "magnitude": [shown], "phase": [np.degrees(phase) if in_degrees else phase], "re": [z.real], "im": [z.imag]})

    kind = dict(samples.dtypes)["stream_id"]
    array = "array<double>"
    return strided(samples, size).select("stream_id", "win", "pos", "value").groupBy("stream_id", "win").applyInPandas(transform, f"stream_id {kind}, win long, frequency {array}, magnitude {array}, phase {array}, re {array}, im {array}")
