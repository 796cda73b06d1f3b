"""Estimators over chunks of a stream: frequency in time and in spectrum, lock-in demodulation, SVD noise reduction.

A chunk is a group of its own (stream, window), with as many earlier samples as the operator needs to settle, so chunks of
one stream run in parallel; a value that a chunk cannot give repeats the stream's last one (a forward fill).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sampleweave.operators.design import iir_design
from sampleweave.operators.recursive import Recursion
from sampleweave.operators.window import strided


def per_chunk(samples: DataFrame, size: int, history: int, compute: Callable[[dict[str, np.ndarray], int], dict[str, float]], outputs: list[str], columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """One row per chunk: compute(values of the columns with up to history samples before the chunk, how many those are)."""
    kind = dict(samples.dtypes)["stream_id"]
    ends = samples.groupBy("stream_id").agg((F.max("idx") + 1).alias("_n"))
    home = F.expr(f"idx div {size}")
    later = F.expr(f"(idx + {history}) div {size}")
    rows = samples.join(ends, "stream_id").withColumn("win", F.explode(F.sequence(home, later))).filter(F.col("win") * size + size <= F.col("_n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        before = int((pdf["idx"] < pdf["win"] * size).sum())
        made = compute({c: pdf[c].to_numpy(float) for c in columns}, before)
        return pd.DataFrame({"stream_id": [pdf["stream_id"].iloc[0]], "win": [pdf["win"].iloc[0]], **{n: [made.get(n)] for n in outputs}})

    made = rows.select("stream_id", "win", "idx", *columns).groupBy("stream_id", "win").applyInPandas(run, f"stream_id {kind}, win long, " + ", ".join(f"{n} double" for n in outputs))
    w = Window.partitionBy("stream_id").orderBy("win").rowsBetween(Window.unboundedPreceding, 0)
    return made.select("stream_id", "win", *(F.last(n, ignorenulls=True).over(w).alias(n) for n in outputs))


def from_neighbours(y: np.ndarray, sample_rate: float, epsilon: float = 1e-8) -> float | None:
    """A sine's frequency from its samples' energy. The two neighbours of a sample of a sine add up to the sample times
    twice the cosine of a step's angle, so their energy is 2 + 2 cos(two steps) times that of the samples."""
    inner, around = y[1:-1], y[:-2] + y[2:]
    energy = float(inner @ inner)
    if energy <= epsilon:
        return None
    turn = float(around @ around) / (2 * energy) - 1
    return math.acos(turn) / (2 * math.tau) * sample_rate if -1 < turn < 1 else None


def time_domain(samples: DataFrame, sample_rate: float = 1e3, f_min: float = 40.0, f_expected: float = 50.0, f_max: float = 60.0, n_periods: int = 4, chunk: int = 100) -> DataFrame:
    """Frequency per chunk after a second-order Bessel low-pass, over the last n_periods of the expected frequency."""
    b, a = iir_design("LOWPASS", 2, f_max, f_max * 2, sample_rate, "BESSEL")
    window = max(3, int(n_periods * sample_rate / f_expected))
    settle = int(4 * sample_rate / f_min)

    def compute(x: dict[str, np.ndarray], before: int) -> dict[str, float]:
        y = Recursion(b, a).run(x["value"])[0]
        return {"frequency": from_neighbours(y[-window:], sample_rate) if len(y) >= window else None}

    return per_chunk(samples, chunk, window + settle, compute, ["frequency"])


def spectral_peak(x: np.ndarray, sample_rate: float, f_min: float, f_max: float, epsilon: float = 1e-8) -> float | None:
    """The strongest bin in a range of a Hann-windowed spectrum, refined by a Gaussian through its neighbours."""
    n = len(x)
    m = np.abs(np.fft.fft(x * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))))[: n // 2] * 2 / n
    lo, hi = (int(np.clip(f(g / sample_rate * n), 1, len(m) - 1)) for f, g in ((np.floor, f_min), (np.ceil, f_max)))
    k = lo + int(m[lo : hi + 1].argmax())
    if k >= len(m) - 1 or min(m[k - 1 : k + 2]) <= 0:
        return None
    left, centre, right = np.log(m[k - 1 : k + 2])
    bend = 2 * centre - left - right
    if abs(bend) < epsilon or abs(shift := 0.5 * (right - left) / bend) >= 1:
        return None
    return float((k + shift) * sample_rate / n)


def frequency_domain(samples: DataFrame, sample_rate: float = 1e3, f_min: float = 40.0, f_max: float = 60.0, size: int = 256) -> DataFrame:
    return per_chunk(samples, size, 0, lambda x, before: {"frequency": spectral_peak(x["value"], sample_rate, f_min, f_max)}, ["frequency"])


def lock_in(ref: np.ndarray, resp: np.ndarray, before: int, sample_rate: float, f_high_pass: float, f_low_pass: float) -> dict[str, float]:
    """Amplitude and phase of a response against a reference, and the reference's frequency: the reference and its scaled
    derivative are quadratures; products with both pass a low-pass. The frequency is found by iteration from the spectrum."""
    high = iir_design("HIGHPASS", 2, f_high_pass, sample_rate / 4, sample_rate)
    x, y = (Recursion(*high).run(v)[0] for v in (ref, resp))
    f = spectral_peak(x[before:], sample_rate, f_high_pass, sample_rate / 2.5) if len(x) - before >= 16 else None
    f = from_neighbours(x[before:], sample_rate) or f
    if not f:
        return {}
    w = 2 * math.pi * f / sample_rate
    quad = np.gradient(x) / math.sin(w)
    low = iir_design("LOWPASS", 2, f_low_pass, sample_rate / 4, sample_rate)
    smooth = lambda v: Recursion(*low).run(v)[0][before:].mean()
    xx, qq, xy, qy = smooth(x * x), smooth(quad * quad), smooth(x * y), smooth(quad * y)
    power = (xx + qq) / 2
    if power <= 0:
        return {}
    i, q = xy / power, qy / power
    return {"amplitude": float(math.hypot(i, q)) * math.sqrt(2 * power), "phase": float(math.atan2(q, i)), "frequency": float(f)}


def iq_demodulator(samples: DataFrame, sample_rate: float = 62.5e6, f_high_pass: float = 100.0, f_low_pass: float = 10_000.0, chunk: int = 1024, settle: int = 4096) -> DataFrame:
    """Lock-in per chunk of samples (stream_id, idx, ref, resp)."""
    return per_chunk(samples, chunk, settle, lambda x, before: lock_in(x["ref"], x["resp"], before, sample_rate, f_high_pass, f_low_pass), ["amplitude", "phase", "frequency"], ("ref", "resp"))


def svd_denoised(x: np.ndarray, rows: int = 0, max_rank: int | None = None, relative: float = 0.0, absolute: float = 0.0, energy: float = 1.0) -> np.ndarray:
    """The Hankel matrix of a window without its weak singular values, averaged along its anti-diagonals."""
    n = len(x)
    rows = rows or n // 2
    h = np.lib.stride_tricks.sliding_window_view(x, n - rows + 1)
    u, s, v = np.linalg.svd(h, full_matrices=False)
    keep = min(len(s), max_rank or len(s))
    keep = min(keep, int((s >= max(absolute, relative * (s[0] if len(s) else 0))).sum()))
    if energy < 1 and s.any():
        keep = min(keep, int(np.searchsorted(np.cumsum(s * s) / (s * s).sum(), energy)) + 1)
    low = (u[:, :keep] * s[:keep]) @ v[:keep]
    total, count = np.zeros(n), np.zeros(n)
    for r in range(rows):
        total[r : r + n - rows + 1] += low[r]
        count[r : r + n - rows + 1] += 1
    return total / count


def svd_denoiser(samples: DataFrame, size: int = 64, hop_fraction: float = 0.25, **how) -> DataFrame:
    """Every window's newest hop of samples, denoised; the first window gives all of its samples."""
    hop = max(1, int(size * hop_fraction))
    kind = dict(samples.dtypes)["stream_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out = svd_denoised(pdf["value"].to_numpy(float), **how)
        first = 0 if pdf["win"].iloc[0] == 0 else size - hop
        return pd.DataFrame({"stream_id": pdf["stream_id"].iloc[0], "idx": pdf["idx"].to_numpy()[first:], "value": out[first:]})

    return strided(samples, size, hop).select("stream_id", "win", "pos", "idx", "value").groupBy("stream_id", "win").applyInPandas(run, f"stream_id {kind}, idx long, value double")
