"""Clocks: sample-rate estimate from arrival times, drift compensation, burst envelopes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sampleweave.model import blocked
from sampleweave.operators.recursive import iir


def sample_rate_estimate(marks: DataFrame, nominal: float, cutoff: float = 0.1) -> DataFrame:
    """marks (stream_id, idx, n, time in ns): samples since the last mark and its time. A one-pole low-pass over the measured periods gives rate and ppm."""
    w = Window.partitionBy("stream_id").orderBy("idx")
    period = (F.col("time") - F.lag("time").over(w)) / F.lit(1e9) / F.col("n")
    rows = marks.select("stream_id", "idx", F.coalesce(period, F.lit(1 / nominal)).alias("value"))
    off = rows.withColumn("value", F.col("value") - 1 / nominal)
    k = 1 - math.exp(-2 * math.pi * cutoff)
    smooth = iir(off, [k], [1.0, k - 1])
    rate = 1 / (F.col("value") + 1 / nominal)
    return smooth.select("stream_id", "idx", rate.alias("sample_rate"), ((rate / nominal - 1) * 1e6).alias("ppm"))


def resampled(x: np.ndarray, ratio: float, method: str = "Linear") -> np.ndarray:
    """x read at steps of ratio: None drops or repeats whole samples, Linear, Cubic (Hermite)."""
    at = np.arange(0, len(x) - 1 + 1e-9, ratio)
    if method == "None":
        return x[np.round(at).astype(int)]
    i = np.minimum(at.astype(int), max(0, len(x) - 2))
    u = at - i
    if method == "Linear" or len(x) < 4:
        return x[i] * (1 - u) + x[np.minimum(i + 1, len(x) - 1)] * u
    p = x[np.clip(i[:, None] + np.arange(-1, 3)[None, :], 0, len(x) - 1)].T
    m0, m1 = (p[2] - p[0]) / 2, (p[3] - p[1]) / 2
    return (2 * u**3 - 3 * u**2 + 1) * p[1] + (u**3 - 2 * u**2 + u) * m0 + (3 * u**2 - 2 * u**3) * p[2] + (u**3 - u**2) * m1


def hermite(p0: Column, p1: Column, p2: Column, p3: Column, u: Column) -> Column:
    """The cubic from p1 to p2 whose slopes are those of the neighbours' chords."""
    m1, m2 = (p2 - p0) / 2, (p3 - p1) / 2
    rise_ = p2 - p1
    return p1 + u * (m1 + u * ((3 * rise_ - 2 * m1 - m2) + u * (m1 + m2 - 2 * rise_)))


def chord_cubic(p0: Column, p1: Column, p2: Column, p3: Column, u: Column) -> Column:
    """hermite by its coefficients in falling powers: the same curve, whose last digits are those of SQL that adds in this order."""
    cubed, squared = 1.5 * p1 - 0.5 * p0 - 1.5 * p2 + 0.5 * p3, p0 - 2.5 * p1 + 2.0 * p2 - 0.5 * p3
    return ((cubed * u + squared) * u + (p2 - p0) / 2) * u + p1


def drift_compensated(samples: DataFrame, ppm: float, method: str = "Linear") -> DataFrame:
    """Streams read by a clock that is off by ppm, resampled to the true one as resampled does, in parallel within a stream.

    idx has no gap. A sample makes the outputs that fall between it and the next one, from a halo of three samples.
    """
    ratio = 1 + ppm * 1e-6

    def neighbours(rows: DataFrame, w: WindowSpec) -> DataFrame:
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("_p0", F.lag("value").over(w)).withColumn("_p2", F.lead("value").over(w)).withColumn("_p3", F.lead("value", 2).over(w))
        last = F.lead("idx").over(w).isNull()
        # a stream of fewer than four samples lies in its first block as a whole
        return rows.withColumn("_last", last).withColumn("_few", (F.expr("_block = 0")) & (F.count("*").over(whole) < 4))

    rows = blocked(samples.select("stream_id", "idx", "value"), 1, 2, neighbours)
    near = F.sequence(F.greatest(F.floor(F.col("idx") / F.lit(ratio)) - 1, F.lit(0)), F.ceil((F.col("idx") + 1) / F.lit(ratio)) + 1)
    at = F.col("_k") * F.lit(ratio)
    rows = rows.withColumn("_k", F.explode(near)).filter(F.floor(at) == F.col("idx")).withColumn("_u", at - F.col("idx"))
    rows = rows.filter(~F.col("_last") | (F.col("_u") < 1e-9))
    p1, u = F.col("value"), F.col("_u")
    p2 = F.coalesce("_p2", F.when(F.col("_last"), p1))
    line = p1 * (1 - u) + p2 * u
    if method == "None":
        out = F.when((u < 0.5) | ((u == 0.5) & (F.col("idx") % 2 == 0)), p1).otherwise(p2)
    elif method == "Linear":
        out = line
    else:
        p0, p3 = F.when(F.col("idx") == 0, p1).otherwise(F.col("_p0")), F.coalesce("_p3", "_p2", p1)
        out = F.when(F.col("_few"), line).otherwise(hermite(p0, p1, p2, p3, u))
    return rows.select("stream_id", F.col("_k").cast("long").alias("idx"), out.alias("value"))


def adaptively_resampled(samples: DataFrame, estimated_rate: float, nominal_rate: float, chunk: int = 1024) -> DataFrame:
    """Each chunk of so many samples spread anew, first to first and last to last, over the number that the true rate asks for.

    A chunk of n becomes n * nominal / estimated, rounded half up, by cubics that stay within the chunk. One of a single
    sample, or of none afterwards, stays as it is; rates that are not above zero change nothing.
    """
    if estimated_rate <= 0 or nominal_rate <= 0:
        return samples.select("stream_id", "idx", "value")
    ratio = estimated_rate / nominal_rate
    sizes = lambda n: F.floor(n / F.lit(ratio) + 0.5).cast("int")
    full = int(chunk / ratio + 0.5) or chunk
    rows = samples.groupBy("stream_id", F.expr(f"idx div {chunk}").alias("_c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "value"))), lambda s: s["value"]).alias("_x"))
    n = F.size("_x")
    rows = rows.withColumn("_n", n).withColumn("_m", F.when((n < 2) | (sizes(n) == 0), n).otherwise(sizes(n)))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_k"))
    # one division, last: a rounded step times k would miss places that are exact
    spread = F.col("_k") * (F.col("_n") - 1).cast("double") / F.greatest(F.lit(1), F.col("_m") - 1)
    rows = rows.withColumn("_at", F.when(F.col("_n") == F.col("_m"), F.col("_k").cast("double")).otherwise(spread))
    i = F.floor("_at").cast("int")
    p = [F.get("_x", F.least(F.greatest(i + d, F.lit(0)), F.col("_n") - 1)) for d in (-1, 0, 1, 2)]
    return rows.select("stream_id", (F.col("_c") * full + F.col("_k")).cast("long").alias("idx"), chord_cubic(*p, F.col("_at") - i).alias("value"))


def spliced(samples: DataFrame, estimated_rate: float, nominal_rate: float, chunk: int = 1024, method: str = "Linear", most: float = 2.0) -> DataFrame:
    """Drift made good by whole samples at the ends of chunks: what a chunk runs ahead adds up, within -most and most, and at one
    a sample half way past the last two follows the chunk, at minus one its last two become their mean.

    A stream's chunks, one row each, are gone through in order in one task; its samples never are.
    """
    if method == "None" or estimated_rate <= 0 or nominal_rate <= 0:
        return samples.select("stream_id", "idx", "value")
    kind, gain = dict(samples.dtypes)["stream_id"], estimated_rate / nominal_rate - 1

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_c")
        held, changes = 0.0, []
        for n in pdf["_n"]:
            held = min(max(held + n * gain, -most), most)
            change = 1 if held >= 1 else -1 if held <= -1 and n >= 2 else 0
            held -= change
            changes.append(change)
        made = pdf.assign(_change=np.array(changes, np.int64))
        return made.assign(_start=(made["_n"] + made["_change"]).cumsum() - made["_n"] - made["_change"])

    rows = samples.select("stream_id", "idx", "value", F.expr(f"idx div {chunk}").alias("_c"))
    chunks = rows.groupBy("stream_id", "_c").agg(F.count("*").alias("_n"))
    chunks = chunks.groupBy("stream_id").applyInPandas(plan, f"stream_id {kind}, _c long, _n long, _change long, _start long")
    w = Window.partitionBy("stream_id", "_c").orderBy("idx")
    rows = rows.withColumn("_pos", F.row_number().over(w) - 1).withColumn("_y1", F.lag("value").over(w)).withColumn("_y0", F.lag("value", 2).over(w)).withColumn("_next", F.lead("value").over(w))
    rows = rows.join(chunks, ["stream_id", "_c"])
    y, y1, y0 = F.col("value"), F.col("_y1"), F.col("_y0")
    half = (F.coalesce(y1, F.lit(0.0)) + y) / 2
    if method == "Cubic":
        half = F.when(F.col("_n") >= 2, hermite(F.when(F.col("_n") >= 3, y0).otherwise(y1), y1, y, y, F.lit(0.5))).otherwise(half)
    last, change = F.col("_pos") == F.col("_n") - 1, F.col("_change")
    kept = F.when(last & (change == 1), F.array(y, half)).when(last & (change == -1), F.array().cast("array<double>"))
    kept = kept.when((F.col("_pos") == F.col("_n") - 2) & (change == -1), F.array((y + F.col("_next")) / 2)).otherwise(F.array(y))
    return rows.select("stream_id", "_start", "_pos", F.posexplode(kept).alias("_more", "value")).select("stream_id", (F.col("_start") + F.col("_pos") + F.col("_more")).cast("long").alias("idx"), "value")


def rise(kind: str, u: Column, shape: float = 0.0) -> Column:
    """The envelope from 0 to 1 at a share u of the edge."""
    pi = math.pi
    sine = F.sin(pi * u)
    cosine = (1 - F.cos(pi * u)) / 2
    sigma = shape if shape > 0 else 0.4
    alpha = shape if shape > 0 else 0.5
    floor = math.exp(-0.5 / sigma**2)
    return {
        "None": lambda: F.lit(1.0), "Linear": lambda: u,
        "RaisedCosine": lambda: F.pow(cosine, F.lit(shape)) if shape > 0 and shape != 1 else cosine,
        "Tukey": lambda: F.when(u < alpha / 2, (1 - F.cos(2 * pi * u / alpha)) / 2).otherwise(1.0),
        "Gaussian": lambda: (F.exp(-0.5 * ((u - 1) / sigma) * ((u - 1) / sigma)) - floor) / (1 - floor),
        "Mushroom": lambda: u * u * (-12 + u * (28 - 15 * u)),
        "MushroomSine": lambda: cosine - 3 * pi / 8 * sine * sine * sine,
    }[kind]()


def burst_taper(rows: DataFrame, edge: int, kind: str = "RaisedCosine", shape: float = 0.0) -> DataFrame:
    """Samples of bursts (pos from a burst's start, length) times a rising edge, 1, and the same edge falling."""
    if edge <= 0 or kind == "None":
        return rows
    up = F.when(F.col("pos") < edge, rise(kind, (F.col("pos") + 1) / F.lit(float(edge + 1)), shape)).otherwise(1.0)
    back = F.col("length") - 1 - F.col("pos")
    down = F.when(back < edge, rise(kind, (back + 1) / F.lit(float(edge + 1)), shape)).otherwise(1.0)
    return rows.withColumn("value", F.col("value") * F.least(up, down))
