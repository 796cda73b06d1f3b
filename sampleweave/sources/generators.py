"""Generated streams: everything is an expression of the index, so any range of any stream is made where it is needed."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleweave.model import carried


def samples(spark: SparkSession, n: int, value: Column | float, stream: str = "s") -> DataFrame:
    value = value if isinstance(value, Column) else F.lit(value)
    return spark.range(n).select(F.lit(stream).alias("stream_id"), F.col("id").alias("idx")).withColumn("value", value.cast("double"))


def null_source(spark: SparkSession, n: int) -> DataFrame:
    return samples(spark, n, 0.0)


def constant_source(spark: SparkSession, n: int, value: float = 0.0) -> DataFrame:
    return samples(spark, n, value)


def counting_source(spark: SparkSession, n: int, start: float = 0.0) -> DataFrame:
    """The count goes up before its first use, so the first sample is start + 1."""
    return samples(spark, n, F.lit(start) + F.col("idx") + 1)


def tag_source(spark: SparkSession, values: Sequence[float], tags: Sequence[tuple[int, str, str]], repeat: int = 1) -> tuple[DataFrame, DataFrame]:
    """Given values and tags (index, name, context), repeated: a table of samples and one of tags."""
    rows = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "stream_id string, idx long, value double")
    marks = spark.createDataFrame([("s", i, name, context, k, 0) for k, (i, name, context) in enumerate(tags)], "stream_id string, idx long, name string, context string, seq int, time long")
    return tuple(rounds(f, repeat).withColumn("idx", F.col("idx") + F.col("_round") * len(values)).drop("_round") for f in (rows, marks))


def rounds(rows: DataFrame, n: int) -> DataFrame:
    """rows n times over, with their _round from 0."""
    return rows.withColumn("_round", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))) if n > 0 else rows.withColumn("_round", F.lit(0).cast("long")).limit(0)


def noise(kind: str, place: Column, seed: int = 0) -> Column:
    """UniformNoise and TriangularNoise from -1 to 1, GaussianNoise of variance 1: hashes of the seed and the place, so that any range of any run draws the same."""

    def uniform(k: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), place), 11) + 0.5) / float(1 << 53)

    if kind == "GaussianNoise":
        return F.sqrt(-2 * F.log(uniform(0))) * F.cos(2 * math.pi * uniform(1))
    return {"UniformNoise": lambda: uniform(0) * 2 - 1, "TriangularNoise": lambda: uniform(0) + uniform(1) - 1}[kind]()


def waveform(kind: str, t: Column, frequency: float, amplitude: float = 1.0, offset: float = 0.0, phase: float = 0.0, seed: int = 0) -> Column:
    """Const, Sin, Cos, Square, Saw, Triangle, FastSin, FastCos, UniformNoise, TriangularNoise, GaussianNoise at times t. A frequency of 0 or less makes a tone constant."""
    a, o = F.lit(float(amplitude)), F.lit(float(offset))
    theta = 2 * math.pi * frequency * t + phase
    cycle = frequency * t + phase / (2 * math.pi)
    if "Noise" in kind:
        return o + a * noise(kind, t, seed)
    if kind == "Const" or frequency <= 0:
        return a + o
    return {
        "Sin": lambda: a * F.sin(theta) + o, "FastSin": lambda: a * F.sin(theta) + o, "Cos": lambda: a * F.cos(theta) + o, "FastCos": lambda: a * F.cos(theta) + o,
        "Square": lambda: F.when(cycle - F.floor(cycle) < 0.5, a).otherwise(-a) + o,
        "Saw": lambda: a * 2 * (cycle - F.floor(cycle + 0.5)) + o,
        "Triangle": lambda: a * (4 * F.abs(cycle - F.floor(cycle + 0.75) + 0.25) - 1) + o,
    }[kind]()


def signal_generator(spark: SparkSession, n: int, kind: str = "Sin", sample_rate: float = 1000.0, frequency: float = 1.0, amplitude: float = 1.0, offset: float = 0.0, phase: float = 0.0, seed: int = 0) -> DataFrame:
    return samples(spark, n, waveform(kind, F.col("idx") / F.lit(float(sample_rate)), frequency, amplitude, offset, phase, seed))


def ramp(kind: Column, t: Column, start: Column, final: Column, duration: Column, round_off: Column, impulse0: Column, impulse1: Column) -> Column:
    """Const, LinearRamp, ParabolicRamp, CubicSpline, ImpulseResponse: the value at t after a segment's start."""
    u = t / F.nullif(duration, F.lit(0.0))
    line = start + (final - start) * u

    def travelled(time: Column) -> Column:
        """The way covered by a speed that grows at one unit a second from 0 until round_off and stays there."""
        growing = F.greatest(F.lit(0.0), F.least(time, round_off))
        return growing * growing / 2 + round_off * F.greatest(F.lit(0.0), time - round_off)

    # a parabolic ramp speeds up, keeps its speed and slows down: the slowing is the same speeding-up taken off again
    share = (travelled(t) - travelled(t - duration + round_off)) / F.nullif(round_off * (duration - round_off), F.lit(0.0))
    parabola = F.coalesce(start + (final - start) * share, line)
    cubic = u * u * (3 - 2 * u)
    return (
        F.when(kind == "LinearRamp", F.when(t > duration, final).otherwise(line))
        .when(kind == "ParabolicRamp", F.when(t > duration, final).otherwise(parabola))
        .when(kind == "CubicSpline", F.when(t > duration, final).otherwise(start + (final - start) * cubic))
        .when(kind == "ImpulseResponse", F.when((t < impulse0) | (t > impulse0 + impulse1), start).otherwise(final))
        .otherwise(start)
    )


def function_generator(clock: DataFrame, segments: DataFrame, sample_rate: float = 1000.0, seed: int = 0) -> DataFrame:
    """A sequence of functions: segments (stream_id, idx, kind, start_value, final_value, duration, round_off_time, impulse_time0,
    impulse_time1) begin at their sample and hold until the next; before the first the value is 0.

    A noise kind has start_value as its amplitude. A tone (Sin, Cos, FastSin, FastCos; columns frequency and phase) turns
    about start_value by final_value from its segment's first sample on, until a duration above 0 is over.
    """
    fields = [c for c in segments.columns if c not in ("stream_id", "idx")]
    marks = segments.select("stream_id", "idx", F.struct(F.col("idx").alias("at"), *fields).alias("_segment"))
    rows = carried(clock.select("stream_id", "idx").join(marks, ["stream_id", "idx"], "left"), F.col("_segment"), "_s")
    t = (F.col("idx") - F.col("_s.at")) / F.lit(float(sample_rate))
    value = ramp(F.col("_s.kind"), t, *(F.col(f"_s.{c}") for c in ("start_value", "final_value", "duration", "round_off_time", "impulse_time0", "impulse_time1")))
    kind, level = F.col("_s.kind"), F.col("_s.start_value")
    for name in ("UniformNoise", "TriangularNoise", "GaussianNoise"):
        value = F.when(kind == name, level * noise(name, F.struct("stream_id", "idx"), seed)).otherwise(value)
    if {"frequency", "phase"} <= set(fields):
        angle = 2 * math.pi * F.col("_s.frequency") * t + F.col("_s.phase")
        turned = level + F.col("_s.final_value") * F.when(kind.endswith("Sin"), F.sin(angle)).otherwise(F.cos(angle))
        over = (F.col("_s.duration") > 0) & (t > F.col("_s.duration"))
        value = F.when(kind.isin("Sin", "Cos", "FastSin", "FastCos"), F.when(over, level).otherwise(turned)).otherwise(value)
    return rows.select("stream_id", "idx", F.when(F.col("_s").isNull(), 0.0).otherwise(value).alias("value"))


def clock_source(spark: SparkSession, n: int, sample_rate: float, tags: Sequence[tuple[int, str]], repeat_period: int = 0) -> tuple[DataFrame, DataFrame]:
    """n samples of a clock, and the tags (time in ns, 'name/context') at the samples of their times; with a period they repeat to the end."""
    times = [t for t, _ in tags]
    if times != sorted(times):
        raise ValueError("tag times must ascend")
    end = int(n / sample_rate * 1e9)
    first = spark.createDataFrame([("s", v.split("/")[0], v.partition("/")[2], k, t) for k, (t, v) in enumerate(tags)], "stream_id string, name string, context string, seq int, time long")
    marks = rounds(first, -(-end // repeat_period) if repeat_period else 1).withColumn("time", F.col("time") + F.col("_round") * repeat_period)
    marks = marks.withColumn("idx", F.bround(F.col("time") * F.lit(sample_rate / 1e9)).cast("long")).filter(F.col("idx") < n)
    return samples(spark, n, 0.0), marks.select("stream_id", "idx", "name", "context", "seq", "time")


def test_signal(spark: SparkSession, kind: str, n: int, **at: float) -> DataFrame:
    """Data sets for tests: triangular, ramp, gauss, step over n places of one axis (ds, idx, x, y)."""
    k = F.col("idx").cast("double")
    centre, width, low, high = at.get("centre", n / 2), at.get("width", n / 8), at.get("low", 0.0), at.get("high", 1.0)
    y = {
        "triangular": lambda: F.lit(low) + (high - low) * F.greatest(F.lit(0.0), 1 - F.abs(k - centre) / width),
        "ramp": lambda: F.lit(low) + (high - low) * k / max(1, n - 1),
        "gauss": lambda: F.lit(low) + (high - low) * F.exp(-((k - centre) ** 2) / (2 * width * width)),
        "step": lambda: F.when(k < centre, F.lit(low)).otherwise(F.lit(high)),
    }[kind]()
    return spark.range(n).select(F.lit(kind).alias("ds"), F.col("id").alias("idx")).select("ds", "idx", k.alias("x"), y.cast("double").alias("y"))
