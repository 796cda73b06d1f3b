"""Element-wise operators: constants, folds over several streams, conversions, complex parts, rotation, expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleweave.functions import cplx
from sampleweave.functions.expressions import translated
from sampleweave.functions.scalars import divided

OPERATIONS = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": divided}
#: Ranges of the integer types of converters, for results that wrap as theirs do.
INTEGERS = {"int8": (8, True), "int16": (16, True), "int32": (32, True), "int64": (64, True), "uint8": (8, False), "uint16": (16, False), "uint32": (32, False), "uint64": (64, False)}
SPARK_TYPE = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double"}


def with_constant(samples: DataFrame, op: str, value: float = 1.0) -> DataFrame:
    """value op constant at every sample."""
    return samples.withColumn("value", OPERATIONS[op](F.col("value"), F.lit(value)))


def fold(streams: Sequence[DataFrame], op: str) -> DataFrame:
    """Sample k of all streams, folded from the left; the shortest stream ends the result."""
    named = [s.select("stream_id", "idx", F.col("value").alias(f"v{i}")) for i, s in enumerate(streams)]
    joined = reduce(lambda a, b: a.join(b, ["stream_id", "idx"]), named)
    return joined.select("stream_id", "idx", reduce(OPERATIONS[op], [F.col(f"v{i}") for i in range(len(named))]).alias("value"))


def fold_ports(samples: DataFrame, ports: Sequence[str], op: str) -> DataFrame:
    """The same where the streams are columns of one table: no join."""
    return samples.withColumn("value", reduce(OPERATIONS[op], [F.col(p) for p in ports]))


def wrapped(x: Column, kind: str) -> Column:
    """An integer of any size as an integer type keeps it: modulo its range."""
    bits, signed = INTEGERS[kind]
    whole, half = (F.lit(str(1 << n)).cast("decimal(38,0)") for n in (bits, bits - 1))
    low = x.cast("decimal(38,0)") % whole
    low = F.when(low < 0, low + whole).otherwise(low)
    if signed:
        low = F.when(low >= half, low - whole).otherwise(low)
    return low.cast(SPARK_TYPE[kind])


def converted(x: Column, kind: str, scale: float | None = None) -> Column:
    """x, times scale, as another type: fractions are cut towards zero, integers wrap, values that are no number give null."""
    x = x if scale is None else x * F.lit(scale)
    if kind not in INTEGERS:
        return x.cast(SPARK_TYPE[kind])
    usable = ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < 1e37)
    cut = F.when(x >= 0, F.floor(x.cast("decimal(38,9)"))).otherwise(F.ceil(x.cast("decimal(38,9)")))
    return F.when(usable, wrapped(cut, kind))


def absolute(x: Column, unsigned: bool = False) -> Column:
    return x if unsigned else F.abs(x)


def degrees(x: Column) -> Column:
    return x / math.pi * 180


def radians(x: Column) -> Column:
    return x / 180 * math.pi


def to_real_imag(samples: DataFrame) -> DataFrame:
    return samples.select("stream_id", "idx", cplx.real(F.col("value")).alias("real"), cplx.imag(F.col("value")).alias("imag"))


def real_imag_to_complex(samples: DataFrame, real: str = "real", imag: str = "imag") -> DataFrame:
    return samples.select("stream_id", "idx", cplx.complex_(F.col(real), F.col(imag)).alias("value"))


def to_mag_phase(samples: DataFrame) -> DataFrame:
    return samples.select("stream_id", "idx", cplx.magnitude(F.col("value")).alias("mag"), cplx.arg(F.col("value")).alias("phase"))


def mag_phase_to_complex(samples: DataFrame, mag: str = "mag", phase: str = "phase") -> DataFrame:
    return samples.select("stream_id", "idx", cplx.polar(F.col(mag), F.col(phase)).alias("value"))


def complex_to_interleaved(samples: DataFrame) -> DataFrame:
    """One complex sample to two real ones."""
    parts = samples.select("stream_id", "idx", F.posexplode(F.array("value.re", "value.im")).alias("part", "value"))
    return parts.select("stream_id", (F.col("idx") * 2 + F.col("part")).alias("idx"), "value")


def interleaved_to_complex(samples: DataFrame) -> DataFrame:
    """Two real samples to a complex one; a last one alone is dropped."""
    pair = samples.groupBy("stream_id", F.expr("idx div 2").alias("idx")).agg(F.max(F.when(F.col("idx") % 2 == 0, F.col("value"))).alias("re"), F.max(F.when(F.col("idx") % 2 == 1, F.col("value"))).alias("im"), F.count("*").alias("n"))
    return pair.filter("n = 2").select("stream_id", "idx", cplx.complex_(F.col("re"), F.col("im")).alias("value"))


def rotator(samples: DataFrame, phase_increment: float | None = None, frequency_shift: float | None = None, sample_rate: float = 1.0, initial_phase: float = 0.0) -> DataFrame:
    """Complex samples turned by a phase that grows by one increment before each of them. Give the increment or the shift, not both."""
    if (phase_increment is None) == (frequency_shift is None):
        raise ValueError("give either phase_increment or frequency_shift")
    step = phase_increment if phase_increment is not None else 2 * math.pi * frequency_shift / sample_rate
    phase = F.pmod(F.lit(initial_phase) + (F.col("idx") + 1) * F.lit(step), F.lit(2 * math.pi))
    return samples.withColumn("value", cplx.mul(F.col("value"), cplx.polar(F.lit(1.0), phase)))


def expression(samples: DataFrame, text: str, a: float = 1.0, b: float = 0.0, c: float = 0.0) -> DataFrame:
    """An expression of x and the parameters; one that reads y, the output before, runs as operators.recursive.expression."""
    return samples.withColumn("value", translated(text, {"x": F.col("value"), "a": F.lit(a), "b": F.lit(b), "c": F.lit(c)}))


def expression_of_two(x: DataFrame, y: DataFrame, text: str = "a*(x+y)", a: float = 1.0, b: float = 0.0, c: float = 0.0) -> DataFrame:
    joined = x.select("stream_id", "idx", F.col("value").alias("_x")).join(y.select("stream_id", "idx", F.col("value").alias("_y")), ["stream_id", "idx"])
    return joined.select("stream_id", "idx", translated(text, {"x": F.col("_x"), "y": F.col("_y"), "a": F.lit(a), "b": F.lit(b), "c": F.lit(c)}).alias("value"))


def split_merge(samples: DataFrame, paths: Sequence, signs: Sequence[int] | None = None) -> DataFrame:
    """The signed sum of parallel element-wise paths (functions of a column) as one expression."""
    signs = signs or [1] * len(paths)
    return samples.withColumn("value", reduce(lambda s, t: s + t, [sign * path(F.col("value")) for sign, path in zip(signs, paths, strict=True)]))
