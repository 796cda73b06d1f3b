"""Scalars and arrays: interpolation, levels, lookups on an axis, element-wise data-set mathematics, tensors, checksums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def linear_interpolate(x0: Column, x1: Column, y0: Column, y1: Column, at: Column) -> Column:
    """The line through two points; y0 where both have the same x."""
    return F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (at - x0) / F.nullif(x1 - x0, F.lit(0.0)))


def sign(x: Column) -> Column:
    return F.when(x >= 0, 1.0).otherwise(-1.0)


def logarithm(x: Column, factor: float) -> Column:
    """factor * log10(x): minus infinity at zero, not a number below."""
    return F.when(x == 0, float("-inf")).when(x < 0, NAN).otherwise(factor * F.log10(F.when(x > 0, x)))


def decibel(x: Column) -> Column:
    return logarithm(x, 20.0)


def inverse_decibel(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 20)


def divided(a: Column, b: Column) -> Column:
    """a / b, not a number where b is zero."""
    return F.when(b == 0, F.lit(NAN)).otherwise(a / F.nullif(b, F.lit(0.0)))


#: How two values make one; squares, roots and logarithms act on the sum, as the identity of two data sets does.
MATH = {
    "ADD": lambda a, b: a + b, "SUBTRACT": lambda a, b: a - b, "MULTIPLY": lambda a, b: a * b, "DIVIDE": divided,
    "SQR": lambda a, b: (a + b) * (a + b), "SQRT": lambda a, b: F.when(a + b > 0, F.sqrt(a + b)).otherwise(NAN), "LOG10": lambda a, b: logarithm(a + b, 10.0),
    "DB": lambda a, b: decibel(a + b), "INV_DB": lambda a, b: inverse_decibel(a), "IDENTITY": lambda a, b: a + b,
}


def array_math(op: str, a: Column, b: Column | float) -> Column:
    """An operation of MATH over arrays of equal length, or an array and a number (of which IDENTITY keeps the array)."""
    if isinstance(b, Column):
        return F.zip_with(a, b, MATH[op])
    return F.transform(a, lambda x: x if op == "IDENTITY" else MATH[op](x, F.lit(float(b))))


def index_at(axis: Column, at: Column) -> Column:
    """The place of the axis value nearest to at (the first of equals), from 0."""
    best = F.array_min(F.transform(axis, lambda x, i: F.struct(F.abs(x - at).alias("d"), i.alias("i"))))
    return best["i"]


def value_at(axis: Column, values: Column, at: Column) -> Column:
    """The interpolated value at a place on an ascending axis; the end values beyond it."""
    after = F.size(F.filter(axis, lambda x: x <= at))
    lo = F.greatest(after - 1, F.lit(0))
    hi = F.least(after, F.size(axis) - 1)
    return linear_interpolate(F.get(axis, lo), F.get(axis, hi), F.get(values, lo), F.get(values, hi), at)


def sub_array(values: Column, start: int, stop: int) -> Column:
    return F.slice(values, start + 1, max(0, stop - start))


def mean(values: Column) -> Column:
    return divided(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), F.size(values).cast("double"))


def variance(values: Column) -> Column:
    """Of the population."""
    centre = mean(values)
    return mean(F.transform(values, lambda x: (x - centre) * (x - centre)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def frobenius(values: Column) -> Column:
    return F.sqrt(dot(values, values))


def gemv(matrix: Column, vector: Column) -> Column:
    """matrix: an array of rows."""
    return F.transform(matrix, lambda row: dot(row, vector))


def transpose(matrix: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(matrix, 0)) - 1), lambda j: F.transform(matrix, lambda row: F.get(row, j)))


def gemm(a: Column, b: Column) -> Column:
    columns = transpose(b)
    return F.transform(a, lambda row: gemv(columns, row))


def hankel(values: Column, rows: int) -> Column:
    """The Hankel matrix with the given number of rows."""
    return F.transform(F.sequence(F.lit(1), F.lit(rows)), lambda i: F.slice(values, i, F.size(values) - rows + 1))


def all_finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def adler32(data: Column) -> Column:
    """The Adler-32 checksum of a binary column."""
    digits = F.hex(data)
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(2)), F.lit(2))
    state = F.aggregate(F.when(F.length(digits) > 0, places).otherwise(F.array().cast("array<int>")), F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), lambda s, i: F.struct(((s["a"] + F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")) % 65521).alias("a"), ((s["b"] + s["a"] + F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("long")) % 65521).alias("b")))
    return state["b"] * 65536 + state["a"]
