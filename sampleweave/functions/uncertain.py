"""Values with a standard uncertainty as structs of value and uncertainty; uncorrelated first-order propagation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uncertain(value: Column, uncertainty: Column | float = 0.0) -> Column:
    spread = uncertainty if isinstance(uncertainty, Column) else F.lit(uncertainty)
    return F.struct(value.cast("double").alias("value"), spread.cast("double").alias("uncertainty"))


def propagated(x: Column, value: Column, slope: Column) -> Column:
    return uncertain(value, F.abs(slope) * x["uncertainty"])


def add(a: Column, b: Column) -> Column:
    return uncertain(a["value"] + b["value"], F.hypot(a["uncertainty"], b["uncertainty"]))


def sub(a: Column, b: Column) -> Column:
    return uncertain(a["value"] - b["value"], F.hypot(a["uncertainty"], b["uncertainty"]))


def mul(a: Column, b: Column) -> Column:
    return uncertain(a["value"] * b["value"], F.hypot(a["value"] * b["uncertainty"], b["value"] * a["uncertainty"]))


def div(a: Column, b: Column) -> Column:
    v = F.nullif(b["value"], F.lit(0.0))
    inner = uncertain(a["value"] / v, F.hypot(a["uncertainty"] / v, a["value"] * b["uncertainty"] / (v * v)))
    nan = F.lit(float("nan"))
    return F.when(b["value"] != 0, inner).otherwise(uncertain(nan, nan))


def power(x: Column, exponent: float) -> Column:
    return propagated(x, F.pow(x["value"], F.lit(exponent)), exponent * F.pow(x["value"], F.lit(exponent - 1)))


def sqrt(x: Column) -> Column:
    root = F.sqrt(x["value"])
    return propagated(x, root, 0.5 / F.nullif(root, F.lit(0.0)))


def sin(x: Column) -> Column:
    return propagated(x, F.sin(x["value"]), F.cos(x["value"]))


def cos(x: Column) -> Column:
    return propagated(x, F.cos(x["value"]), F.sin(x["value"]))


def exp(x: Column) -> Column:
    return propagated(x, F.exp(x["value"]), F.exp(x["value"]))


def log(x: Column) -> Column:
    return propagated(x, F.log(x["value"]), 1 / F.nullif(x["value"], F.lit(0.0)))


def log10(x: Column) -> Column:
    return propagated(x, F.log10(x["value"]), 1 / (math.log(10) * F.nullif(x["value"], F.lit(0.0))))


def absolute(x: Column) -> Column:
    return uncertain(F.abs(x["value"]), x["uncertainty"])


def is_finite(x: Column) -> Column:
    return finite(x["value"]) & finite(x["uncertainty"])


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
