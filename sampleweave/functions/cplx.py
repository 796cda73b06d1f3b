"""Complex numbers as structs of re and im."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def complex_(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def real(z: Column) -> Column:
    return z["re"]


def imag(z: Column) -> Column:
    return z["im"]


def magnitude(z: Column) -> Column:
    return F.hypot(z["re"], z["im"])


def arg(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def conj(z: Column) -> Column:
    return complex_(z["re"], -z["im"])


def add(a: Column, b: Column) -> Column:
    return complex_(a["re"] + b["re"], a["im"] + b["im"])


def sub(a: Column, b: Column) -> Column:
    return complex_(a["re"] - b["re"], a["im"] - b["im"])


def mul(a: Column, b: Column) -> Column:
    return complex_(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def div(a: Column, b: Column) -> Column:
    """Not a number in both parts where b is zero."""
    size = b["re"] * b["re"] + b["im"] * b["im"]
    over = F.when(size != 0, 1 / F.nullif(size, F.lit(0.0))).otherwise(F.lit(float("nan")))
    product = mul(a, conj(b))
    return complex_(product["re"] * over, product["im"] * over)


def polar(size: Column, phase: Column) -> Column:
    return complex_(size * F.cos(phase), size * F.sin(phase))
