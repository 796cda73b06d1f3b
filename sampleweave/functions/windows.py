"""Apodisation windows by place k of n samples: as columns and as arrays. The denominator is n - 1."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The coefficients of the cosine-sum windows.
COSINES = {
    "None": (1.0,),
    "Rectangular": (1.0,),
    "Hamming": (0.53836, 0.46164),
    "Hann": (0.5, 0.5),
    "Blackman": (0.42, 0.5, 0.08),
    "Nuttall": (0.355768, 0.487396, 0.144232, 0.012604),
    "BlackmanHarris": (0.35875, 0.48829, 0.14128, 0.01168),
    "BlackmanNuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "FlatTop": (1.0, 1.93, 1.29, 0.388, 0.032),
}
NAMES = [*COSINES, "HannExp", "Exponential", "Kaiser"]


def column(name: str, k: Column, n: int, beta: float = 1.6) -> Column:
    """The window's value at place k; Kaiser's comes from a table of n literals."""
    if n < 2:
        return F.lit(1.0)
    if name in COSINES:
        u = 2 * math.pi / (n - 1) * k
        out = F.lit(COSINES[name][0])
        for i, a in enumerate(COSINES[name][1:], 1):
            out = out + (a if i % 2 == 0 else -a) * F.cos(i * u)
        return out
    return F.get(F.array(*(F.lit(float(x)) for x in values(name, n, beta))), k.cast("int"))


def values(name: str, n: int, beta: float = 1.6) -> np.ndarray:
    if n < 2:
        return np.ones(n)
    k = np.arange(n)
    if name in COSINES:
        u = 2 * np.pi * k / (n - 1)
        return sum((-1) ** i * a * np.cos(i * u) for i, a in enumerate(COSINES[name])) * np.ones(n)
    if name == "HannExp":
        return np.sin(2 * np.pi * k / (n - 1)) ** 2
    if name == "Exponential":
        return np.exp(k / (3.0 * n))
    if name == "Kaiser":
        return np.kaiser(n, beta)
    raise ValueError(f"unknown window {name}")
