"""Filter design with numpy: analog prototypes, band transforms, bilinear mapping, windowed sinc, resonators, responses."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sampleweave.functions import windows

Coefficients = tuple[np.ndarray, np.ndarray]


def prototype(method: str, order: int, ripple: float = 0.1, stop: float = 40.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of the analog low-pass with its edge at 1 rad/s."""
    k = np.arange(1, order + 1)
    angle = math.pi * (2 * k - 1) / (2 * order)
    if method == "BUTTERWORTH":
        return np.empty(0), 1j * np.exp(1j * angle), 1.0
    if method == "CHEBYSHEV1":
        eps = math.sqrt(10 ** (ripple / 10) - 1)
        mu = math.asinh(1 / eps) / order
        poles = -math.sinh(mu) * np.sin(angle) + 1j * math.cosh(mu) * np.cos(angle)
        gain = np.prod(-poles).real / (math.sqrt(1 + eps * eps) if order % 2 == 0 else 1.0)
        return np.empty(0), poles, gain
    if method == "CHEBYSHEV2":
        eps = 1 / math.sqrt(10 ** (stop / 10) - 1)
        mu = math.asinh(1 / eps) / order
        poles = 1 / (-math.sinh(mu) * np.sin(angle) + 1j * math.cosh(mu) * np.cos(angle))
        at = np.cos(angle)
        zeros = 1j / at[np.abs(at) > 1e-12]
        return zeros, poles, float((np.prod(-poles) / np.prod(-zeros)).real)
    if method == "BESSEL":
        reverse = [math.factorial(2 * order - j) / (2 ** (order - j) * math.factorial(j) * math.factorial(order - j)) for j in range(order + 1)]
        poles = np.roots(reverse[::-1])
        lo, hi = 0.0, 10.0 * order  # scaled to 3 dB at 1 rad/s
        for _ in range(80):
            mid = (lo + hi) / 2
            level = abs(reverse[0] / np.polyval(reverse[::-1], 1j * mid))
            lo, hi = (mid, hi) if level > math.sqrt(0.5) else (lo, mid)
        poles = poles / lo
        return np.empty(0), poles, float(np.prod(-poles).real)
    raise ValueError(f"unknown method {method}")


def transformed(zpk: tuple, response: str, low: float, high: float) -> tuple:
    """Of a low-pass at 1 rad/s: the same as a low-, high-, band-pass or band-stop between edges in rad/s."""
    z, p, k = zpk
    extra = len(p) - len(z)
    if response == "LOWPASS":
        return z * low, p * low, k * low**extra
    if response == "HIGHPASS":
        gain = k * (np.prod(-z) / np.prod(-p)).real
        return np.concatenate([low / z, np.zeros(extra)]), low / p, gain
    width, centre = high - low, math.sqrt(low * high)

    def pairs(v: np.ndarray) -> np.ndarray:
        half = v * width / 2 if response == "BANDPASS" else width / 2 / v
        root = np.sqrt(half * half - centre * centre + 0j)
        return np.concatenate([half + root, half - root])

    if response == "BANDPASS":
        return np.concatenate([pairs(z), np.zeros(extra)]), pairs(p), k * width**extra
    if response == "BANDSTOP":
        gain = k * (np.prod(-z) / np.prod(-p)).real
        return np.concatenate([pairs(z), np.tile([1j * centre, -1j * centre], extra)]), pairs(p), gain
    raise ValueError(f"unknown response {response}")


def iir_design(response: str = "LOWPASS", order: int = 3, f_low: float = 0.1, f_high: float = 0.2, sample_rate: float = 1.0, method: str = "BUTTERWORTH", ripple: float = 0.1, stop: float = 40.0) -> Coefficients:
    """Digital coefficients (b, a) by the bilinear transform with warped edges. HIGHPASS takes f_low as its edge, LOWPASS f_low, too."""
    warp = lambda f: 2 * sample_rate * math.tan(math.pi * f / sample_rate)
    z, p, k = transformed(prototype(method, order, ripple, stop), response, warp(f_low), warp(max(f_high, f_low)))
    c = 2 * sample_rate
    gain = k * (np.prod(c - z) / np.prod(c - p)).real
    z = np.concatenate([(c + z) / (c - z), -np.ones(len(p) - len(z))])
    p = (c + p) / (c - p)
    return gain * np.real(np.poly(z)), np.real(np.poly(p))


def fir_design(response: str = "LOWPASS", f_low: float = 0.1, f_high: float = 0.2, sample_rate: float = 1.0, taps: int | None = None, window: str = "Kaiser", attenuation: float = 40.0) -> Coefficients:
    """Windowed sinc with unit gain in the pass band; without taps their number follows Kaiser's estimate."""
    beta = 0.1102 * (attenuation - 8.7) if attenuation > 50 else 0.5842 * (attenuation - 21) ** 0.4 + 0.07886 * (attenuation - 21) if attenuation > 21 else 0.0
    if taps is None:
        width = 2 * math.pi * (max(f_high - f_low, 0.1 * f_low) if response in ("LOWPASS", "HIGHPASS") else 0.25 * f_low) / sample_rate
        taps = int(math.ceil((attenuation - 7.95) / (2.285 * width))) + 1
    taps += 1 - taps % 2
    n = np.arange(taps) - taps // 2

    def sinc(f: float) -> np.ndarray:
        return 2 * f / sample_rate * np.sinc(2 * f / sample_rate * n)

    delta = (n == 0).astype(float)
    h = {"LOWPASS": lambda: sinc(f_low), "HIGHPASS": lambda: delta - sinc(f_low), "BANDPASS": lambda: sinc(f_high) - sinc(f_low), "BANDSTOP": lambda: delta - sinc(f_high) + sinc(f_low)}[response]()
    h = h * windows.values(window, taps, beta if window == "Kaiser" else 1.6)
    at = {"LOWPASS": 0.0, "BANDSTOP": 0.0, "HIGHPASS": sample_rate / 2, "BANDPASS": math.sqrt(f_low * f_high)}[response]
    return h / abs(response_at((h, np.ones(1)), at, sample_rate)), np.ones(1)


def resonator(f0: float, sample_rate: float, damping: float | None = None, q: float | None = None) -> Coefficients:
    """A second-order resonance at f0 with unit gain there, of a given damping ratio or quality."""
    d = damping if damping is not None else 1 / (2 * (q or 1.0))
    w = 2 * math.pi * f0 / sample_rate
    r = math.exp(-d * w)
    a = np.array([1.0, -2 * r * math.cos(w * math.sqrt(max(0.0, 1 - d * d))), r * r])
    b = np.array([1.0, 0.0, -1.0])
    return b / abs(response_at((b, a), f0, sample_rate)), a


def response_at(coefficients: Coefficients, f: float | np.ndarray, sample_rate: float = 1.0) -> complex | np.ndarray:
    b, a = coefficients
    z = np.exp(-2j * np.pi * np.asarray(f) / sample_rate)
    return np.polyval(b[::-1], z) / np.polyval(a[::-1], z)


def response_columns(coefficients: Coefficients, f: Column, sample_rate: float = 1.0) -> dict[str, Column]:
    """magnitude, db, phase and degrees over a column of frequencies."""
    w = f * F.lit(2 * math.pi / sample_rate)
    part = lambda c, g: reduce(lambda s, t: s + t, [F.lit(float(x)) * g(w * k) for k, x in enumerate(c)])
    (b, a) = coefficients
    br, bi, ar, ai = part(b, F.cos), -part(b, F.sin), part(a, F.cos), -part(a, F.sin)
    size = ar * ar + ai * ai
    re, im = (br * ar + bi * ai) / size, (bi * ar - br * ai) / size
    m, phase = F.hypot(re, im), F.atan2(im, re)
    return {"magnitude": m, "db": 20 * F.log10(m), "phase": phase, "degrees": F.degrees(phase)}


def uncertain_filter(b: np.ndarray, a: np.ndarray, value: np.ndarray, spread: np.ndarray, length: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """A filter over values with uncertainties: variances pass through the squares of its impulse response."""
    from sampleweave.operators.recursive import Recursion

    n = min(length, len(value))
    response = Recursion(b, a).run(np.eye(1, n)[0])[0]
    variance = np.convolve(np.asarray(spread, float) ** 2, response**2)[: len(value)]
    return Recursion(b, a).run(np.asarray(value, float))[0], np.sqrt(variance)
