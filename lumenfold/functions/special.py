"""Special functions and the analytic false-alarm probability, on NumPy and math alone."""

from __future__ import annotations

import math

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1.0 - front * total
    b, c = x + 1 - a, 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, dof: float) -> float:
    return gamma_sf(dof / 2, x / 2)


def baluev_fap(z, t: np.ndarray, w: np.ndarray, fmax: float):
    """False-alarm probability of normalised power ``z`` (Baluev 2008); NaN for fewer than four points."""
    n = len(t)
    z = np.asarray(z, dtype=float)
    if n < 4:
        return np.full(z.shape, np.nan)
    nh, nk = n - 1, n - 3
    mean = np.sum(w * t) / np.sum(w)
    width = fmax * math.sqrt(4 * math.pi * np.sum(w * (t - mean) ** 2) / np.sum(w))
    gamma = math.sqrt(2 / nh) * math.exp(math.lgamma(nh / 2) - math.lgamma((nh - 1) / 2))
    z = np.clip(z, 0, 1)
    tau = gamma * width * (1 - z) ** ((nk - 1) / 2) * np.sqrt(nh * z / 2)
    return -np.expm1(-tau) + (1 - z) ** (nk / 2) * np.exp(-tau)
