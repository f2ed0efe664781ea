"""Search for a period and its drift with any statistic: re-timed copies of one curve on one frequency window.

A copy's times are bent so that a period with that relative rate stays constant. Rates
lie ``4 / (samples * f T^2 h)`` apart, with h how much sharper than a sinusoid the
statistic sees (harmonics, half the phase bins), so that no drift between two rates
blurs a feature. Lomb-Scargle copies share nothing but the window; all run in one
call per object, and a copy is dropped where its bend would reverse time.

Defined results: objects of under 8 points, without a baseline, or without a seed give
one row with the reason and null numbers. Box and transit statistics are refused:
their trials carry durations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from . import kernels, readouts, spread

#: How much sharper than a sinusoid each statistic is, for its own default settings.
SHARPNESS = {"gls": 1.0, "mhaov": 3.0, "pdm": 5.0, "ce": 5.0, "sl": 5.0, "supersmoother": 5.0}
MODELS = ("constant", "exponential")
NUMBERS = ("f", "period", "rate", "pdot", "power", "steady_power", "rate_step", "correlation")
FOUND = "object_id string, reason string, n long, rates long, at_edge boolean, " + ", ".join(f"{c} double" for c in NUMBERS)


def sharpness(method: str, settings: dict) -> float:
    if method not in SHARPNESS:
        raise ValueError(f"no drift search with {method!r}; there are {', '.join(sorted(SHARPNESS))}")
    if method == "mhaov":
        return float(max(1, settings.get("harmonics", 3)))
    bins = settings.get("n_bins", settings.get("n_phase"))
    return SHARPNESS[method] if bins is None else max(1.0, bins / 2)


def bent(tau: np.ndarray, a: float, model: str = "constant") -> np.ndarray:
    """Times on which a period of relative rate ``a`` is constant."""
    if a == 0:
        return tau
    return np.log1p(a * tau) / a if model == "constant" else -np.expm1(-a * tau) / a


def power_rows(tau: np.ndarray, y: np.ndarray, dy: np.ndarray | None, f: np.ndarray, rates: np.ndarray, method: str = "gls", model: str = "constant", **settings) -> np.ndarray:
    """The statistic of each re-timed copy (row) at each frequency; copies start at zero for their kernel, as folding needs only differences of times."""
    kernel = kernels.get_method(method, **settings)
    out = np.empty((len(rates), len(f)))
    for i, a in enumerate(rates):
        copy = bent(tau, a, model)
        out[i] = kernel(copy - copy[0], y, dy, f, **settings)
    return out


def _vertex(lo: float, mid: float, hi: float) -> float:
    bend = lo - 2 * mid + hi
    return float(np.clip(0.5 * (lo - hi) / bend, -1, 1)) if bend < 0 else 0.0


def search(t: np.ndarray, y: np.ndarray, dy: np.ndarray | None, seed: float, method: str = "gls", n_rates: int = 12, model: str = "constant", reach: float = 30.0, samples: float = 10.0, **settings) -> dict:
    """Best frequency and rate about a seed frequency: a dict of FOUND's columns, and ``grid``, ``axis`` and ``surface``."""
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; there are {', '.join(MODELS)}")
    sharp = sharpness(method, settings)
    out = dict.fromkeys(NUMBERS, math.nan) | {"reason": None, "n": len(t), "rates": 0, "at_edge": False, "grid": np.zeros(0), "axis": np.zeros(0), "surface": np.zeros((0, 0))}
    span = float(t[-1] - t[0]) if len(t) else 0.0
    if len(t) < 8:
        return out | {"reason": "under 8 points"}
    if span <= 0:
        return out | {"reason": "no time baseline"}
    if not (np.isfinite(seed) and seed > 0):
        return out | {"reason": "no seed period"}
    tau = t - np.sum(kernels._weights(dy, len(t)) * t)
    f0, df, nf = readouts.frequency_window(seed, span, reach, samples)
    f = f0 + df * np.arange(nf)
    axis = np.array(readouts.drift_rates(n_rates, seed, span, harmonics=sharp))
    axis = axis[(1 + axis * tau.min() > 0.05) & (1 + axis * tau.max() > 0.05)] if model == "constant" else axis
    power = power_rows(tau, y, dy, f, axis, method, model, **settings)
    good = np.round(np.where(np.isfinite(power), -power if method in kernels.MINIMISED else power, -np.inf), 9)
    # of equal cells the one of the least drift, then the lowest frequency
    order = np.argsort(np.abs(axis), kind="stable")
    i, k = np.unravel_index(int(np.argmax(good[order])), good.shape)
    i = int(order[i])
    best_f, best_a, correlation = float(f[k]), float(axis[i]), math.nan
    edge = k in (0, nf - 1) or (len(axis) > 1 and i in (0, len(axis) - 1))
    if 0 < k < nf - 1 and 0 < i < len(axis) - 1:
        p = good[i - 1 : i + 2, k - 1 : k + 2]
        best_f += _vertex(*p[1]) * df
        best_a += _vertex(*p[:, 1]) * float(axis[1] - axis[0])
        cff, caa, cfa = p[1, 0] - 2 * p[1, 1] + p[1, 2], p[0, 1] - 2 * p[1, 1] + p[2, 1], (p[0, 0] + p[2, 2] - p[0, 2] - p[2, 0]) / 4
        correlation = float(np.clip(cfa / math.sqrt(cff * caa), -1, 1)) if cff < 0 and caa < 0 else math.nan
    still = int(np.argmin(np.abs(axis)))
    steady = power[still].min() if method in kernels.MINIMISED else power[still].max()
    step = float(axis[1] - axis[0]) if len(axis) > 1 else math.nan
    out |= {"f": best_f, "period": 1 / best_f, "rate": best_a, "pdot": best_a / best_f, "power": float(power[i, k]), "steady_power": float(steady), "rate_step": step, "correlation": correlation}
    return out | {"rates": len(axis), "at_edge": bool(edge), "grid": f, "axis": axis, "surface": power}


def _seeded(obs: DataFrame, seeds: DataFrame) -> DataFrame:
    return spread.deal_objects(obs.join(seeds.select("object_id", F.col("f").cast("double").alias("_f")), "object_id", "left"), obs)


def rate_search(obs: DataFrame, seeds: DataFrame, method: str = "gls", n_rates: int = 12, model: str = "constant", reach: float = 30.0, samples: float = 10.0, **settings) -> DataFrame:
    """Best frequency and rate of each object about its seed (object_id, f); one row an object."""
    sharpness(method, settings)
    kernels.get_method(method, **settings)
    columns = [c.split()[0] for c in FOUND.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, y, dy = kernels._points(pdf)
        r = search(t, y, dy, float(pdf["_f"].iloc[0]), method, n_rates, model, reach, samples, **settings) | {"object_id": pdf["object_id"].iloc[0]}
        return pd.DataFrame([[r[c] for c in columns]], columns=columns).astype({"reason": object, "at_edge": bool})

    out = _seeded(obs, seeds).groupBy("object_id").applyInPandas(run, FOUND)
    return out.select([F.when(~F.isnan(c), F.col(c)).alias(c) if c in NUMBERS else F.col(c) for c in columns])


def surface(obs: DataFrame, seeds: DataFrame, method: str = "gls", n_rates: int = 12, model: str = "constant", reach: float = 30.0, samples: float = 10.0, **settings) -> DataFrame:
    """object_id, a_idx, k, rate, f and power: the whole search."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, y, dy = kernels._points(pdf)
        r = search(t, y, dy, float(pdf["_f"].iloc[0]), method, n_rates, model, reach, samples, **settings)
        i, k = np.indices(r["surface"].shape)
        return pd.DataFrame({"object_id": pdf["object_id"].iloc[0], "a_idx": i.ravel(), "k": k.ravel(), "rate": r["axis"][i.ravel()], "f": r["grid"][k.ravel()], "power": r["surface"].ravel()}).astype({"object_id": object})

    return _seeded(obs, seeds).groupBy("object_id").applyInPandas(run, "object_id string, a_idx long, k long, rate double, f double, power double")


def best_seed(t: np.ndarray, y: np.ndarray, dy: np.ndarray | None, factor: float = 5.0) -> float:
    """Frequency of the highest Lomb-Scargle peak on the usual grid, for curves without a seed."""
    span = float(t[-1] - t[0])
    f = kernels.frequency_grid(span, max(factor * 0.5 * len(t) / span, 2 / span))
    return float(f[int(np.argmax(kernels.gls(t - t[0], y, dy, f)))])


def chance(power: float, t: np.ndarray, dy: np.ndarray | None, fmax: float) -> float:
    return float(special.baluev_fap(power, t, kernels._weights(dy, len(t)), fmax))
