"""Whether amplitudes and phases of a multi-sine model are the same in all subsets of an object's points.

Frequencies are held. In mode ``both`` the model is linear in a cosine and a sine a
(component, subset), and its solution starts the other modes: ``amplitude`` (phases
common) and ``phase`` (amplitudes common), which Gauss-Newton steps finish in
amplitudes and phases. The joint covariance of these, not of single fits, gives errors
and the Wald statistic that all subsets agree; it includes the constant(s), and is
scaled by the mean square that the fit leaves.

Defined results: each object gives a row per (component, subset) and one per component
with subset null that holds the test, the common values and the difference of the
criterion from the common model (frequencies held in both). Subsets with under
``min_points`` points, and objects with under two subsets or too few points, give one
row with the reason. Rows with a null subset take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, spread
from .tracking import wald

MODES = ("both", "amplitude", "phase")
NUMBERS = ("mid", "frequency", "amplitude", "amplitude_error", "phase", "phase_error", "amplitude_statistic", "amplitude_p", "phase_statistic", "phase_p", "delta_bic")
ROWS = "object_id string, component long, subset string, n long, reason string, " + ", ".join(f"{c} double" for c in NUMBERS)


def _unpack(q: np.ndarray, k: int, g: int, mode: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(constants, amplitudes, phases) as (k, g) arrays from the vector of parameters."""
    n_a, n_p = k * (1 if mode in ("phase", "none") else g), k * (1 if mode in ("amplitude", "none") else g)
    c = q[: len(q) - n_a - n_p]
    a, p = q[len(c) : len(c) + n_a].reshape(k, -1), q[len(c) + n_a :].reshape(k, -1)
    return c, np.broadcast_to(a, (k, g)), np.broadcast_to(p, (k, g))


def _slopes(t: np.ndarray, f: np.ndarray, group: np.ndarray, g: int, q: np.ndarray, mode: str, offsets: bool) -> tuple[np.ndarray, np.ndarray]:
    """Model and its derivatives by the parameters."""
    k = len(f)
    c, a, p = _unpack(q, k, g, mode)
    mask = group[:, None] == np.arange(g)
    model, cols_a, cols_p = (c[group] if offsets else np.full(len(t), c[0])), [], []
    for i in range(k):
        th = 2 * np.pi * f[i] * t + p[i][group]
        s, d = np.sin(th), a[i][group] * np.cos(th)
        model = model + a[i][group] * s
        cols_a += [s] if mode in ("phase", "none") else list((s[:, None] * mask).T)
        cols_p += [d] if mode in ("amplitude", "none") else list((d[:, None] * mask).T)
    return model, np.column_stack([*(mask.T.astype(float) if offsets else [np.ones(len(t))]), *cols_a, *cols_p])


def fit(t: np.ndarray, y: np.ndarray, w: np.ndarray, f: np.ndarray, group: np.ndarray, mode: str, offsets: bool = False) -> tuple[np.ndarray, float, np.ndarray]:
    """(parameters, weighted sum of squares, covariance for unit weight): constants, then amplitudes, then phases."""
    if mode not in (*MODES, "none"):
        raise ValueError(f"unknown mode {mode!r}; there are {', '.join(MODES)}")
    k, g, r = len(f), int(group.max()) + 1, np.sqrt(w)
    each = group if mode != "none" else np.zeros(len(t), dtype=np.int64)
    m = int(each.max()) + 1
    mask = each[:, None] == np.arange(m)
    lead = (group[:, None] == np.arange(g)).astype(float) if offsets else np.ones((len(t), 1))
    waves = [fn(2 * np.pi * x * t)[:, None] * mask for x in f for fn in (np.sin, np.cos)]
    beta = np.linalg.lstsq(np.column_stack([lead, *waves]) * r[:, None], y * r, rcond=None)[0]
    z = beta[lead.shape[1] :].reshape(k, 2, m)
    a, p = np.hypot(z[:, 0], z[:, 1]), np.arctan2(z[:, 1], z[:, 0])
    weight = np.bincount(each, w, m)
    if mode == "amplitude":  # the phase of the weighted sum, amplitudes along it
        p0 = np.angle((a * np.exp(1j * p)) @ weight)
        a, p = a * np.cos(p - p0[:, None]), p0[:, None]
    elif mode == "phase":
        a = (a @ weight / weight.sum())[:, None]
    q, damping = np.concatenate([beta[: lead.shape[1]], a.ravel(), p.ravel()]), 1e-6
    model, j = _slopes(t, f, group, g, q, mode, offsets)
    chi = float(np.sum(w * (y - model) ** 2))
    for _ in range(100):
        h = (j * w[:, None]).T @ j
        step = np.linalg.lstsq(h + damping * np.diag(np.maximum(np.diag(h), 1e-12)), j.T @ (w * (y - model)), rcond=None)[0]
        new, slopes = _slopes(t, f, group, g, q + step, mode, offsets)
        value = float(np.sum(w * (y - new) ** 2))
        if value <= chi:
            done = chi - value <= 1e-13 * max(chi, 1e-300)
            q, model, j, chi, damping = q + step, new, slopes, value, damping / 10
            if done:
                break
        else:
            damping = max(damping, 1e-9) * 10
            if damping > 1e10:
                break
    h = (j * w[:, None]).T @ j
    unit = np.sqrt(np.maximum(np.diag(h), 1e-300))
    return q, chi, np.linalg.pinv(h / np.outer(unit, unit)) / np.outer(unit, unit)


def compute(t: np.ndarray, y: np.ndarray, w: np.ndarray, f: np.ndarray, group: np.ndarray, mode: str = "both", offsets: bool = False) -> dict:
    """Values, errors and tests: arrays (component, subset) ``amplitude``, ``phase`` and their errors, per component the statistics, and ``delta_bic``."""
    k, g, n = len(f), int(group.max()) + 1, len(t)
    q, chi, cov = fit(t, y, w, f, group, mode, offsets)
    common, chi0, _ = fit(t, y, w, f, group, "none", offsets)
    m, c = len(q), g if offsets else 1
    cov = cov * chi / max(1, n - m)
    n_a = k * (1 if mode == "phase" else g)
    _, a, p = _unpack(q, k, g, mode)
    _, sa, sp = _unpack(np.sqrt(np.maximum(np.diag(cov), 0)), k, g, mode)
    out = {"amplitude": a, "phase": (p + np.pi) % (2 * np.pi) - np.pi, "amplitude_error": sa if mode != "phase" else np.full((k, g), np.nan), "phase_error": sp if mode != "amplitude" else np.full((k, g), np.nan)}
    for name, varies, first, values in (("amplitude", mode != "phase", c, a), ("phase", mode != "amplitude", c + n_a, p)):
        tests = [wald(values[i], cov[(s := slice(first + i * g, first + i * g + g)), s], circular=name == "phase") if varies and g > 1 else (math.nan, math.nan) for i in range(k)]
        out |= {f"{name}_statistic": np.array([x for x, _ in tests]), f"{name}_p": np.array([x for _, x in tests])}
    bic = lambda x, m: n * math.log(max(x, 1e-300) / n) + m * math.log(n)
    _, a0, p0 = _unpack(common, k, g, "none")
    return out | {"common_amplitude": np.abs(a0[:, 0]), "common_phase": (p0[:, 0] + np.pi) % (2 * np.pi) - np.pi, "delta_bic": bic(chi, m) - bic(chi0, len(common))}


def subset_variation(obs: DataFrame, components: DataFrame, subset: str = "band", mode: str = "both", offsets: bool = False, min_points: int = 5) -> DataFrame:
    """ROWS for each object: ``components`` has object_id, component and f; ``subset`` is a column of ``obs``."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; there are {', '.join(MODES)}")
    columns = [c.split()[0] for c in ROWS.split(", ")]
    held = components.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct(F.col("component").cast("long").alias("component"), F.col("f").cast("double").alias("f")))).alias("held"))
    joined = obs.select("object_id", "t", "y", "dy", "rid", F.col(subset).cast("string").alias("subset")).where("subset IS NOT NULL").join(held, "object_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "rid"])
        key, held = pdf["object_id"].iloc[0], pdf["held"].iloc[0]
        t, y, dy = kernels._points(pdf)
        names, group = np.unique(pdf["subset"].to_numpy(dtype=str), return_inverse=True)
        f, ids = np.array([r["f"] for r in held], dtype=float), [int(r["component"]) for r in held]
        sizes = np.bincount(group)
        reason = "under two subsets" if len(names) < 2 else f"a subset has under {min_points} points" if sizes.min() < min_points else "too few points" if len(t) < len(names) * (1 + 2 * len(f)) + 2 else None
        blank = dict.fromkeys(columns)
        if reason:
            rows = [blank | {"object_id": key, "n": len(t), "reason": reason}]
        else:
            w = kernels._weights(dy, len(t)) * len(t)
            origin = t.mean()
            r = compute(t - origin, y, w, f, group, mode, offsets)
            rows = [
                blank | {"object_id": key, "component": ids[i], "subset": str(names[j]), "n": int(sizes[j]), "mid": float(t[group == j].mean()), "frequency": f[i], **{c: float(r[c][i, j]) for c in ("amplitude", "amplitude_error", "phase", "phase_error")}}
                for i in range(len(f)) for j in range(len(names))
            ]
            rows += [blank | {"object_id": key, "component": ids[i], "n": len(t), "mid": float(origin), "frequency": f[i], "amplitude": r["common_amplitude"][i], "phase": r["common_phase"][i], **{c: float(r[c][i]) for c in ("amplitude_statistic", "amplitude_p", "phase_statistic", "phase_p")}, "delta_bic": r["delta_bic"]} for i in range(len(f))]
        out = pd.DataFrame(rows, columns=columns)
        return out.astype({"component": "Int64", "n": "int64", **{c: "float64" for c in NUMBERS}})

    out = spread.deal_objects(joined, obs).groupBy("object_id").applyInPandas(run, ROWS)
    return out.select([F.when(~F.isnan(c), F.col(c)).alias(c) if c in NUMBERS else F.col(c) for c in columns])
