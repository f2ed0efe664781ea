"""Multi-sine fits in frequencies, amplitudes and phases, each free, tied, fixed or bounded, with their joint covariance.

``constrained.fit`` solves amplitudes linearly, so they cannot be held one by one. Here
every parameter is one of its own: frequencies follow ties (``f = A p + c``), an
amplitude or phase may stand fixed, a frequency may have bounds. Damped Gauss-Newton
steps start at the linear solution; parameters that press against a bound are left out
of the covariance, as their errors mean nothing there.

Defined results: amplitudes are positive and phases in (-pi, pi] unless they are fixed;
the covariance is scaled by the mean square left; a model of more parameters than
points is refused.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, spread
from .constrained import Constraints


@dataclass(frozen=True)
class Held:
    """``amplitude`` and ``phase``: component -> fixed value; ``bounds``: component -> (lowest, highest frequency)."""

    amplitude: dict[int, float] = field(default_factory=dict)
    phase: dict[int, float] = field(default_factory=dict)
    bounds: dict[int, tuple[float, float]] = field(default_factory=dict)

    def validate(self, k: int) -> None:
        if wrong := {i for i in (*self.amplitude, *self.phase, *self.bounds) if not 0 <= i < k}:
            raise ValueError(f"no component {sorted(wrong)}")
        if bad := [i for i, (lo, hi) in self.bounds.items() if not lo < hi]:
            raise ValueError(f"bounds of {bad} are empty")


def fit(t: np.ndarray, y: np.ndarray, w: np.ndarray, f: np.ndarray, constraints: Constraints = Constraints(), held: Held = Held(), group: np.ndarray | None = None, rounds: int = 200) -> dict:
    """frequency, amplitude and phase of each component with their errors (nan: not free), offsets, rss, parameters, and names with covariance of the free parameters.

    The model is offset + sum of A sin(2 pi f t + phase). Bounds belong to untied, unfixed components. Subset variation is ``variation``'s.
    """
    k, n = len(f), len(t)
    constraints.validate(k)
    held.validate(k)
    if constraints.vary:
        raise ValueError("amplitudes and phases by subset are variation.fit's")
    if tied := set(held.bounds) & (set(constraints.ties) | constraints.fixed):
        raise ValueError(f"bounds of components that are not free: {sorted(tied)}")
    group = np.zeros(n, dtype=np.int64) if group is None or not constraints.offsets else group
    lead = (group[:, None] == np.unique(group)).astype(float)
    a_f, const, p = constraints.matrix(np.asarray(f, dtype=float))
    free = [i for i in range(k) if i not in constraints.ties and i not in constraints.fixed]
    c, m = lead.shape[1], len(free)
    lo, hi = np.full(c + m + 2 * k, -np.inf), np.full(c + m + 2 * k, np.inf)
    for j, i in enumerate(free):
        lo[c + j], hi[c + j] = held.bounds.get(i, (-np.inf, np.inf))
    names = [*(f"c{g}" for g in range(c)), *(f"f{i}" for i in free), *(f"a{i}" for i in range(k)), *(f"p{i}" for i in range(k))]
    moves = np.array([not (x[0] == "a" and int(x[1:]) in held.amplitude or x[0] == "p" and int(x[1:]) in held.phase) for x in names])
    if moves.sum() > n:
        raise ValueError(f"{int(moves.sum())} parameters for {n} points")
    # start: the linear solution at the first frequencies, then what is held
    now, r = a_f @ p + const, np.sqrt(w)
    th = 2 * np.pi * t[:, None] * now
    beta = np.linalg.lstsq(np.column_stack([lead, np.sin(th), np.cos(th)]) * r[:, None], y * r, rcond=None)[0]
    z = beta[c : c + k] + 1j * beta[c + k :]
    amplitude = np.array([held.amplitude.get(i, abs(z[i]) or 1e-12) for i in range(k)])
    phase = np.array([held.phase.get(i, math.atan2(z[i].imag, z[i].real)) for i in range(k)])
    q = np.clip(np.concatenate([beta[:c], p, amplitude, phase]), lo, hi)

    def model(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        now, a, ph = a_f @ q[c : c + m] + const, q[c + m : c + m + k], q[c + m + k :]
        th = 2 * np.pi * t[:, None] * now + ph
        s, d = np.sin(th), a * np.cos(th)
        return lead @ q[:c] + s @ a, np.column_stack([lead, (2 * np.pi * t[:, None] * d) @ a_f, s, d])

    value, j = model(q)
    rss, damping = float(np.sum(w * (y - value) ** 2)), 1e-4
    for _ in range(rounds):
        e, jj = (y - value) * r, j * r[:, None]
        g = jj.T @ e
        able = moves & ~((q <= lo) & (g < 0)) & ~((q >= hi) & (g > 0))
        h = jj[:, able].T @ jj[:, able]
        step = np.zeros(len(q))
        step[able] = np.linalg.lstsq(h + damping * np.diag(np.maximum(np.diag(h), 1e-12)), g[able], rcond=None)[0]
        trial = np.clip(q + step, lo, hi)
        new, slopes = model(trial)
        left = float(np.sum(w * (y - new) ** 2))
        if left <= rss:
            done = rss - left <= 1e-13 * max(rss, 1e-300)
            q, value, j, rss, damping = trial, new, slopes, left, damping / 6
            if done:
                break
        else:
            damping *= 8
            if damping > 1e12:
                break
    able = moves & (q > lo) & (q < hi)
    jj = j[:, able] * r[:, None]
    unit = np.sqrt(np.maximum((jj * jj).sum(0), 1e-300))
    cov = np.linalg.pinv((jj / unit).T @ (jj / unit)) / np.outer(unit, unit) * rss / max(1, n - int(moves.sum()))
    at = {x: i for i, x in enumerate(np.array(names)[able])}
    amplitude, phase = q[c + m : c + m + k].copy(), q[c + m + k :].copy()
    for i in range(k):
        if amplitude[i] < 0 and i not in held.amplitude and i not in held.phase:
            amplitude[i], phase[i] = -amplitude[i], phase[i] + np.pi
        if i not in held.phase:
            phase[i] = math.pi - (math.pi - phase[i]) % (2 * math.pi)
    sd = lambda x, i: math.sqrt(max(cov[at[f"{x}{i}"], at[f"{x}{i}"]], 0)) if f"{x}{i}" in at else math.nan
    rows = np.array([at.get(f"f{i}", -1) for i in free], dtype=int)
    spread_f = np.full(k, np.nan)
    if m and (rows >= 0).all():
        v = np.einsum("ij,jk,ik->i", a_f, cov[np.ix_(rows, rows)], a_f)
        spread_f = np.where(np.abs(a_f).sum(1) > 0, np.sqrt(np.maximum(v, 0)), np.nan)
    elif m:
        spread_f = np.array([sd("f", i) for i in range(k)])
    return {
        "frequency": a_f @ q[c : c + m] + const, "amplitude": amplitude, "phase": phase, "frequency_error": spread_f, "amplitude_error": np.array([sd("a", i) for i in range(k)]), "phase_error": np.array([sd("p", i) for i in range(k)]),
        "offsets": q[:c], "rss": rss, "parameters": int(moves.sum()), "names": list(at), "covariance": cov, "at_bound": [i for b, i in enumerate(free) if not lo[c + b] < q[c + b] < hi[c + b]],
    }


ROWS = "object_id string, component long, frequency double, frequency_error double, amplitude double, amplitude_error double, phase double, phase_error double, at_bound boolean, rss double, parameters long, bic double"


def fit_objects(obs: DataFrame, components: DataFrame, constraints: Constraints = Constraints(), held: Held = Held(), reach: float | None = 1.0, subset: str | None = None) -> DataFrame:
    """ROWS for each object with components (object_id, component from 0, f): untied frequencies stay within ``reach`` widths 1/T of their start unless ``held`` says otherwise (None: unbounded). ``subset``: column of the offsets. Objects of too few points or components that the constraints do not name have no row."""
    columns = [c.split()[0] for c in ROWS.split(", ")]
    listed = components.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct(F.col("component").cast("long").alias("component"), F.col("f").cast("double").alias("f")))).alias("held"))
    used = obs.select("object_id", "t", "y", "dy", "rid", (F.coalesce(F.col(subset).cast("string"), F.lit("")) if subset else F.lit("")).alias("subset")).join(listed, "object_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "rid"])
        t, y, dy = kernels._points(pdf)
        f = np.array([r["f"] for r in pdf["held"].iloc[0]], dtype=float)
        group, n, span = np.unique(pdf["subset"].to_numpy(dtype=str), return_inverse=True)[1], len(t), t[-1] - t[0] if len(t) else 0.0
        rows = []
        if span > 0 and n >= 3 * len(f) + len(np.unique(group)) + 2:
            w = kernels._weights(dy, n) * n
            own = held
            if reach is not None:
                near = {i: (x - reach / span, x + reach / span) for i, x in enumerate(f) if i not in constraints.ties and i not in constraints.fixed}
                own = Held(held.amplitude, held.phase, near | held.bounds)
            r = fit(t - t.mean(), y, w, f, constraints, own, group if subset else None)
            bic = n * math.log(max(r["rss"], 1e-300) / n) + r["parameters"] * math.log(n)
            rows = [[pdf["object_id"].iloc[0], i, *(r[c][i] for c in columns[2:8]), i in r["at_bound"], r["rss"], r["parameters"], bic] for i in range(len(f))]
        return pd.DataFrame(rows, columns=columns).astype({"object_id": object, "component": "int64", "parameters": "int64", "at_bound": bool})

    out = spread.deal_objects(used).groupBy("object_id").applyInPandas(run, ROWS)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns[2:8]})
