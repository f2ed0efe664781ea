"""Iterative extraction of sinusoids: one grouped call per object, the loop inside it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from . import grids, kernels, spread

#: Frequencies from which a joint step costs more than steps of one at a time.
CYCLIC_FROM = 30
SWEEPS = 12
#: How far refinement may move a frequency, in widths 1/T.
BOUND_WIDTHS = 1.0
#: Floor of the automatic highest frequency, samples a peak, and multiple of the pseudo-Nyquist frequency.
FLOOR, SAMPLES, FACTOR = 50.0, 10.0, 5.0

COMPONENTS = "object_id string, rank long, frequency double, frequency_error double, amplitude double, amplitude_error double, phase double, phase_error double, snr double, fap double, delta_bic double, status string"


def _design(t: np.ndarray, f: np.ndarray) -> np.ndarray:
    th = 2 * np.pi * t[:, None] * f[None, :]
    return np.column_stack([np.ones(len(t)), np.cos(th), np.sin(th)])


def linear_fit(t: np.ndarray, y: np.ndarray, w: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, float]:
    """Offset, cosine and sine amplitudes at fixed frequencies, and the weighted sum of squares left."""
    r = np.sqrt(w)
    beta, *_ = np.linalg.lstsq(_design(t, f) * r[:, None], y * r, rcond=None)
    return beta, float(np.sum(w * (y - _design(t, f) @ beta) ** 2))


def cyclic_refine(t: np.ndarray, y: np.ndarray, w: np.ndarray, f: np.ndarray, bound: float = np.inf, sweeps: int = 3, only: list[int] | None = None) -> np.ndarray:
    """Frequencies refined one after the other against what the others leave, each within ``bound`` of its start.

    A sweep solves all amplitudes together once and then takes a few damped steps a frequency, so its cost grows with
    points times components, where steps of all frequencies at once grow with the square. The sum of squares never rises.
    """
    f, start, r = f.astype(float).copy(), f.astype(float), np.sqrt(w)

    def alone(x: float, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        th = 2 * np.pi * x * t
        cols = np.column_stack([np.cos(th), np.sin(th)])
        b = np.linalg.lstsq(cols * r[:, None], target * r, rcond=None)[0]
        return cols, b, float(np.sum(w * (target - cols @ b) ** 2))

    for _ in range(max(1, sweeps)):
        beta, _ = linear_fit(t, y, w, f)
        k, before = len(f), f.copy()
        left = y - _design(t, f) @ beta
        for i in range(k) if only is None else only:
            cols, b = np.column_stack([np.cos(2 * np.pi * f[i] * t), np.sin(2 * np.pi * f[i] * t)]), beta[[1 + i, 1 + k + i]]
            target = left + cols @ b
            cols, b, rss = alone(f[i], target)
            damping = 1e-3
            for _ in range(20):
                slope = 2 * np.pi * t * (-b[0] * cols[:, 1] + b[1] * cols[:, 0])
                j = np.column_stack([cols, slope]) * r[:, None]
                h = j.T @ j
                step = np.linalg.lstsq(h + damping * np.diag(np.maximum(np.diag(h), 1e-12)), j.T @ ((target - cols @ b) * r), rcond=None)[0][2]
                trial = float(np.clip(f[i] + step, start[i] - bound, start[i] + bound))
                new = alone(trial, target)
                if new[2] < rss:
                    done = rss - new[2] <= 1e-12 * rss
                    f[i], (cols, b, rss), damping = trial, new, damping / 5
                    if done:
                        break
                else:
                    damping *= 8
                    if damping > 1e6:
                        break
            left = target - cols @ b
        if np.all(np.abs(f - before) <= 1e-13 * np.maximum(np.abs(f), 1e-300)):
            break
    return f


def multi_sine(t: np.ndarray, y: np.ndarray, w: np.ndarray, f: np.ndarray, rounds: int = 50, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """All frequencies, amplitudes and phases by damped least squares: f, beta, covariance, sum of squares.

    No frequency leaves ``bound`` about its start. From ``CYCLIC_FROM`` frequencies on they are refined one after the other.
    """
    start = f = f.astype(float).copy()
    if len(f) >= CYCLIC_FROM:
        f, rounds = cyclic_refine(t, y, w, f, bound, SWEEPS), 0
    beta, rss = linear_fit(t, y, w, f)
    k, damping, r = len(f), 1e-3, np.sqrt(w)
    for _ in range(rounds):
        th = 2 * np.pi * t[:, None] * f[None, :]
        a, b = beta[1 : k + 1], beta[k + 1 :]
        slope = 2 * np.pi * t[:, None] * (-a * np.sin(th) + b * np.cos(th))
        j = np.column_stack([_design(t, f), slope]) * r[:, None]
        e = (y - _design(t, f) @ beta) * r
        h, g = j.T @ j, j.T @ e
        step = np.linalg.lstsq(h + damping * np.diag(np.maximum(np.diag(h), 1e-12)), g, rcond=None)[0]
        trial = np.clip(f + step[2 * k + 1 :], start - bound, start + bound)
        fit, new = linear_fit(t, y, w, trial)
        if new <= rss:
            done = rss - new <= 1e-12 * max(rss, 1e-300)
            f, beta, rss, damping = trial, fit, new, damping / 5
            if done:
                break
        else:
            damping *= 8
            if damping > 1e10:
                break
    th = 2 * np.pi * t[:, None] * f[None, :]
    slope = 2 * np.pi * t[:, None] * (-beta[1 : k + 1] * np.sin(th) + beta[k + 1 :] * np.cos(th))
    j = np.column_stack([_design(t, f), slope]) * r[:, None]
    dof = max(len(t) - j.shape[1], 1)
    return f, beta, np.linalg.pinv(j.T @ j) * rss / dof, rss


def default_grid(obs: DataFrame, factor: float = FACTOR, samples: float = SAMPLES, fmax: float | None = None) -> DataFrame:
    """object_id, f0, df, nf and fmax for pre-whitening: from 1/T to ``factor`` times the pseudo-Nyquist frequency of the gaps, 50 cycles per day at least, and no further than the Nyquist frequency of a lattice; or to ``fmax``."""
    if fmax is None:
        return grids.fold_grid(obs, samples, factor, FLOOR, stop_at_nyquist=True)
    return grids.gls_grid(obs, samples, fmax=fmax)


def extract(t: np.ndarray, y: np.ndarray, dy: np.ndarray | None, fmax: float, limit: int = 10, min_snr: float = 4.0, max_fap: float = 1e-3, min_gain: float = 10.0) -> list[tuple]:
    """Components in order of extraction; stops at the first that fails S/N, false-alarm probability or BIC."""
    tau = t - t.mean()
    n, span = len(t), t.max() - t.min()
    if n < 6 or span <= 0 or np.ptp(y) == 0:
        return []
    w = kernels._weights(dy, n) * n
    grid = kernels.frequency_grid(span, fmax, SAMPLES) if fmax > 1 / span else np.zeros(0)
    if not len(grid):
        return []
    engine = kernels.LombScargle(tau, dy, grid)
    f = np.zeros(0)
    rest, rss, bic = y - np.sum(w * y) / w.sum(), None, None
    rss = float(np.sum(w * rest**2))
    bic = n * math.log(rss / n) + math.log(n)
    found: list[tuple] = []
    while len(f) < limit and n > 3 * (len(f) + 1) + 1:
        power = engine.power(rest)
        k = int(np.argmax(power))
        new_f, beta, cov, new_rss = multi_sine(tau, y, w, np.append(f, grid[k]), bound=BOUND_WIDTHS / span)
        new_bic = n * math.log(max(new_rss, 1e-300) / n) + (3 * len(new_f) + 1) * math.log(n)
        m = len(new_f)
        amp = math.hypot(beta[m], beta[2 * m])
        left = y - _design(tau, new_f) @ beta
        near = grid[np.abs(grid - new_f[-1]) <= max(1.0, 12.5 / span)]
        noise = np.mean(2 * np.abs(kernels._trig_sums(tau, (w * left)[None, :], near)[0])) / w.sum()
        snr = amp / noise if noise > 0 else math.inf
        fap = float(special.baluev_fap(power[k], t, w, fmax))
        if not (snr >= min_snr and fap <= max_fap and new_bic - bic <= -min_gain and 0 < new_f[-1] <= fmax * 1.1):
            break
        found.append((snr, fap, new_bic - bic))
        f, rss, bic, rest = new_f, new_rss, new_bic, left
    if not len(f):
        return []
    f, beta, cov, _ = multi_sine(tau, y, w, f, bound=BOUND_WIDTHS / span)
    k, rows = len(f), []
    for i in range(k):
        a, b = beta[1 + i], beta[1 + k + i]
        amp = math.hypot(a, b)
        va, vb, vab = cov[1 + i, 1 + i], cov[1 + k + i, 1 + k + i], cov[1 + i, 1 + k + i]
        ea = math.sqrt(max(a * a * va + b * b * vb + 2 * a * b * vab, 0)) / amp
        ep = math.sqrt(max(b * b * va + a * a * vb - 2 * a * b * vab, 0)) / amp**2
        rows.append((i + 1, f[i], math.sqrt(max(cov[1 + 2 * k + i, 1 + 2 * k + i], 0)), amp, ea, math.atan2(a, b), ep, *found[i], "ok"))
    return rows


def prewhiten(obs: DataFrame, fmax: float | None = None, limit: int = 10, grid: DataFrame | None = None, **settings) -> DataFrame:
    """Component rows of each object; an object without any gives one row with rank 0.

    Each object is searched up to ``fmax``, or to where ``grid`` (as ``default_grid`` makes it, the default) ends for it;
    an object without a grid has no component.
    """
    columns = [c.split()[0] for c in COMPONENTS.split(", ")]
    if fmax is None:
        top = (default_grid(obs) if grid is None else grid).select("object_id", (F.col("f0") + F.col("df") * (F.col("nf") - 1)).alias("_top"))
        obs = obs.join(top, "object_id", "left")
    else:
        obs = obs.withColumn("_top", F.lit(float(fmax)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, y, dy = kernels._points(pdf)
        top = float(pdf["_top"].iloc[0])
        rows = extract(t, y, dy, top, limit, **settings) if len(t) and np.isfinite(top) else []
        return pd.DataFrame([(pdf["object_id"].iloc[0], *r) for r in rows or [(0, *[math.nan] * 9, "no component")]], columns=columns)

    return spread.deal_objects(obs).groupBy("object_id").applyInPandas(run, COMPONENTS)
