"""Period-change kernels that are no relational algebra: one grouped call per object.

Phase tracking, period profiles, non-linear period laws, cyclic (light-time)
searches, spacing chains and constancy tests.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import special
from . import spread
from .kernels import _points


#: Values of an intervals x trials x points array.
CHUNK = 1 << 16


def _basis(phase: np.ndarray, h: int) -> np.ndarray:
    return np.column_stack([np.ones(len(phase)), *(fn(2 * np.pi * k * phase) for k in range(1, h + 1) for fn in (np.cos, np.sin))])


def template(tau: np.ndarray, y: np.ndarray, f: float, most: int = 6) -> np.ndarray:
    """Harmonic coefficients of the mean curve, their number chosen by BIC."""
    n, best = len(y), None
    for h in range(1, most + 1):
        if n <= 2 * h + 2:
            break
        b = _basis(tau * f, h)
        beta, *_ = np.linalg.lstsq(b, y, rcond=None)
        score = n * math.log(max(np.mean((y - b @ beta) ** 2), 1e-300)) + (1 + 2 * h) * math.log(n)
        if best is None or score < best[0] - 1e-9:
            best = score, beta
    return best[1]


def phase_track(t: np.ndarray, y: np.ndarray, period: float, segments: int | None = None) -> list[tuple]:
    """(segment, n, mid time, delay, delay error): each segment's shift against the mean curve."""
    n, span = len(t), t[-1] - t[0]
    k = segments or int(max(4, min(n / 20, span / (3 * period), 20)))
    if n < 8 * 2 or k < 2:
        return []
    tau, f = t - t[0], 1 / period
    beta = template(tau, y, f)
    h = (len(beta) - 1) // 2
    edges = np.linspace(0, n, k + 1).astype(int)
    shifts = np.arange(max(128, 32 * h)) / max(128, 32 * h)
    out, last = [], 0.0
    for s, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if b - a < 4:
            continue
        ph, v = tau[a:b] * f, y[a:b]

        turn = 2 * np.pi * (ph[None, :] - shifts[:, None])
        model = beta[0] + sum(beta[2 * j - 1] * np.cos(j * turn) + beta[2 * j] * np.sin(j * turn) for j in range(1, h + 1))
        rest = v - model
        rest -= rest.mean(axis=1, keepdims=True)
        scan = (rest * rest).sum(axis=1)
        i = int(np.argmin(scan))
        lo, mid, hi = scan[i - 1], scan[i], scan[(i + 1) % len(scan)]
        bend = lo - 2 * mid + hi
        step = 1 / len(shifts)
        d = shifts[i] + (0.5 * (lo - hi) / bend * step if bend > 0 else 0.0)
        d = d + round(last - d)
        last = d
        scatter = mid / max(b - a - 2, 1)
        error = math.sqrt(max(2 * scatter * step * step / bend, 0)) if bend > 0 else math.nan
        out.append((s, int(b - a), float(t[a:b].mean()), d * period, error * period))
    return out


def _left_by_sinusoids(tau: np.ndarray, v: np.ndarray, grid: np.ndarray, harmonics: int) -> np.ndarray:
    """Sums of squares that a level and sinusoids leave of each row of values, at each of the row's frequencies: columns are made orthogonal one after the other, twice."""
    phase = 2 * np.pi * grid[:, :, None] * tau[:, None, :]
    along = lambda x, y: np.einsum("ijk,ijk->ij", x, y)[:, :, None]
    rest = np.broadcast_to((v - v.mean(axis=1, keepdims=True))[:, None, :], phase.shape)
    before: list[tuple[np.ndarray, np.ndarray]] = []
    for h in range(1, harmonics + 1):
        for fn in (np.cos, np.sin):
            x = fn(h * phase)
            least = (4 * np.finfo(float).eps) ** 2 * along(x, x)
            for _ in range(2):
                x -= x.mean(axis=2, keepdims=True)
                for u, uu in before:
                    x -= along(x, u) / uu * u
            size = along(x, x)
            size = np.where(size > least, size, np.inf)
            rest = rest - along(rest, x) / size * x
            before.append((x, size))
    return np.einsum("ijk,ijk->ij", rest, rest)


def period_profile(t: np.ndarray, y: np.ndarray, period: float, per_interval: int = 50, harmonics: int = 1) -> list[tuple]:
    """(interval, n, mid time, period, error): an independent period per interval of equal counts."""
    n = len(t)
    k = max(1, n // per_interval)
    edges, found = np.linspace(0, n, k + 1).astype(int), {}
    begin, size = edges[:-1], np.diff(edges)
    for many in np.unique(size[size >= 2 * harmonics + 4]).tolist():
        those = np.flatnonzero(size == many)
        at = begin[those, None] + np.arange(many)
        tau, v = t[at] - t[at[:, :1]], y[at]
        long = tau[:, -1] >= 2 * period
        those, at, tau, v, span = those[long], at[long], tau[long], v[long], tau[long, -1:]
        if not len(those):
            continue
        grid = 1 / period + np.linspace(-1, 1, 201) / span
        chi = np.concatenate([_left_by_sinusoids(tau[i : i + step], v[i : i + step], grid[i : i + step], harmonics) for step in (max(1, CHUNK // (201 * many)),) for i in range(0, len(those), step)])
        i = np.clip(np.argmin(chi, axis=1), 1, 199)
        rows = np.arange(len(those))
        lo, mid, hi = (chi[rows, i + d] for d in (-1, 0, 1))
        bend, df = lo - 2 * mid + hi, grid[:, 1] - grid[:, 0]
        safe = np.where(bend > 0, bend, 1.0)
        f = grid[rows, i] + np.where(bend > 0, 0.5 * (lo - hi) / safe * df, 0.0)
        ef = np.where(bend > 0, np.sqrt(2 * mid / max(many - 2 * harmonics - 2, 1) * df * df / safe), np.nan)
        for s, middle, x, e in zip(those.tolist(), t[at].mean(axis=1).tolist(), (1 / f).tolist(), (ef / f**2).tolist(), strict=True):
            found[s] = (s, many, middle, x, e)
    return [found[s] for s in sorted(found)]


LAWS = {
    "constant": (1, lambda x, p: np.full(len(x), p[0])),
    "linear": (2, lambda x, p: p[0] + p[1] * x),
    "exponential": (2, lambda x, p: p[0] * np.exp(np.clip(p[1] * x / max(abs(p[0]), 1e-300), -50, 50))),
    "quadratic": (3, lambda x, p: p[0] + p[1] * x + p[2] * x * x),
}


def fit_law(t: np.ndarray, p: np.ndarray, w: np.ndarray, law: str) -> tuple[np.ndarray, float]:
    """Parameters and weighted sum of squares by damped Gauss-Newton on numerical derivatives."""
    k, model = LAWS[law]
    x = t - np.average(t, weights=w)
    par, damping = np.r_[np.average(p, weights=w), np.zeros(k - 1)], 1e-3
    scale = np.r_[abs(par[0]), np.full(k - 1, abs(par[0]) / max(np.ptp(x), 1e-12))]
    chi = float(np.sum(w * (p - model(x, par)) ** 2))
    for _ in range(100):
        j = np.column_stack([(model(x, par + e) - model(x, par - e)) / (2 * e[i]) for i, e in enumerate(np.diag(1e-6 * scale))])
        h, g = j.T @ (w[:, None] * j), j.T @ (w * (p - model(x, par)))
        trial = par + np.linalg.lstsq(h + damping * np.diag(np.diag(h)), g, rcond=None)[0]
        new = float(np.sum(w * (p - model(x, trial)) ** 2))
        if new <= chi:
            done = chi - new <= 1e-12 * max(chi, 1e-300)
            par, chi, damping = trial, new, damping / 5
            if done:
                break
        else:
            damping *= 10
            if damping > 1e12:
                break
    return par, chi


def compare_laws(t: np.ndarray, p: np.ndarray, error: np.ndarray | None = None) -> list[tuple]:
    """(law, BIC, chi2, parameters) from best to worst, on the scale of the richest fit."""
    w = np.ones(len(p)) if error is None else 1 / error**2
    fits = {k: fit_law(t, p, w, k) for k, (m, _) in LAWS.items() if len(p) > m + 1}
    if not fits:
        return []
    rich = max(fits, key=lambda k: LAWS[k][0])
    scale = fits[rich][1] / max(len(p) - LAWS[rich][0], 1)
    scale = max(scale, 1.0) if error is not None else max(scale, 1e-300)
    rows = [(k, chi / scale + LAWS[k][0] * math.log(len(p)), chi, par.tolist()) for k, (par, chi) in fits.items()]
    return sorted(rows, key=lambda r: (r[1], LAWS[r[0]][0]))


def cyclic_search(t: np.ndarray, oc: np.ndarray, cycles: float = 1.5, samples: float = 10.0) -> tuple | None:
    """Sinusoid on top of a parabola in O-C: (outer period, amplitude, delta BIC, F-test tail); None for too few points."""
    n = len(t)
    if n < 8:
        return None
    x = (t - t.mean()) / max(np.ptp(t) / 2, 1e-300)
    poly = np.column_stack([np.ones(n), x, x * x])
    base = oc - poly @ np.linalg.lstsq(poly, oc, rcond=None)[0]
    null, span = float(base @ base), np.ptp(t)
    gap = max(np.median(np.diff(np.sort(t))), span / n)
    fs = np.arange(cycles / span, 1 / (4 * gap), 1 / (samples * span))
    best = None
    for f in fs:
        m = np.column_stack([poly, np.cos(2 * np.pi * f * t), np.sin(2 * np.pi * f * t)])
        beta = np.linalg.lstsq(m, oc, rcond=None)[0]
        chi = float(np.sum((oc - m @ beta) ** 2))
        if best is None or chi < best[0]:
            best = chi, f, math.hypot(beta[3], beta[4])
    if best is None:
        return None
    chi, f, amp = best
    gain = n * math.log(max(null, 1e-300) / max(chi, 1e-300)) - 3 * math.log(n)
    tail = special.f_sf(max(null - chi, 0) / 3 / (max(chi, 1e-300) / max(n - 6, 1)), 3, max(n - 6, 1))
    return 1 / f, amp, gain, tail


def longest_chain(values: np.ndarray, intercept: float, spacing: float, tolerance: float, max_gap: int = 3) -> list[int]:
    """Indices of the longest ascending chain of values near intercept + k spacing, gaps of ``max_gap`` orders at most."""
    order = np.argsort(values)
    k = np.rint((values[order] - intercept) / spacing).astype(int)
    near = np.abs(values[order] - intercept - k * spacing) <= tolerance
    best, back = np.where(near, 1, 0), np.full(len(values), -1)
    for i in range(len(values)):
        for j in range(i if near[i] else 0):
            if near[j] and 0 < k[i] - k[j] <= max_gap and best[j] + 1 > best[i]:
                best[i], back[i] = best[j] + 1, j
    if not len(best) or best.max() == 0:
        return []
    chain, i = [], int(np.argmax(best))
    while i >= 0:
        chain.append(int(order[i]))
        i = back[i]
    return chain[::-1]


def wald(values: np.ndarray, covariance: np.ndarray, circular: bool = False) -> tuple[float, float]:
    """Statistic and tail probability that all values are equal, from their successive differences."""
    c = np.eye(len(values))[1:] - np.eye(len(values))[:-1]
    d = c @ values
    if circular:
        d = (d + np.pi) % (2 * np.pi) - np.pi
    x = float(d @ np.linalg.pinv(c @ covariance @ c.T) @ d)
    return x, special.chi2_sf(x, len(values) - 1)


def _grouped(obs: DataFrame, schema: str, rows) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]

    kinds = {c.split()[0]: {"long": "int64", "double": "float64"}.get(c.split()[1], object) for c in schema.split(", ")}

    def run(objects: list[pd.DataFrame]) -> pd.DataFrame:
        points = [(o["object_id"].iloc[0], *_points(o)) for o in objects]
        return pd.DataFrame([(key, *r) for key, t, y, _ in points for r in rows(t, y)], columns=columns).astype(kinds)

    return spread.in_blocks(spread.deal_objects(obs), run, schema)


def track(obs: DataFrame, period: float, segments: int | None = None) -> DataFrame:
    """Delays of each object's segments against its mean curve."""
    return _grouped(obs, "object_id string, segment long, n long, mid double, delay double, delay_error double", lambda t, y: phase_track(t, y, period, segments) if len(t) > 1 else [])


def profile(obs: DataFrame, period: float, per_interval: int = 50) -> DataFrame:
    """Periods of each object's intervals."""
    return _grouped(obs, "object_id string, interval long, n long, mid double, period double, period_error double", lambda t, y: period_profile(t, y, period, per_interval))


def law_ladder(periods: DataFrame) -> DataFrame:
    """Ranked period laws of a track with columns object_id, t, y (the period), dy, rid."""
    return _grouped(periods, "object_id string, rank long, law string, bic double, chi2 double", lambda t, y: [(i + 1, *r[:3]) for i, r in enumerate(compare_laws(t, y))] if len(t) else [])


def cyclic(oc: DataFrame) -> DataFrame:
    """Light-time candidates of O-C tables with columns object_id, t, y (the O-C), dy, rid."""
    return _grouped(oc, "object_id string, outer_period double, amplitude double, delta_bic double, tail double", lambda t, y: [r] if (r := cyclic_search(t, y)) else [])
