"""Light-time orbits in O-C tables: a cycle fitted together with the ephemeris polynomial.

With the eccentric anomaly E of an orbit, the delay is ``A cos w sqrt(1-e^2) sin E +
A sin w cos E``, linear in two amplitudes. So the outer period, eccentricity and time
of periastron are searched, and amplitudes and polynomial follow by linear least
squares at each trial (separable least squares). The scan takes circular orbits over
all outer frequencies, with the polynomial projected out once; a grid of
eccentricities and phases around its deepest minima starts the eccentric fit, which
damped Gauss-Newton steps finish.

Timings closer than a quarter of the reference period are one epoch: the least number
of points, and the spacing that bounds the scan, count epochs. Errors that are not
given are estimated from the joint fit; then information criteria take the logarithm
of the sum of squares.

Defined results: every object has a row; where nothing can be fitted, ``reason`` says
why and the numbers are null. Rows with null or non-finite time or O-C take no part;
errors count only if all are positive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import physics, special
from . import spread

#: Largest eccentricity, trials at most, light seconds of an astronomical unit, days of a year.
MAX_ECCENTRICITY = 0.95
MOST_TRIALS = 2_000_000
AU_LIGHT_SECONDS = 499.004783836
YEAR = 365.25
#: Values of a trials x points array.
CHUNK = 1 << 21

NUMBERS = (
    "t_ref", "outer_period", "outer_period_error", "amplitude", "amplitude_error", "omega", "omega_error", "eccentricity", "eccentricity_error", "periastron", "periastron_error",
    "c0", "c1", "c2", "c3", "c0_error", "c1_error", "c2_error", "c3_error", "pdot", "pdot_error", "null_pdot", "chi2", "null_chi2", "bic", "null_bic", "delta_bic", "f_tail", "cycles", "a_sini_au", "mass_function",
)
FIT = "object_id string, reason string, n long, epochs long, degree long, parameters long, at_edge boolean, " + ", ".join(f"{c} double" for c in NUMBERS)
SCAN = "object_id string, k long, outer_period double, delta_chi2 double"


def kepler(mean: np.ndarray, e: float) -> np.ndarray:
    """Eccentric anomaly: Newton's steps kept within e of the mean anomaly, then halving where they have not settled."""
    m = np.mod(mean, 2 * np.pi)
    x = m + e * np.sin(m)
    for _ in range(40):
        step = (x - e * np.sin(x) - m) / (1 - e * np.cos(x))
        x = np.clip(x - step, m - e, m + e)
        if np.all(np.abs(step) < 1e-13):
            return x
    lo, hi = m - e, m + e
    for _ in range(60):
        x = (lo + hi) / 2
        above = x - e * np.sin(x) > m
        lo, hi = np.where(above, lo, x), np.where(above, x, hi)
    return x


def orbit_columns(dt: np.ndarray, period: float, e: float, periastron: float) -> np.ndarray:
    """The two columns of an orbit, those of A cos w and A sin w."""
    x = kepler(2 * np.pi * (dt - periastron) / period, e)
    return np.column_stack([math.sqrt(1 - e * e) * np.sin(x), np.cos(x)])


def kepler_rows(mean: np.ndarray, e: np.ndarray) -> np.ndarray:
    """``kepler`` for rows of mean anomalies, each with its own e: steps of fourth order (Danby 1988), taken by rows that have not settled."""
    m = np.mod(mean, 2 * np.pi)
    x, rows = np.empty_like(m), np.arange(len(m))
    mm, ee = m, e[:, None]
    at = mm + 0.85 * ee * np.where(mm < np.pi, 1.0, -1.0)
    for _ in range(12):
        s, c = ee * np.sin(at), ee * np.cos(at)
        f, slope = at - s - mm, 1 - c
        step = f / slope
        step = f / (slope - 0.5 * step * s)
        step = f / (slope - 0.5 * step * s + step * step * c / 6)
        at = np.clip(at - step, mm - ee, mm + ee)
        settled = np.abs(step).max(axis=1, initial=0) < 1e-5  # then the next step is below rounding
        x[rows[settled]] = at[settled]
        if settled.all():
            return x
        rows, at, mm, ee = (z[~settled] for z in (rows, at, mm, ee))
    for i in rows:
        x[i] = kepler(mean[i], float(e[i]))
    return x


def distinct_epochs(t: np.ndarray, period: float) -> np.ndarray:
    """Mean times of runs of sorted times closer than a quarter period."""
    if not len(t):
        return t
    run = np.cumsum(np.diff(t, prepend=t[0]) >= 0.25 * period)
    return np.bincount(run, t) / np.bincount(run)


class _Joint:
    """O-C values with the polynomial projected out, for trials of an orbit's columns."""

    def __init__(self, dt: np.ndarray, oc: np.ndarray, sigma: np.ndarray, degree: int) -> None:
        self.dt, self.sigma, self.scale = dt, sigma, max(np.ptp(dt) / 2, 1e-300)
        self.poly = (dt / self.scale)[:, None] ** np.arange(degree + 1)
        self.q, _ = np.linalg.qr(self.poly / sigma[:, None])
        self.oc, self.y = oc, oc / sigma
        self.rest = self.y - self.q @ (self.q.T @ self.y)
        self.null = float(self.rest @ self.rest)

    def scan(self, frequencies: np.ndarray) -> np.ndarray:
        """Sum of squares of the circular orbit at each frequency."""
        out, step = np.empty(len(frequencies)), max(1, CHUNK // len(self.dt))
        for a in range(0, len(frequencies), step):
            th = 2 * np.pi * np.outer(frequencies[a : a + step], self.dt)
            c, s = np.cos(th) / self.sigma, np.sin(th) / self.sigma
            c -= (c @ self.q) @ self.q.T
            s -= (s @ self.q) @ self.q.T
            cc, ss, cs, yc, ys = (c * c).sum(1), (s * s).sum(1), (c * s).sum(1), c @ self.rest, s @ self.rest
            det = cc * ss - cs * cs
            with np.errstate(all="ignore"):
                gain = np.where(det > 1e-12 * cc * ss, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / det, 0.0)
            out[a : a + step] = self.null - np.maximum(gain, 0)
        return out

    def left(self, p: np.ndarray) -> np.ndarray:
        """What the best amplitudes and polynomial leave at (outer period[, eccentricity, phase of periastron])."""
        e, phase = (p[1], p[2]) if len(p) > 1 else (0.0, 0.0)
        x = orbit_columns(self.dt, p[0], e, phase * p[0]) / self.sigma[:, None]
        x -= self.q @ (self.q.T @ x)
        return self.rest - x @ np.linalg.lstsq(x, self.rest, rcond=None)[0]

    def left_rows(self, p: np.ndarray) -> np.ndarray:
        """``left`` of each row of parameters."""
        return _left(self.dt, self.sigma, self.q[None], self.rest, p)

    def polish(self, p: np.ndarray, bounds: tuple[float, float], free: np.ndarray) -> tuple[np.ndarray, float]:
        """Damped Gauss-Newton of the projected residuals over the ``free`` parameters, inside the bounds."""
        p, chi = self.polish_rows(p[None, :], bounds, free)
        return p[0], float(chi[0])

    def polish_rows(self, p: np.ndarray, bounds: tuple[float, float], free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``polish`` from several starts (rows), each with steps, damping and end of its own, evaluated together."""
        return polish_tables([self], p, np.zeros(len(p), dtype=int), np.array([bounds]), free)

    def solution(self, p: np.ndarray, fixed: bool) -> tuple[np.ndarray, np.ndarray]:
        """(outer period, amplitude, omega[, eccentricity, periastron], polynomial in days) and their covariance for unit errors."""
        e, at = (p[1], p[2] * p[0]) if len(p) > 1 else (0.0, 0.0)
        x = np.column_stack([orbit_columns(self.dt, p[0], e, at), self.poly])
        beta = np.linalg.lstsq(x / self.sigma[:, None], self.y, rcond=None)[0]
        amplitude, omega = math.hypot(beta[0], beta[1]), math.atan2(beta[1], beta[0])
        c, s = math.cos(omega), math.sin(omega)
        shape = lambda v: orbit_columns(self.dt, *v) @ np.array([c, s]) * amplitude

        def slope(i: int, d: float) -> np.ndarray:
            up, down = np.array([p[0], e, at]), np.array([p[0], e, at])
            up[i], down[i] = up[i] + d, max(down[i] - d, 0.0) if i == 1 else down[i] - d
            return (shape(up) - shape(down)) / (up[i] - down[i])

        cols = [] if fixed else [slope(0, 1e-6 * p[0])]
        cols += [x[:, :2] @ np.array([c, s]), amplitude * (x[:, :2] @ np.array([-s, c]))]
        if len(p) > 1:
            cols += [slope(1, min(1e-6, (1 - e) / 10)), slope(2, 1e-6 * p[0])]
        j = np.column_stack([*cols, self.poly]) / self.sigma[:, None]
        unit = np.sqrt(np.maximum((j * j).sum(0), 1e-300))
        inverse = np.linalg.pinv((j / unit).T @ (j / unit)) / np.outer(unit, unit)
        if fixed:
            inverse = np.pad(inverse, ((1, 0), (1, 0)), constant_values=np.nan)
        down = self.scale ** -np.arange(self.poly.shape[1], dtype=float)
        values = np.concatenate([[p[0], amplitude, omega], [e, at] if len(p) > 1 else [], beta[2:] * down])
        unit = np.concatenate([np.ones(len(values) - len(down)), down])
        return values, inverse * np.outer(unit, unit)


def _left(dt: np.ndarray, sigma: np.ndarray, q: np.ndarray, rest: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What the best amplitudes and polynomial leave for rows of parameters, with tables of one or of each row: the two columns are made orthogonal in place of a least-squares solution each."""
    if p.shape[1] > 1:
        e = p[:, 1]
        x = kepler_rows(2 * np.pi * (dt - (p[:, 2] * p[:, 0])[:, None]) / p[:, :1], e)
        both = np.stack([np.sqrt(1 - e * e)[:, None] * np.sin(x), np.cos(x)]) / sigma
    else:
        x = 2 * np.pi * dt / p[:, :1]
        both = np.stack([np.sin(x), np.cos(x)]) / sigma
    size = lambda y, z: np.einsum("...j,...j->...", y, z)
    both -= sum(size(both, q[..., k])[..., None] * q[..., k] for k in range(q.shape[-1]))
    u, v = both
    swap = size(v, v) > size(u, u)
    u, v = np.where(swap[:, None], v, u), np.where(swap[:, None], u, v)
    uu = size(u, u)
    for _ in range(2):  # twice, so that nearly parallel columns are parted to rounding
        v = v - (size(u, v) / np.maximum(uu, 1e-300))[:, None] * u
    vv = size(v, v)
    vv = np.where(vv > (4 * np.finfo(float).eps) ** 2 * uu, vv, np.inf)
    left = rest - (size(np.broadcast_to(rest, u.shape), u) / np.where(uu > 0, uu, np.inf))[:, None] * u
    return left - (size(left, v) / vv)[:, None] * v


def solved(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Shortest least-squares solutions of small symmetric systems (rows), as ``lstsq`` gives them."""
    u, size, v = np.linalg.svd(h)
    x = np.einsum("iba,ib->ia", u, g)
    x = np.where(size > np.finfo(float).eps * h.shape[1] * size[:, :1], x / np.where(size > 0, size, 1), 0)
    return np.einsum("iab,ia->ib", v, x)


def polish_tables(joints: list[_Joint], p: np.ndarray, of: np.ndarray, bounds: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and sums of squares from starts (rows) of several tables of as many points each: ``of`` names a start's table, ``bounds`` holds the outer periods of each table. All starts of all tables are evaluated together."""
    m, n = p.shape[1], len(joints[0].dt)
    dt, sigma, q, base = (np.stack([getattr(j, c) for j in joints]) for c in ("dt", "sigma", "q", "rest"))
    left = lambda who, at: _left(*(x[of[who]] for x in (dt, sigma, q, base)), at)
    lo = np.column_stack([bounds[of, 0], np.zeros(len(p)), np.full(len(p), -np.inf)])[:, :m]
    hi = np.column_stack([bounds[of, 1], np.full(len(p), MAX_ECCENTRICITY), np.full(len(p), np.inf)])[:, :m]
    p = np.clip(p, lo, hi)
    rest = left(np.arange(len(p)), p)
    chi = np.einsum("ij,ij->i", rest, rest)
    unit = np.column_stack([p[:, 0], np.ones((len(p), 2))])[:, :m] * 1e-6
    damping, idle = np.full(len(p), 1e-3), np.zeros(len(p), dtype=int)
    live, at = np.arange(len(p)) if len(free) else np.zeros(0, dtype=int), np.arange(len(free))
    slopes, moved = np.zeros((len(p), len(free), n)), np.ones(len(p), dtype=bool)  # slopes are kept while a start does not move
    for _ in range(80):
        if not len(live):
            break
        fresh = live[moved[live]]
        if len(fresh):
            up, down = (np.repeat(p[fresh, None, :], len(free), axis=1) for _ in range(2))
            up[:, at, free] = np.minimum(p[fresh] + unit[fresh], hi[fresh])[:, free]
            down[:, at, free] = np.maximum(p[fresh] - unit[fresh], lo[fresh])[:, free]
            both = left(np.tile(np.repeat(fresh, len(free)), 2), np.concatenate([up, down]).reshape(-1, m)).reshape(2, len(fresh), len(free), n)
            slopes[fresh] = (both[0] - both[1]) / (up - down).sum(axis=2)[:, :, None]
            moved[fresh] = False
        j = slopes[live]
        h, g = np.einsum("iaj,ibj->iab", j, j), np.einsum("iaj,ij->ia", j, rest[live])
        h[:, at, at] += damping[live, None] * np.maximum(h[:, at, at], 1e-300)
        trial = p[live].copy()
        trial[:, free] -= solved(h, g)
        trial = np.clip(trial, lo[live], hi[live])
        new = left(live, trial)
        value = np.einsum("ij,ij->i", new, new)
        better = value < chi[live]
        won, lost = live[better], live[~better]
        idle[won] = np.where(chi[won] - value[better] <= 1e-10 * chi[won], idle[won] + 1, 0)
        p[won], rest[won], chi[won], moved[won] = trial[better], new[better], value[better], True
        damping[won] /= 6
        damping[lost] *= 6
        live = live[np.where(better, idle[live] <= 1, damping[live] <= 1e12)]
    return p, chi


def _trials(epochs: np.ndarray, baseline: float, period: float, low: float | None, high: float | None, samples: int, min_cycles: float) -> np.ndarray | None:
    """Outer frequencies of the scan; None where no outer period can be resolved."""
    spacing = max(float(np.median(np.diff(epochs))), float(epochs[-1] - epochs[0]) / (len(epochs) - 1)) if len(epochs) > 1 else baseline
    lo = max(4 * spacing, 20 * period) if low is None else low
    hi = baseline / min_cycles if high is None else high
    if not 0 < lo < hi:
        return None
    n = math.ceil((1 / lo - 1 / hi) * samples * baseline) + 1
    return np.linspace(1 / hi, 1 / lo, max(2, n)) if n <= MOST_TRIALS else None


@dataclass
class _Begun:
    """One table between the scan and its fit."""

    t: np.ndarray
    sigma: np.ndarray
    given: bool
    period: float
    degree: int
    eccentric: bool
    outer_period: float | None
    t_ref: float
    baseline: float
    joint: _Joint
    f: np.ndarray
    chi: np.ndarray
    bounds: tuple[float, float]
    out: dict
    #: Starts of the eccentric fit that are polished.
    KEPT: ClassVar[int] = 5

    def starts(self, circular: float) -> np.ndarray:
        """The best of a grid of eccentricities and phases at the circular period and the deepest minima of the scan."""
        chi = self.chi
        lowest = np.flatnonzero((chi <= np.append(np.inf, chi[:-1])) & (chi <= np.append(chi[1:], np.inf)))
        periods = np.array([circular, *(1 / self.f[lowest[np.argsort(chi[lowest])][:3]])])
        tries = np.stack(np.meshgrid(periods, (0.05, 0.2, 0.4, 0.6, 0.8), np.arange(12) / 12, indexing="ij"), axis=-1).reshape(-1, 3)
        left = self.joint.left_rows(tries)
        return tries[np.argsort(np.einsum("ij,ij->i", left, left), kind="stable")[: self.KEPT]]

    def end(self, p: np.ndarray, best: float) -> dict:
        """The columns of FIT for parameters and their sum of squares."""
        joint, sigma, given, period, degree, eccentric, outer_period, t_ref, baseline, f, chi, out = (
            self.joint, self.sigma, self.given, self.period, self.degree, self.eccentric, self.outer_period, self.t_ref, self.baseline, self.f, self.chi, self.out
        )
        n, i = len(self.t), int(np.argmin(chi))
        values, cov = joint.solution(p, outer_period is not None)
        m, k_poly = len(values) - (outer_period is not None), degree + 1
        dof = max(1, n - m)
        scale = 1.0 if given or best <= 0 else best / dof
        cov, chi2, null = cov * scale, best / scale, joint.null / scale
        tiny = np.finfo(float).tiny
        if given:
            bic, null_bic = chi2 + m * math.log(n), null + k_poly * math.log(n)
        else:
            variance = scale * float(sigma[0]) ** 2
            bic, null_bic = (n * math.log(max(c * variance, tiny) / n) + k * math.log(n) for c, k in ((chi2, m), (null, k_poly)))
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        straight = np.linalg.lstsq(joint.poly / sigma[:, None], joint.y, rcond=None)[0] / joint.scale ** np.arange(k_poly)
        out |= {"t_ref": t_ref, "outer_period": values[0], "outer_period_error": sd[0], "amplitude": values[1], "amplitude_error": sd[1], "omega": (values[2] + math.pi) % (2 * math.pi) - math.pi, "omega_error": sd[2], "eccentricity": 0.0, "periastron": t_ref}
        if eccentric:
            out |= {"eccentricity": values[3], "eccentricity_error": sd[3], "periastron": t_ref + values[4] % values[0], "periastron_error": sd[4]}
        out |= {f"c{k}": v for k, v in enumerate(values[-k_poly:])} | {f"c{k}_error": v for k, v in enumerate(sd[-k_poly:])}
        second = (2 * period * values[-k_poly + 2], 2 * period * sd[-k_poly + 2], 2 * period * straight[2]) if degree > 1 else (0.0, 0.0, 0.0)
        a = values[1] * 86400 / AU_LIGHT_SECONDS
        tail = special.f_sf(max(null - chi2, 0) / (m - k_poly) / (max(chi2, tiny) / dof), m - k_poly, dof)
        out |= dict(zip(("pdot", "pdot_error", "null_pdot"), second, strict=True))
        out |= {"chi2": chi2, "null_chi2": null, "bic": bic, "null_bic": null_bic, "delta_bic": null_bic - bic, "f_tail": tail, "cycles": baseline / values[0], "a_sini_au": a, "mass_function": a**3 / (values[0] / YEAR) ** 2}
        return out | {"parameters": m, "at_edge": outer_period is None and i in (0, len(f) - 1), "scan": (f, (joint.null - chi) / scale)}


def search(t: np.ndarray, oc: np.ndarray, error: np.ndarray | None, period: float, degree: int | None = 2, *args, **settings) -> dict:
    """The fit of one O-C table; settings as in ``search_tables``."""
    return search_tables([(t, oc, error, period)], degree, *args, **settings)[0]


def search_tables(
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray | None, float]], degree: int | None = 2, eccentric: bool = False, outer_period: float | None = None,
    low: float | None = None, high: float | None = None, samples: int = 10, min_cycles: float = 1.0, min_points: int = 8,
) -> list[dict]:
    """The fits of O-C tables (t, O-C, error, reference period) as dicts of the columns of FIT, and under ``scan`` the trial frequencies and their gains. Tables of as many points take their steps together.

    ``degree`` None takes the degree of 1 to 3 with the lowest criterion; ``outer_period`` holds the outer period.
    """
    settings = (eccentric, outer_period, low, high, samples, min_cycles, min_points)
    if degree is None:
        each = [search_tables(tables, d, *settings) for d in (1, 2, 3)]
        return [min((r for r in found if not r["reason"]), key=lambda r: r["bic"], default=found[0]) for found in zip(*each, strict=True)]
    begun = [_begin(*x, degree, *settings) for x in tables]
    out = [x if isinstance(x, dict) else None for x in begun]
    alike: dict[int, list[int]] = {}
    for i, x in enumerate(begun):
        if out[i] is None:
            alike.setdefault(len(x.joint.dt), []).append(i)
    for those in alike.values():
        joints, bounds = [begun[i].joint for i in those], np.array([begun[i].bounds for i in those])
        free = [] if outer_period is not None else [0]
        p, best = polish_tables(joints, np.array([[1 / begun[i].f[np.argmin(begun[i].chi)]] for i in those]), np.arange(len(those)), bounds, np.array(free, dtype=int))
        if eccentric:
            starts = np.concatenate([begun[i].starts(x[0]) for i, x in zip(those, p, strict=True)])
            of = np.repeat(np.arange(len(those)), _Begun.KEPT)
            p, best = (x.reshape(len(those), _Begun.KEPT, *x.shape[1:]) for x in polish_tables(joints, starts, of, bounds, np.array([*free, 1, 2])))
            at = np.argmin(best, axis=1)
            p, best = p[np.arange(len(at)), at], best[np.arange(len(at)), at]
        for i, x, chi in zip(those, p, best, strict=True):
            out[i] = begun[i].end(x, float(chi))
    return out


def _begin(t, oc, error, period, degree, eccentric, outer_period, low, high, samples, min_cycles, min_points) -> dict | _Begun:
    """A table ready for its steps, or the row that says why it cannot be fitted."""
    keep = np.isfinite(t) & np.isfinite(oc)
    given = error is not None and bool(np.all(np.isfinite(error[keep]) & (error[keep] > 0)))
    order = np.argsort(t[keep], kind="stable")
    t, oc = t[keep][order], oc[keep][order]
    n, epochs = len(t), distinct_epochs(t, period)
    out = dict.fromkeys(NUMBERS, math.nan) | {"reason": None, "n": n, "epochs": len(epochs), "degree": degree, "parameters": 0, "at_edge": False, "scan": (np.zeros(0), np.zeros(0))}
    least = max(min_points, degree + 1 + (5 if eccentric else 3) + 2)
    if len(epochs) < least:
        return out | {"reason": f"under {least} distinct epochs"}
    baseline = float(t[-1] - t[0])
    if given:
        sigma = error[keep][order]
    else:
        x = (t - t.mean()) / baseline
        rest = oc - np.polyval(np.polyfit(x, oc, degree), x)
        sigma = np.full(n, max(float(rest.std()), 1e-9 * period))
    t_ref = float(np.average(t, weights=1 / sigma**2))
    joint = _Joint(t - t_ref, oc, sigma, degree)
    if outer_period is not None:
        f, bounds = np.array([1 / outer_period]), (outer_period, outer_period)
    else:
        f = _trials(epochs, baseline, period, low, high, samples, min_cycles)
        if f is None:
            return out | {"reason": "no outer period can be resolved"}
        bounds = 1 / f[-1], 1 / f[0]
    return _Begun(t, sigma, given, period, degree, eccentric, outer_period, t_ref, baseline, joint, f, joint.scan(f), bounds, out)


def _grouped(oc: DataFrame, schema: str, period: float, rows, settings: dict) -> DataFrame:
    columns = [c.split()[0] for c in schema.split(", ")]
    fixed = "period" in oc.columns
    used = oc.select("object_id", "t", "y", "dy", (F.col("period") if fixed else F.lit(period)).cast("double").alias("period"))

    def run(objects: list[pd.DataFrame]) -> pd.DataFrame:
        found = search_tables([(*(o[c].to_numpy(float) for c in ("t", "y", "dy")), float(o["period"].iloc[0])) for o in objects], **settings)
        out = pd.DataFrame([x for o, r in zip(objects, found, strict=True) for x in rows(o["object_id"].iloc[0], r)], columns=columns)
        return out.astype({c: object for c in ("reason",) if c in columns})

    return spread.in_blocks(spread.deal_objects(used), run, schema)


def orbits(oc: DataFrame, period: float | None = None, **settings) -> DataFrame:
    """The orbit of each O-C table (object_id, t, y the O-C, dy its error or null), one row an object; the reference period is given or a column ``period``. Settings as in ``search``."""
    columns = [c.split()[0] for c in FIT.split(", ")]
    out = _grouped(oc, FIT, period, lambda key, r: [[key if c == "object_id" else r[c] for c in columns]], settings)
    return out.select([F.when(~F.isnan(c), F.col(c)).alias(c) if c in NUMBERS else F.col(c) for c in columns])


def scan(oc: DataFrame, period: float | None = None, **settings) -> DataFrame:
    """Trial outer periods of each table and how much a circular orbit lowers the sum of squares at each."""
    return _grouped(oc, SCAN, period, lambda key, r: [(key, k, 1 / f, gain) for k, (f, gain) in enumerate(zip(*r["scan"], strict=True))], settings)


def fixed_scan(oc: DataFrame, n: int, share: float, degree: int = 2) -> DataFrame:
    """object_id, k, outer_period and f_like at ``n`` outer frequencies from one cycle a baseline to one in ``share`` of it: the gain of a circular orbit over the mean square that the joint fit leaves at that trial."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, y = pdf["t"].to_numpy(float), pdf["y"].to_numpy(float)
        span = float(np.ptp(t))
        if span <= 0 or len(t) < degree + 4:
            return pd.DataFrame({"object_id": pd.Series([], dtype=object), "k": pd.Series([], dtype="int64"), "outer_period": [], "f_like": []})
        f = np.linspace(1 / span, 1 / (share * span), n)
        joint = _Joint(t - t.mean(), y, np.ones(len(t)), degree)
        chi = joint.scan(f)
        return pd.DataFrame({"object_id": pdf["object_id"].iloc[0], "k": np.arange(n), "outer_period": 1 / f, "f_like": (joint.null - chi) / (chi / (len(t) - degree - 4))})

    return oc.groupBy("object_id").applyInPandas(run, "object_id string, k long, outer_period double, f_like double")


def from_track(track: DataFrame) -> DataFrame:
    """The O-C table of ``tracking.track``: delays at segments' middles."""
    return track.select("object_id", F.col("mid").alias("t"), F.col("delay").alias("y"), F.when(~F.isnan("delay_error"), F.col("delay_error")).alias("dy"))


def predict(fits: DataFrame, times: DataFrame, period: float) -> DataFrame:
    """object_id, t, secular, cyclic and apparent_period at given times (object_id, t): expressions of the fits' columns, nothing leaves the JVM."""
    f = fits.where("reason IS NULL").select("object_id", "t_ref", "outer_period", "amplitude", "omega", "eccentricity", "periastron", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("c0", "c1", "c2", "c3")))
    j = times.select("object_id", "t").join(f, "object_id").withColumn("dt", F.col("t") - F.col("t_ref"))
    orbit = (F.col("dt"), F.col("outer_period"), F.col("amplitude"), F.col("omega"), F.col("eccentricity"), F.col("periastron") - F.col("t_ref"))
    secular = F.col("c0") + F.col("dt") * (F.col("c1") + F.col("dt") * (F.col("c2") + F.col("dt") * F.col("c3")))
    slope = F.col("c1") + F.col("dt") * (2 * F.col("c2") + 3 * F.col("dt") * F.col("c3")) + physics.ltte_slope(*orbit)
    return j.select("object_id", "t", secular.alias("secular"), physics.ltte_delay(*orbit).alias("cyclic"), (F.lit(period) * (1 + slope)).alias("apparent_period"))
