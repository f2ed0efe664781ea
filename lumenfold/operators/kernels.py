"""Vectorised per-object statistics: Spark deals objects, NumPy streams the trial grid.

Each kernel takes (t, y, dy, frequencies) of one object, with t from its first
time, and returns the statistic per trial. Trials are worked off in chunks, so
memory is bounded by CHUNK values however long the grid is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from . import folds, grids, nufft, spread
from .boxes import limb_darkened

CHUNK = 1 << 19
#: Values of a working array that stays in a processor's cache.
CACHED = 1 << 15
#: Points times trials from which equally spaced trials go through the FFT.
FFT_FROM = 1 << 18
#: Trials from which equally spaced ones below that are products of few exponentials.
EVEN_FROM = 16
MINIMISED = frozenset({"pdm", "ce", "sl"})


def _chunks(frequencies: np.ndarray, n: int):
    step = max(1, CHUNK // max(n, 1))
    for a in range(0, len(frequencies), step):
        yield slice(a, a + step), frequencies[a : a + step]


def _weights(dy: np.ndarray | None, n: int) -> np.ndarray:
    w = np.ones(n) if dy is None or not np.isfinite(dy).all() else 1.0 / dy**2
    return w / w.sum()


def _phase(tau: np.ndarray, f: np.ndarray) -> np.ndarray:
    q = tau[None, :] / (1.0 / f)[:, None]
    return q - np.floor(q)


def _sorted_phases(tau: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phases of each trial in ascending order, and the points they belong to; equal phases in the order of points.

    Phase and point are packed into one integer, as plain sorting is several times faster than sorting an index.
    """
    bits = max(1, (len(tau) - 1).bit_length())
    scale = float(1 << (62 - bits))
    packed = (_phase(tau, f) * scale).astype(np.int64) << bits | np.arange(len(tau))
    packed.sort(axis=1)
    return (packed >> bits) / scale, packed & ((1 << bits) - 1)


def _trig_sums(tau: np.ndarray, rows: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    """sum of row * exp(2 pi i f tau) for each row and frequency."""
    even = nufft.uniform(frequencies) if len(frequencies) >= EVEN_FROM else None
    if even and len(tau) * len(frequencies) >= FFT_FROM:
        return nufft.sums(tau, rows, *even, len(frequencies))
    if even:
        return nufft.Products(tau, *even, len(frequencies)).sums(rows)
    out = np.empty((len(rows), len(frequencies)), dtype=complex)
    for part, f in _chunks(frequencies, len(tau)):
        th = 2 * np.pi * f[:, None] * tau[None, :]
        out[:, part] = rows @ np.cos(th).T + 1j * (rows @ np.sin(th).T)
    return out


class LombScargle:
    """Lomb-Scargle powers of several value series at the same times, errors and trials: what depends on the weights alone is kept."""

    def __init__(self, tau, dy, frequencies, fit_mean: bool = True) -> None:
        self.tau, self.f = tau, frequencies
        self.w = _weights(dy, len(tau))
        even = nufft.uniform(frequencies) if len(frequencies) >= EVEN_FROM and len(tau) * len(frequencies) < FFT_FROM else None
        self.near = nufft.Products(tau, *even, len(frequencies)) if even else None
        once, twice = (self.near.sums(self.w), self.near.doubled().sums(self.w)) if even else (_trig_sums(k * tau, self.w[None, :], frequencies) for k in (1, 2))
        self.terms = weight_terms(once[0], twice[0], fit_mean)

    def data_sums(self, y) -> np.ndarray:
        """sum of w (y - mean) exp(2 pi i f tau)."""
        values = (self.w * (y - np.sum(self.w * y)))[None, :]
        return (self.near.sums(values) if self.near else _trig_sums(self.tau, values, self.f))[0]

    def power(self, y, data: np.ndarray | None = None) -> np.ndarray:
        yc = y - np.sum(self.w * y)
        yy = np.sum(self.w * yc * yc)
        if yy <= (64 * np.finfo(float).eps * np.max(np.abs(y), initial=0)) ** 2:
            return np.zeros(len(self.f))
        return power_of_sums(self.terms, self.data_sums(y) if data is None else data, yy)


def weight_terms(once: np.ndarray, twice: np.ndarray, fit_mean: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squares of cosines, of sines, and products, about their means, from sums of w exp(2 pi i f tau) and w exp(4 pi i f tau) with weights of sum one."""
    cm, sm = (once.real, once.imag) if fit_mean else (0.0, 0.0)
    return (1 + twice.real) / 2 - cm * cm, (1 - twice.real) / 2 - sm * sm, twice.imag / 2 - cm * sm


def power_of_sums(terms: tuple[np.ndarray, np.ndarray, np.ndarray], data: np.ndarray, yy: float) -> np.ndarray:
    """Power from the terms of the weights, the sums of the data, and the weighted square of the values about their mean."""
    cc, ss, cs = terms
    d = yy * (cc * ss - cs * cs)
    with np.errstate(all="ignore"):
        p = (ss * data.real**2 + cc * data.imag**2 - 2 * cs * data.real * data.imag) / d
    return np.where((np.abs(d) > 1e-12 * yy) & (p > 0), np.minimum(p, 1), 0)


def gls(tau, y, dy, frequencies, fit_mean: bool = True):
    """Generalised Lomb-Scargle power."""
    return LombScargle(tau, dy, frequencies, fit_mean).power(y)


def pdm(tau, y, dy, frequencies, n_bins: int = 10, n_covers: int = 3):
    """Phase dispersion over overlapping covers."""
    n, g = len(y), n_bins * n_covers
    yc = y - y.mean()
    sigma2 = np.sum(yc * yc) / (n - 1) if n > 1 else 0.0
    if sigma2 <= 0:
        return np.ones(len(frequencies))
    out = np.empty(len(frequencies))
    for part, f in _chunks(frequencies, n):
        m = len(f)
        b = np.clip((_phase(tau, f) * g).astype(np.int64), 0, g - 1) + np.arange(m)[:, None] * g
        b = b.ravel()
        hist = [np.bincount(b, minlength=m * g).reshape(m, g), np.bincount(b, np.tile(yc, m), m * g).reshape(m, g)]
        # every point is in one bin of each cover, so the squares need no histogram
        ssd, filled = np.full(m, n_covers * np.sum(yc * yc)), np.zeros(m)
        for c in range(n_covers):
            k, s1 = (np.roll(h, c, axis=1).reshape(m, n_bins, n_covers).sum(axis=2) for h in hist)
            ssd -= (s1 * s1 / np.maximum(k, 1)).sum(axis=1)
            filled += (k > 0).sum(axis=1)
        ssd = np.maximum(ssd, 0)
        dof = n * n_covers - filled
        with np.errstate(all="ignore"):
            out[part] = np.where(dof > 0, ssd / dof / sigma2, np.inf)
    return out


def ce(tau, y, dy, frequencies, n_phase: int = 10, n_mag: int = 10):
    """Conditional entropy."""
    n, lo, hi = len(y), y.min(), y.max()
    if hi <= lo:
        return np.zeros(len(frequencies))
    i = np.clip(((y - lo) / (hi - lo) * n_mag).astype(np.int64), 0, n_mag - 1)
    out = np.empty(len(frequencies))
    for part, f in _chunks(frequencies, n):
        m = len(f)
        j = np.clip((_phase(tau, f) * n_phase).astype(np.int64), 0, n_phase - 1)
        cell = (np.arange(m)[:, None] * n_phase + j) * n_mag + i[None, :]
        h = np.bincount(cell.ravel(), minlength=m * n_phase * n_mag).reshape(m, n_phase, n_mag).astype(float)
        col = h.sum(axis=2, keepdims=True)
        with np.errstate(all="ignore"):
            out[part] = np.where(h > 0, h * np.log(col / h), 0).sum(axis=(1, 2)) / n
    return out


def sl(tau, y, dy, frequencies):
    """String length."""
    n, lo, hi = len(y), y.min(), y.max()
    v = (y - lo) / (hi - lo) * 0.5 - 0.25 if hi > lo else np.zeros(n)
    out = np.empty(len(frequencies))
    for part, f in _chunks(frequencies, n):
        p, order = _sorted_phases(tau, f)
        m = v[order]
        out[part] = np.hypot(np.diff(p, axis=1), np.diff(m, axis=1)).sum(axis=1) + np.hypot(p[:, 0] + 1 - p[:, -1], m[:, 0] - m[:, -1])
    return out


def mhaov(tau, y, dy, frequencies, harmonics: int = 3):
    """Multiharmonic analysis of variance."""
    return mhaov_rows(tau, np.asarray(y)[None, :], frequencies, harmonics)[0]


def mhaov_rows(tau, y, frequencies, harmonics: int = 3):
    """``mhaov`` of each row of values at the same times, whose inner products are summed and solved once for all."""
    n, h = y.shape[1], harmonics
    out = np.zeros((len(y), len(frequencies)))
    if n <= 2 * h + 1:
        return out + np.nan
    yc = y - y.mean(axis=1, keepdims=True)
    total = np.sum(yc * yc, axis=1)
    if not (total > 0).any():
        return out
    ones, data = [], []
    for k in range(1, 2 * h + 1):  # all inner products of the harmonics are such sums
        rows = np.vstack([np.ones((1, n)), yc[: len(yc) if k <= h else 0]])
        found = _trig_sums(k * tau, rows, frequencies)
        ones.append(found[0])
        if k <= h:
            data.append(found[1:])
    for a in range(0, len(frequencies), 1 << 14):
        part = slice(a, a + (1 << 14))
        one = [np.full(len(frequencies[part]), float(n), dtype=complex), *(x[part] for x in ones)]
        gram = np.empty((len(one[0]), 2 * h + 1, 2 * h + 1))
        rhs = np.zeros((len(one[0]), 2 * h + 1, len(yc)))
        gram[:, 0, 0] = n
        for i in range(1, h + 1):
            gram[:, 0, 2 * i - 1], gram[:, 0, 2 * i] = one[i].real, one[i].imag
            rhs[:, 2 * i - 1], rhs[:, 2 * i] = data[i - 1][:, part].real.T, data[i - 1][:, part].imag.T
            for j in range(i, h + 1):
                less = one[j - i]  # exp(i(j - k)) and exp(i(j + k)) give the products of cosines and sines
                gram[:, 2 * i - 1, 2 * j - 1] = (less.real + one[i + j].real) / 2
                gram[:, 2 * i, 2 * j] = (less.real - one[i + j].real) / 2
                gram[:, 2 * i - 1, 2 * j] = (one[i + j].imag + less.imag) / 2
                gram[:, 2 * i, 2 * j - 1] = (one[i + j].imag - less.imag) / 2
        low = np.tril_indices(2 * h + 1, -1)
        gram[:, low[0], low[1]] = gram[:, low[1], low[0]]
        gram += 1000 * np.finfo(float).eps * n * np.eye(2 * h + 1)
        beta = np.linalg.solve(gram, rhs)
        model = np.clip((beta * rhs).sum(axis=1), 0, total)
        out[:, part] = ((model / (2 * h)) / (np.maximum(total - model, 1e-300) / (n - 2 * h - 1))).T
    out[total <= 0] = 0.0
    return out


def bls(tau, y, dy, frequencies, n_durations: int = 8, oversample: int = 10):
    """Box search: snr of the deepest box per trial. Durations are 1 to 12 % of the period's octave.

    Periods of an octave share their durations and slots; as many as fit are binned at once.
    """
    iv = 1.0 / dy**2 if dy is not None and np.isfinite(dy).all() else np.ones(len(y))
    total_iv = np.sum(iv)
    yc = y - np.sum(y * iv) / total_iv  # a box's depth in errors is then -inside / sqrt(weight inside * weight outside / weight)
    floor = 4 * len(y) * np.finfo(float).eps * total_iv
    out = np.zeros(len(frequencies))
    periods = 1.0 / frequencies
    lowest = periods.min()
    octave = np.floor(np.log2(periods / lowest) + 1e-12).astype(np.int64)
    for o in np.unique(octave):
        base = lowest * 2.0 ** float(o)
        durations = np.geomspace(0.01 * base, 0.12 * base, n_durations)
        width = durations[0] / oversample
        boxes = np.unique(np.floor(durations / width + 0.5).astype(np.int64))
        who = np.flatnonzero(octave == o)
        most = int(math.ceil(periods[who].max() / width)) + oversample + 1
        few = folds.sparse(len(tau), width * boxes[-1] / periods[who].min(), most, len(boxes))
        step = max(1, 2 * CACHED // len(tau) if few else CACHED // most)
        for a in range(0, len(who), step):
            rows = who[a : a + step]
            p = periods[rows]
            slots = np.ceil(p / width).astype(np.int64) + oversample
            m = len(rows)
            b = (np.mod(tau[None, :], p[:, None]) / width).astype(np.int64) + 1
            if few:
                out[rows] = np.sqrt(folds.box_runs(b, yc * iv, iv, slots, oversample, boxes[boxes < most], floor)[0] * total_iv)
                continue
            b = (b + np.arange(m)[:, None] * most).ravel()
            sums = []
            for x in (yc * iv, iv):
                h = np.bincount(b, np.tile(x, m), m * most).reshape(m, most)
                ends = (slots - oversample)[:, None] + np.arange(oversample)
                np.put_along_axis(h, ends, h[:, 1 : oversample + 1], axis=1)  # the begin of the period once more, from its last slot on
                h[np.arange(most)[None, :] > slots[:, None]] = 0
                sums.append(np.cumsum(h, axis=1))
            ca, cv = sums
            best = np.zeros(m)
            least, short = floor * total_iv, int(slots.min())
            for kd in boxes:
                if kd >= most:
                    continue
                ina, inv = ca[:, kd:] - ca[:, :-kd], cv[:, kd:] - cv[:, :-kd]
                np.minimum(ina, 0, out=ina)  # what is no dip scores nothing
                rest = total_iv - inv
                rest *= inv
                np.putmask(rest, rest <= least, np.inf)
                ina *= ina
                ina /= rest
                if most - 1 > short:  # ends behind the period of some trials
                    tail = ina[:, short + 1 - kd :]
                    tail[np.arange(short + 1, most)[None, :] > slots[:, None]] = 0
                best = np.maximum(best, ina.max(axis=1))
            out[rows] = np.sqrt(best * total_iv)
    return out


def tls(tau, y, dy, frequencies, n_bins: int = 256, shapes: int = 5):
    """Transit least squares: matched filter of limb-darkened shapes, standardised over the grid."""
    w = 1.0 / dy**2 if dy is not None and np.isfinite(dy).all() else np.ones(len(y))
    yc = y - np.sum(w * y) / np.sum(w)
    widths = np.unique(np.clip(np.rint(np.geomspace(0.01, 0.1, shapes) * n_bins).astype(int), 1, n_bins))
    shapes_ = [tuple(limb_darkened(int(k))) for k in widths]
    if folds.few_points(w, n_bins, tuple(shapes_)):
        out = folds.shape_powers(tau, 1.0 / frequencies, w * yc, w, n_bins, tuple(shapes_))
        return (out - out.mean()) / sd if (sd := out.std()) > 0 else np.zeros_like(out)
    out = np.zeros(len(frequencies))
    step = max(1, CACHED // max(len(y), n_bins))
    for at in range(0, len(frequencies), step):
        part = slice(at, at + step)
        f = frequencies[part]
        m = len(f)
        b = (np.minimum((_phase(tau, f) * n_bins).astype(np.int64), n_bins - 1) + np.arange(m)[:, None] * n_bins).ravel()
        a, v = (np.fft.rfft(np.bincount(b, np.tile(x, m), m * n_bins).reshape(m, n_bins), axis=1) for x in (w * yc, w))
        best = np.zeros(m)
        for g in shapes_:
            best = np.maximum(best, folds.residues(a, v, n_bins, w.sum(), g)[0].max(axis=1))
        out[part] = best
    sd = out.std()
    return (out - out.mean()) / sd if sd > 0 else np.zeros_like(out)


class _Lines:
    """Weighted straight lines through each circular window of ``window`` points, at its middle point, for each row; what depends on abscissae and weights alone is kept for all ordinates."""

    def __init__(self, x: np.ndarray, w: np.ndarray, window: int) -> None:
        self.h, self.x, self.w = window // 2, x, w
        self.wp, xp = self._around(w), self._around(x, 1.0)
        self.wxp = self.wp * xp
        self.sums = self._sum(self.wp), self._sum(self.wxp), self._sum(self.wxp * xp)

    def _around(self, v: np.ndarray, step: float = 0.0) -> np.ndarray:
        return np.concatenate([v[:, -self.h :] - step, v, v[:, : self.h] + step], axis=1)

    def _sum(self, v: np.ndarray) -> np.ndarray:
        c = np.cumsum(v, axis=1)
        each = c[:, 2 * self.h :].copy()
        each[:, 1:] -= c[:, : -2 * self.h - 1]
        return each

    def at(self, y: np.ndarray, leave_out: bool = False) -> np.ndarray:
        yp = self._around(y)
        (s, sx, sxx), sy, sxy = self.sums, self._sum(self.wp * yp), self._sum(self.wxp * yp)
        if leave_out:
            own = self.w * self.x
            s, sx, sy, sxx, sxy = s - self.w, sx - own, sy - self.w * y, sxx - own * self.x, sxy - own * y
        d = s * sxx - sx * sx
        with np.errstate(all="ignore"):
            slope = np.where(d > 32 * np.finfo(float).eps * s * sxx, (s * sxy - sx * sy) / d, 0.0)
            return (sy - slope * sx) / s + slope * self.x


def supersmoother(tau, y, dy, frequencies, spans=(0.05, 0.2, 0.5), bass: float = 0.0):
    """Variable-span smoother score (Friedman 1984): 1 - mean |residual| / mean |deviation|.

    ``bass`` from 0 to 10 moves spans to the longest one where its residuals are hardly larger: by the share (best / longest)^(10 - bass).
    """
    n = len(y)
    e = dy if dy is not None and np.isfinite(dy).all() else np.ones(n)
    w = 1.0 / e**2
    base = np.mean(np.abs(y - np.sum(w * y) / w.sum()) / e)
    if base <= 0 or n < 4:
        return np.zeros(len(frequencies))
    windows = [min(max(3, int(s * n) | 1), 2 * ((n - 1) // 2) + 1) for s in spans]
    out = np.empty(len(frequencies))
    for part, f in _chunks(frequencies, n * (CHUNK // CACHED)):
        x, o = _sorted_phases(tau, f)
        v, wt, er = y[o], w[o], e[o]
        lines = {k: _Lines(x, wt, k) for k in dict.fromkeys(windows)}
        fits = np.stack([lines[k].at(v, True) for k in windows])
        residual = np.stack([lines[windows[1]].at(np.abs(v - s) / er) for s in fits])
        span = np.array(spans)[np.argmin(residual, axis=0)]
        if bass > 0:
            least = residual.min(axis=0)
            with np.errstate(all="ignore"):
                share = np.where((least < residual[-1]) & (least > 0), np.maximum(1e-7, least / residual[-1]) ** (10 - bass), 0.0)
            span = span + (spans[-1] - span) * share
        span = lines[windows[1]].at(span)
        at = np.clip(np.searchsorted(spans, span) - 1, 0, len(spans) - 2)
        share = np.clip((span - np.array(spans)[at]) / np.diff(spans)[at], 0, 1)
        low, high = (np.take_along_axis(fits, k[None], axis=0)[0] for k in (at, at + 1))
        model = lines[windows[0]].at((1 - share) * low + share * high)
        out[part] = 1 - np.mean(np.abs(v - model) / er, axis=1) / base
    return out


METHODS: dict[str, Callable] = {"gls": gls, "pdm": pdm, "ce": ce, "sl": sl, "mhaov": mhaov, "bls": bls, "tls": tls, "supersmoother": supersmoother}


def frequency_grid(baseline: float, fmax: float, samples_per_peak: float = 5.0, fmin: float | None = None, limit: int = 5_000_000) -> np.ndarray:
    """Uniform grid from 1/T (or ``fmin``); refuses more than ``limit`` trials."""
    df = 1.0 / (samples_per_peak * baseline)
    f0 = 1.0 / baseline if fmin is None else fmin
    nf = max(1, int(math.ceil((fmax - f0) / df)) + 1)
    if nf > limit:
        raise ValueError(f"{nf} trials exceed the limit of {limit}")
    return f0 + df * np.arange(nf)


def _points(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    pdf = pdf.sort_values(["t", "rid"])
    t, y, dy = (pdf[c].to_numpy(float) for c in ("t", "y", "dy"))
    return t, y, dy if np.isfinite(dy).all() else None


def _no_rows(whole: list[str], numbers: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"object_id": pd.Series([], dtype=object), **{c: pd.Series([], dtype="int64") for c in whole}, **{c: pd.Series([], dtype="float64") for c in numbers}})


#: Settings that each method takes beside its grid.
SETTINGS = {
    "gls": {"fit_mean"}, "pdm": {"n_bins", "n_covers"}, "ce": {"n_phase", "n_mag"}, "sl": set(), "mhaov": {"harmonics"},
    "bls": {"n_durations", "oversample"}, "tls": {"n_bins", "shapes"}, "supersmoother": {"spans", "bass"},
}


def list_methods() -> list[str]:
    return sorted(METHODS)


def get_method(name: str, **settings) -> Callable:
    """The kernel of a method (letters in either case, hyphens and blanks as underscores) after a check of its settings."""
    key = re.sub("[-_ ]+", "", name.lower())
    found = next((m for m in METHODS if m.replace("_", "") == key), None) or {"lombscargle": "gls", "conditionalentropy": "ce", "stringlength": "sl", "aov": "mhaov"}.get(key)
    if found is None:
        raise ValueError(f"unknown method {name!r}; there are {', '.join(list_methods())}")
    if wrong := set(settings) - SETTINGS[found]:
        raise ValueError(f"{found} has no setting {', '.join(sorted(wrong))}")
    return METHODS[found]


def _grid_of(pdf: pd.DataFrame, nf: int | None, fmax: float | None, span: float) -> np.ndarray:
    """The object's trials; none where the grid table has no row for it."""
    if "_nf" in pdf:
        row = pdf.iloc[0]
        return row["_f0"] + row["_df"] * np.arange(int(row["_nf"])) if np.isfinite(row["_nf"]) else np.zeros(0)
    return 1.0 / span + np.arange(nf) * (1.0 / (5.0 * span)) if nf else frequency_grid(span, fmax)


def _with_grid(obs: DataFrame, grid: DataFrame | None, nf: int | None = None, relative: float = 1.0) -> DataFrame:
    """Points with their object's grid beside them (null where it has none), hashed by object to tasks for the work that they are. ``relative``: cost of a trial and point against a plain fold."""
    total = relative * spread.estimated_work(obs, nf)
    if grid is not None:
        obs = obs.join(grid.select("object_id", F.col("f0").alias("_f0"), F.col("df").alias("_df"), F.col("nf").cast("double").alias("_nf")), "object_id", "left")
    return spread.deal(obs, total, "object_id")


#: Cost of a point and trial against phase dispersion.
RELATIVE = {"gls": 0.1, "pdm": 1.0, "ce": 1.0, "sl": 3.0, "mhaov": 0.5, "bls": 20.0, "tls": 3.0, "supersmoother": 40.0}


def spectrum(obs: DataFrame, method: str, nf: int | None = None, fmax: float | None = None, grid: DataFrame | None = None, **settings) -> DataFrame:
    """object_id, k, f, power of each object: ``nf`` trials from 1/T in steps of 1/(5T), up to ``fmax``, or those of ``grid`` (see ``grids``)."""
    kernel = get_method(method, **settings)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, y, dy = _points(pdf)
        span = t[-1] - t[0] if len(t) else 0.0
        if span <= 0:
            return _no_rows(["k"], ["f", "power"])
        f = _grid_of(pdf, nf, fmax, span)
        if not len(f):
            return _no_rows(["k"], ["f", "power"])
        p = kernel(t - t[0], y, dy, f, **settings)
        return pd.DataFrame({"object_id": pdf["object_id"].iloc[0], "k": np.arange(len(f)), "f": f, "power": p})

    return _with_grid(obs, grid, nf, RELATIVE.get(method, 1.0)).groupBy("object_id").applyInPandas(run, "object_id string, k long, f double, power double")


def best_periods(obs: DataFrame, method: str, nf: int | None = None, n: int = 1, separation: int = 15, grid: DataFrame | None = None, **settings) -> DataFrame:
    """The ``n`` best trials of each object without returning its spectrum: object_id, rank, k, period, f, power, fap."""
    kernel = get_method(method, **settings)

    def run(objects: list[pd.DataFrame]) -> pd.DataFrame:
        cols = {"object_id": [], "rank": [], "k": [], "period": [], "f": [], "power": [], "fap": []}
        for pdf in objects:
            t, y, dy = _points(pdf)
            span = t[-1] - t[0] if len(t) else 0.0
            f = _grid_of(pdf, nf, None, span) if span > 0 else ()
            if not len(f):
                continue
            p = kernel(t - t[0], y, dy, f, **settings)
            score = np.round(np.where(np.isfinite(p), -p if method in MINIMISED else p, -np.inf), 9)
            taken: list[int] = []
            free = np.ones(len(f), dtype=bool)
            while len(taken) < n and free.any():
                k = int(np.flatnonzero(free)[np.argmax(score[free])])
                taken.append(k)
                free[max(0, k - separation + 1) : k + separation] = False
            for r, k in enumerate(taken):
                fap = float(special.baluev_fap(p[k], t, _weights(dy, len(t)), f[-1])) if method == "gls" else float("nan")
                for c, v in zip(cols, (pdf["object_id"].iloc[0], r + 1, k, 1 / f[k], f[k], p[k], fap), strict=True):
                    cols[c].append(v)
        return pd.DataFrame(cols) if cols["rank"] else _no_rows(["rank", "k"], ["period", "f", "power", "fap"])

    return spread.in_blocks(_with_grid(obs, grid, nf, RELATIVE.get(method, 1.0)), run, "object_id string, rank long, k long, period double, f double, power double, fap double")


def periodogram(obs: DataFrame, method: str = "gls", n: int = 1, grid_settings: dict | None = None, **settings) -> DataFrame:
    """The ``n`` best periods of each object on the method's automatic grid."""
    kernel_name = next(k for k, v in METHODS.items() if v is get_method(method, **settings))
    return best_periods(obs, kernel_name, n=n, grid=grids.default_grid(obs, kernel_name, **(grid_settings or {})), **settings)
