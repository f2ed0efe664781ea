"""Transit search with the transit: matched filters of limb-darkened shapes over folded bins, (object, piece) as the unit of work.

At each trial period the points are folded to ``n_bins`` bins and fitted with a level
and a shape of each width at each start; sums over all starts come from Fourier
transforms (``folds``). What a fit lowers chi2 by is the signal residue (power); ``sde`` is how far
the best one stands above the mean of all trials. The pieces, their dealing and their
merging are ``box_search``'s.

Defined results: a shape must be a dip; trials without one have power 0 and null depth,
duration and t0; constant values give none. Null errors count as one. Objects without
trials are in ``box_search.not_searched``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import box_search, folds, grids, spread
from .boxes import limb_darkened

FIELDS = ("power", "depth", "duration", "t0")
#: Bins of a fold, and shortest and longest shape as shares of the period with the number of shapes.
N_BINS = 256
SHAPES = (0.01, 0.10, 5)
#: Values of a working array that stays in a processor's cache; digits of a power that count, as transforms round.
CACHED = 1 << 15
DIGITS = 6


def widths(n_bins: int = N_BINS, shapes: tuple[float, float, int] = SHAPES) -> list[int]:
    """Shape lengths in bins, without repeats."""
    return np.unique(np.clip(np.rint(np.geomspace(shapes[0], shapes[1], shapes[2]) * n_bins).astype(int), 1, n_bins)).tolist()


def transits(tau: np.ndarray, y: np.ndarray, dy: np.ndarray | None, periods: np.ndarray, n_bins: int = N_BINS, lengths: list[int] | None = None) -> dict[str, np.ndarray]:
    """FIELDS of each period; t0 is the first middle of a transit from tau = 0 on."""
    lengths = widths(n_bins) if lengths is None else lengths
    out = {c: np.zeros(len(periods)) for c in FIELDS}
    w = 1.0 / dy**2 if dy is not None and np.isfinite(dy).all() else np.ones(len(y))
    total, level = w.sum(), np.sum(w * y) / w.sum()
    if np.ptp(y) <= 64 * np.finfo(float).eps * np.max(np.abs(y), initial=0):
        return out
    yc = y - level
    filters = [(k, tuple(limb_darkened(int(k)))) for k in lengths]
    step = max(1, CACHED // max(len(tau), n_bins))
    for a in range(0, len(periods), step):
        p = periods[a : a + step]
        m = len(p)
        q = tau[None, :] / p[:, None]
        b = (np.minimum(((q - np.floor(q)) * n_bins).astype(np.int64), n_bins - 1) + np.arange(m)[:, None] * n_bins).ravel()
        data, weight = (np.fft.rfft(np.bincount(b, np.tile(x, m), m * n_bins).reshape(m, n_bins), axis=1) for x in (w * yc, w))
        best, rows = np.zeros(m), np.arange(m)
        for k, g in filters:
            sr, num, d = folds.residues(data, weight, n_bins, total, g)
            most = sr.max(axis=1)
            better = np.flatnonzero((most > 0) & (most > best * (1 + 1e-9)))
            best[better] = most[better]
            at, where = a + better, np.argmax(sr[better] >= (most[better] * (1 - 1e-9))[:, None], axis=1)
            out["depth"][at] = -num[rows[better], where] / d[rows[better], where]
            out["duration"][at] = k / n_bins * p[better]
            out["t0"][at] = np.mod((where + k / 2) / n_bins, 1.0) * p[better]
        out["power"][a : a + m] = best
    return out


def powers(tau: np.ndarray, y: np.ndarray, dy: np.ndarray | None, periods: np.ndarray, n_bins: int = N_BINS, lengths: list[int] | None = None) -> np.ndarray:
    """The power of ``transits`` alone."""
    w = 1.0 / dy**2 if dy is not None and np.isfinite(dy).all() else np.ones(len(y))
    shapes = tuple(tuple(limb_darkened(int(k))) for k in (widths(n_bins) if lengths is None else lengths))
    if np.ptp(y) <= 64 * np.finfo(float).eps * np.max(np.abs(y), initial=0) or not folds.few_points(w, n_bins, shapes):
        return transits(tau, y, dy, periods, n_bins, lengths)["power"]
    return folds.shape_powers(tau, periods, w * (y - np.sum(w * y) / w.sum()), w, n_bins, shapes)


def _run(obs: DataFrame, grid: DataFrame | None, n_bins: int, lengths: list[int] | None, min_points: int, whole: bool, work: float) -> DataFrame:
    segments = (grids.transit_grid(obs) if grid is None else grid).select("object_id", F.lit(0).cast("long").alias("segment"), F.lit(0.0).alias("p_lo"), "f0", "df", "nf")

    def kernel(tau: np.ndarray, y: np.ndarray, dy: np.ndarray, periods: np.ndarray, p_lo: float) -> dict[str, np.ndarray]:
        return transits(tau, y, dy, periods, n_bins, lengths)

    def powers_of(tau: np.ndarray, y: np.ndarray, dy: np.ndarray, periods: np.ndarray, p_lo: float) -> np.ndarray:
        return powers(tau, y, dy, periods, n_bins, lengths)

    out = box_search.spread_trials(obs, segments, kernel, FIELDS, min_points, whole, work, DIGITS, powers_of)
    return out.withColumns({c: F.when(F.col("power") > 0, F.col(c)) for c in FIELDS[1:]})


def spectrum(obs: DataFrame, grid: DataFrame | None = None, n_bins: int = N_BINS, lengths: list[int] | None = None, min_points: int = 4, work: float = spread.WORK / 4) -> DataFrame:
    """object_id, k, period and FIELDS of every trial of ``grid`` (``grids.transit_grid``, the default)."""
    return _run(obs, grid, n_bins, lengths, min_points, True, work).drop("segment")


def search(obs: DataFrame, grid: DataFrame | None = None, n_bins: int = N_BINS, lengths: list[int] | None = None, min_points: int = 4, work: float = spread.WORK / 4) -> DataFrame:
    """The best transit of each object: object_id, trials, k, period, FIELDS and sde."""
    return box_search.merge_pieces(_run(obs, grid, n_bins, lengths, min_points, False, work), FIELDS, DIGITS).drop("segment")
