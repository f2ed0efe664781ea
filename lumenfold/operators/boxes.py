"""Transit searches on short grids: histograms, window sums and templates of one object's folds at once.

Points are dealt by object for the work that they are and packed, and each object's
folds stay in memory: only the best box of each trial leaves its task, and nothing but
the points is shuffled. Points without a time or a value take no part; null errors
count as one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spread

FOUND = "object_id string, k int, p double, power double, depth double, width int, start long"


def limb_darkened(n: int, u1: float = 0.4, u2: float = 0.3) -> list[float]:
    """Peak-normalised transit shape of ``n`` bins under quadratic limb darkening."""
    mu = [math.sqrt(1 - (2 * abs((i + 0.5) / n - 0.5)) ** 2) for i in range(n)]
    g = [1 - u1 * (1 - m) - u2 * (1 - m) ** 2 for m in mu]
    return [x / max(g) for x in g]


def _histograms(t: np.ndarray, y: np.ndarray, dy: np.ndarray, nf: int, n_bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trial periods, and (trial, bin) sums of weighted values and of weights; no trials without a baseline."""
    tau = t - t.min()
    baseline = tau.max()
    if not baseline > 0:
        return np.zeros(0), np.zeros((0, n_bins)), np.zeros((0, n_bins))
    iv = 1.0 / (dy * dy)
    yc = y - np.sum(iv * y) / np.sum(iv)
    p = 1.0 / (1.0 / baseline + np.arange(nf) * (1.0 / (5.0 * baseline)))
    q = tau[None, :] / p[:, None]
    at = (np.minimum(np.floor((q - np.floor(q)) * n_bins).astype(np.int64), n_bins - 1) + np.arange(nf)[:, None] * n_bins).ravel()
    a, w = (np.bincount(at, np.tile(x, nf), nf * n_bins).reshape(nf, n_bins) for x in (iv * yc, iv))
    return p, a, w


def _window(x: np.ndarray, shape: list[float]) -> np.ndarray:
    """Sums of ``shape`` times the bins from each bin on; bins after the last are the first ones."""
    return sum(g * np.roll(x, -j, axis=1) for j, g in enumerate(shape))


def _best(score: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trials with any finite score of (trial, width, start), and the place of the first highest one."""
    s = np.where(np.isfinite(score), np.round(score, digits), -np.inf).reshape(len(score), -1)
    at = np.argmax(s, axis=1)
    found = np.flatnonzero(s[np.arange(len(s)), at] > -np.inf)
    return found, at[found] // score.shape[2], at[found] % score.shape[2]


def _box_scores(a: np.ndarray, iv: np.ndarray, widths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Depth signal-to-noise and depth of (trial, width, start); nan where there is no box or no dip."""
    ones = [[1.0] * w for w in widths]
    sa, si = (np.stack([_window(x, g) for g in ones], axis=1) for x in (a, iv))
    a_all, iv_all = (x.sum(axis=1)[:, None, None] for x in (a, iv))
    good = (si > 1e-9 * iv_all) & (iv_all - si > 1e-9 * iv_all)
    with np.errstate(all="ignore"):
        depth = (a_all - sa) / (iv_all - si) - sa / si
        snr = depth / np.sqrt(1 / si + 1 / (iv_all - si))
    return np.where(good & (depth >= 0), snr, np.nan), depth


def _transit_scores(a: np.ndarray, iv: np.ndarray, widths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Signal residue and depth of (trial, width, start), fitted jointly with the level; nan where there is no dip."""
    shapes = [[round(g, 9) for g in limb_darkened(w)] for w in widths]
    num, cw = (np.stack([_window(x, g) for g in shapes], axis=1) for x in (a, iv))
    den = np.stack([_window(iv, [x * x for x in g]) for g in shapes], axis=1)
    with np.errstate(all="ignore"):
        d = den - cw * cw / iv.sum(axis=1)[:, None, None]
        good = (num < 0) & (den > 1e-300) & (d > 1e-9 * den)
        return np.where(good, num * num / d, np.nan), -num / d


def _search(obs: DataFrame, nf: int, n_bins: int, widths: tuple[int, ...], digits: int, scores: Callable) -> DataFrame:
    usable = obs.where("t IS NOT NULL AND y IS NOT NULL")
    points = F.array_sort(F.collect_list(F.struct("t", "rid", "y", F.coalesce(F.col("dy"), F.lit(1.0)).alias("dy"))))
    # every trial also passes over its bins, once a bin of each width
    dealt = spread.deal(usable, spread.estimated_work(usable, nf * (1 + sum(widths))), "object_id")
    packed = dealt.groupBy("object_id").agg(points.alias("p")).select("object_id", F.col("p.t").alias("t"), F.col("p.y").alias("y"), F.col("p.dy").alias("dy"))
    columns = [c.split()[0] for c in FOUND.split(", ")]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parts = []
            for r in pdf.itertuples():
                p, a, iv = _histograms(*(np.asarray(x, dtype=float) for x in (r.t, r.y, r.dy)), nf, n_bins)
                score, depth = scores(a, iv, widths)
                k, w, b = _best(score, digits)
                parts.append((np.full(len(k), r.object_id, dtype=object), k, p[k], score[k, w, b], depth[k, w, b], np.array(widths)[w], b))
            if parts:
                yield pd.DataFrame(dict(zip(columns, map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    return packed.mapInPandas(run, FOUND)


def bls(obs: DataFrame, nf: int = 20, n_bins: int = 50, widths: tuple[int, ...] = (1, 2, 5), digits: int = 6) -> DataFrame:
    """Box search (Kovacs et al. 2002): the box of largest depth signal-to-noise per trial period; of equal ones the first width, then the earliest.

    Bins after the last repeat the first ones, so boxes may run over the fold.
    """
    return _search(obs, nf, n_bins, widths, digits, _box_scores)


def tls(obs: DataFrame, nf: int = 20, n_bins: int = 64, widths: tuple[int, ...] = (2, 4, 6), digits: int = 6) -> DataFrame:
    """Transit least squares as a matched filter: folded bins against limb-darkened templates, jointly with the level."""
    return _search(obs, nf, n_bins, tuple(sorted(widths)), digits, _transit_scores)
