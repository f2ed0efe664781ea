"""Multi-band kernels and resampled significance: one grouped call per object, bands inside it."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import kernels


def _bands(pdf: pd.DataFrame, least: int) -> tuple[float, float, list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]]:
    """Time origin, baseline, and (tau, y, dy) of the bands with ``least`` points or more; errors are used by all or none."""
    pdf = pdf.sort_values(["t", "rid"])
    t0, span = pdf["t"].iloc[0], pdf["t"].iloc[-1] - pdf["t"].iloc[0]
    good = bool(np.isfinite(pdf["dy"].to_numpy(float)).all())
    parts = [g for _, g in pdf.groupby("band", dropna=True) if len(g) >= least]
    return t0, span, [(g["t"].to_numpy(float) - t0, g["y"].to_numpy(float), g["dy"].to_numpy(float) if good else None) for g in parts]


def offsets(bands, f: np.ndarray) -> np.ndarray:
    """Power of one sinusoid shared by all bands, with a constant per band."""
    w = [np.ones(len(y)) if dy is None else 1 / dy**2 for _, y, dy in bands]
    total = sum(x.sum() for x in w)
    cc = ss = cs = y1 = y2 = np.zeros(len(f))
    ref = 0.0
    for (tau, y, _), x in zip(bands, w, strict=True):
        x = x / total
        share = x.sum()
        v = y - np.sum(x * y) / share
        ref += np.sum(x * v * v)
        once, data = kernels._trig_sums(tau, np.stack([x, x * v]), f)
        twice = kernels._trig_sums(2 * tau, x[None, :], f)[0]
        cm, sm = once.real, once.imag
        cc = cc + (share + twice.real) / 2 - cm * cm / share
        ss = ss + (share - twice.real) / 2 - sm * sm / share
        cs = cs + twice.imag / 2 - cm * sm / share
        y1, y2 = y1 + data.real, y2 + data.imag
    d = cc * ss - cs * cs
    with np.errstate(all="ignore"):
        p = (ss * y1**2 + cc * y2**2 - 2 * cs * y1 * y2) / (d * ref)
    return np.where(np.isfinite(p) & (d > 1e-12), np.clip(p, 0, 1), 0.0)


def flexible(bands, f: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """A shared sinusoid plus a ridge-penalised sinusoid per band (VanderPlas & Ivezic 2015): explained share."""
    k, n = len(bands), sum(len(y) for _, y, _ in bands)
    tau = np.concatenate([b[0] for b in bands])
    band = np.repeat(np.arange(k), [len(b[1]) for b in bands])
    w = np.concatenate([np.ones(len(y)) if dy is None else 1 / dy**2 for _, y, dy in bands])
    y = np.concatenate([v - np.average(v, weights=None if dy is None else 1 / dy**2) for _, v, dy in bands])
    ref = np.sum(w * y * y)
    one = (band[:, None] == np.arange(k)).astype(float)
    out = np.zeros(len(f))
    if ref <= 0 or n <= k + 2:
        return out
    for i, x in enumerate(f):
        c, s = np.cos(2 * np.pi * x * tau)[:, None], np.sin(2 * np.pi * x * tau)[:, None]
        b = np.hstack([one, c, s, one * c, one * s])
        h = b.T @ (w[:, None] * b)
        h[np.arange(k + 2, 3 * k + 2), np.arange(k + 2, 3 * k + 2)] += ridge * np.trace(h) / len(h)
        g = b.T @ (w * y)
        beta = np.linalg.lstsq(h, g, rcond=None)[0]
        out[i] = max(0.0, 1 - np.sum(w * (y - b @ beta) ** 2) / ref)
    return out


def aov(bands, f: np.ndarray, harmonics: int = 3) -> np.ndarray:
    """Pooled F of bands in units of their own scatter."""
    return aov_rows([(tau, y[None, :]) for tau, y, _ in bands], f, harmonics)[0]


def aov_rows(bands, f: np.ndarray, harmonics: int = 3) -> np.ndarray:
    """``aov`` of several draws of values at the same times: bands are (tau, values by draw)."""
    draws = len(bands[0][1]) if bands else 1
    model, left, dof1, dof2 = np.zeros((draws, len(f))), np.zeros((draws, len(f))), np.zeros((draws, 1), dtype=int), np.zeros((draws, 1), dtype=int)
    for tau, y in bands:
        n, q = y.shape[1], 2 * harmonics + 1
        use = y.std(axis=1, keepdims=True) > 0
        if n <= q or not use.any():
            continue
        v = (y - y.mean(axis=1, keepdims=True)) / np.where(use, y.std(axis=1, keepdims=True), 1.0)
        power = kernels.mhaov_rows(tau, v, f, harmonics) * (2 * harmonics) / (n - q)  # model over rest
        share = power / (1 + power)
        model, left = model + use * share * n, left + use * (1 - share) * n
        dof1, dof2 = dof1 + use * 2 * harmonics, dof2 + use * (n - q)
    return np.where(dof2 > 0, (model / np.maximum(dof1, 1)) / (np.maximum(left, 1e-300) / np.maximum(dof2, 1)), np.nan)


def smoother(bands, f: np.ndarray) -> np.ndarray:
    """Mean smoother score, bands weighted by their scaled mean deviation."""
    weight = [np.mean(np.abs(y - y.mean()) / (1 if dy is None else dy)) * len(y) for _, y, dy in bands]
    return sum(w * kernels.supersmoother(*b, f) for b, w in zip(bands, weight, strict=True)) / max(sum(weight), 1e-300)


def box(bands, f: np.ndarray) -> np.ndarray:
    """Root of the sum over bands of the squared depth signal-to-noise of their own best boxes."""
    return np.sqrt(sum(np.maximum(kernels.bls(*b, f), 0) ** 2 for b in bands))


def joint_box(bands, f: np.ndarray, n_durations: int = 8, oversample: int = 10) -> np.ndarray:
    """Signal-to-noise of the deepest box with one depth, time and duration in all bands, each about its own level."""
    w = [np.ones(len(y)) if dy is None else 1 / dy**2 for _, y, dy in bands]
    v = [(y - np.sum(x * y) / x.sum()) * x for (_, y, _), x in zip(bands, w, strict=True)]
    total, periods, out = sum(x.sum() for x in w), 1.0 / f, np.zeros(len(f))
    lowest = periods.min()
    for i, p in enumerate(periods):
        base = lowest * 2.0 ** np.floor(np.log2(p / lowest) + 1e-12)
        durations = np.geomspace(0.01 * base, 0.12 * base, n_durations)
        width = durations[0] / oversample
        slots = int(np.ceil(p / width))
        sums = []
        for (tau, _, _), x, z in zip(bands, w, v, strict=True):
            b = (np.mod(tau, p) / width).astype(np.int64)
            h = np.stack([np.bincount(b, z, slots + 1)[:slots], np.bincount(b, x, slots + 1)[:slots]])
            sums.append(np.cumsum(np.concatenate([np.zeros((2, 1)), h, h], axis=1), axis=1))  # a box may run over the end of the period
        for kd in np.unique(np.floor(durations / width + 0.5).astype(np.int64)):
            if kd >= slots:
                continue
            inside = [c[:, kd : kd + slots] - c[:, :slots] for c in sums]
            depth = -sum(x[0] for x in inside)
            weight = sum(x[1] * (1 - x[1] / z.sum()) for x, z in zip(inside, w, strict=True))
            good = (weight > 1e-9 * total) & (depth > 0)
            if good.any():
                out[i] = max(out[i], float((depth[good] / np.sqrt(weight[good])).max()))
    return out


METHODS = {"offsets": (offsets, 3), "flexible": (flexible, 3), "mhaov": (aov, 8), "supersmoother": (smoother, 8), "bls": (box, 8), "joint_bls": (joint_box, 4)}


def spectrum(obs: DataFrame, method: str, nf: int) -> DataFrame:
    """object_id, k, f, power on the object's grid 1/T + k/(5T); objects without a usable band give no rows."""
    kernel, least = METHODS[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, span, bands = _bands(pdf, least)
        if span <= 0 or not bands:
            return kernels._no_rows(["k"], ["f", "power"])
        f = 1.0 / span + np.arange(nf) * (1.0 / (5.0 * span))
        return pd.DataFrame({"object_id": pdf["object_id"].iloc[0], "k": np.arange(nf), "f": f, "power": kernel(bands, f)})

    return kernels._with_grid(obs, None, nf, 10.0).groupBy("object_id").applyInPandas(run, "object_id string, k long, f double, power double")


def bootstrap_fap(obs: DataFrame, nf: int | None = None, resamples: int = 100, seed: int = 0, model: str = "offsets", grid: DataFrame | None = None, levels: tuple[float, ...] = (0.1,)) -> DataFrame:
    """object_id, power, fap and level_P for each chance of P per cent in ``levels``: the peak of any multi-band ``model`` against maxima over the same grid of values that are drawn anew within each band.

    The grid has ``nf`` trials from 1/T, or is the object's row of ``grid`` (object_id, f0, df, nf). The stream of each
    object depends on its name and the seed alone, so a task that runs again gives the same.
    """
    if model not in METHODS:
        raise ValueError(f"unknown model {model!r}; there are {', '.join(sorted(METHODS))}")
    kernel, least = METHODS[model]
    names = [f"level_{round(100 * x):d}" for x in levels]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, span, bands = _bands(pdf, least)
        none = pd.DataFrame({"object_id": pd.Series([], dtype=object), **{c: pd.Series([], dtype=float) for c in ("power", "fap", *names)}})
        f = kernels._grid_of(pdf, nf, None, span) if span > 0 and bands else np.zeros(0)
        if not len(f):
            return none
        peak = kernel(bands, f).max()
        rng = np.random.default_rng([seed, zlib.crc32(str(pdf["object_id"].iloc[0]).encode())])
        null = np.empty(resamples)
        draws = [[rng.integers(0, len(y), len(y)) for _, y, _ in bands] for _ in range(resamples)]
        if model == "mhaov":  # takes no errors, so that all draws share what depends on times alone
            step = max(1, kernels.CHUNK // (7 * len(f)))
            for a in range(0, resamples, step):
                null[a : a + step] = aov_rows([(tau, np.stack([y[d[b]] for d in draws[a : a + step]])) for b, (tau, y, _) in enumerate(bands)], f).max(axis=1)
        else:
            for i, d in enumerate(draws):
                null[i] = kernel([(tau, y[j], None if dy is None else dy[j]) for (tau, y, dy), j in zip(bands, d, strict=True)], f).max()
        fap = (1 + np.count_nonzero(null >= peak)) / (resamples + 1)
        null.sort()
        at = [null[min(resamples - 1, int((1 - x) * resamples))] for x in levels]
        return pd.DataFrame([[pdf["object_id"].iloc[0], peak, fap, *at]], columns=list(none.columns))

    schema = "object_id string, power double, fap double, " + ", ".join(f"{c} double" for c in names)
    return kernels._with_grid(obs, grid, nf, 10.0 * resamples).groupBy("object_id").applyInPandas(run, schema)
