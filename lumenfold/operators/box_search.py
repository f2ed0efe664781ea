"""Box search over period segments, with the box: (object, segment, piece) is the unit of work.

Each segment of periods is a constant factor long, uniform in frequency, with
durations and a bin width of its own, so that a box tracks the period. A segment of
much work is cut into pieces of trials; an object's points are packed once and sent
to its pieces, so one long object runs in many tasks. Every piece returns its best
box and the moments of its powers; ``max_by`` and sums merge them.

A box must be a dip. Points are binned at a tenth (``oversample``) of the shortest
duration, the first bins repeat behind the last ones, and of equal boxes the
shortest, then the earliest wins. Boxes whose weight inside or outside is within
rounding of nothing are no boxes.

Defined results: errors that are null count as one; objects without a trial period
(baseline too short) or with under ``min_points`` points are in ``not_searched``
with the reason; trials without a box have power 0 in the moments and null values in
the spectrum.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import folds, grids, spread
from .folds import TIE

OBJECTIVES = ("snr", "likelihood")
#: Shortest and longest duration as shares of a segment's shortest period, their number, and the least duration in days.
DURATIONS = (0.01, 0.12, 8)
LEAST_DURATION = 0.01
OVERSAMPLE = 10
#: Values of a working array that stays in a processor's cache.
CACHED = 1 << 15
#: Points times trials whose runs are scored at once: fewer calls, as few runs are scored.
RUNS = 1 << 16

FIELDS = ("power", "depth", "depth_err", "depth_snr", "duration", "t0", "log_likelihood")


def durations(p_lo: float, shares: tuple[float, float, int] = DURATIONS, least: float = LEAST_DURATION) -> np.ndarray:
    """Box lengths of a segment that begins at ``p_lo``: even steps of their logarithm; one, the longest, if the least duration is longer than all."""
    lo, hi = max(shares[0] * p_lo, least), shares[1] * p_lo
    return np.geomspace(lo, hi, shares[2]) if lo < hi else np.array([hi])


def widths(lengths: np.ndarray, oversample: int) -> tuple[float, np.ndarray]:
    """(bin width, box lengths in bins without repeats) of a segment."""
    width = lengths.min() / oversample
    return width, np.unique(np.floor(lengths / width + 0.5).astype(np.int64))


def boxes(tau: np.ndarray, y: np.ndarray, dy: np.ndarray | None, periods: np.ndarray, lengths: np.ndarray, oversample: int = OVERSAMPLE, objective: str = "snr") -> dict[str, np.ndarray]:
    """The best box of each period: FIELDS as arrays, t0 (its middle) counted from tau = 0; power is -inf where no box is a dip."""
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective {objective!r}; there are {', '.join(OBJECTIVES)}")
    iv = 1.0 / dy**2 if dy is not None and np.isfinite(dy).all() else np.ones(len(y))
    total = iv.sum()
    yc = y - np.sum(y * iv) / total  # then what is outside a box is minus what is inside
    floor = max(4 * len(y) * np.finfo(float).eps * total, np.finfo(float).tiny)
    width, bins = widths(lengths, oversample)
    out = {c: np.zeros(len(periods)) for c in FIELDS}
    out["power"][:] = -np.inf
    cells = int(math.ceil(periods.max() / width)) + oversample + 1 if len(periods) else 1
    few = len(periods) > 0 and folds.sparse(len(tau), width * bins[-1] / periods.min(), cells, len(bins))
    step = max(1, RUNS // len(tau) if few else CACHED // cells)
    for a in range(0, len(periods), step):
        p = periods[a : a + step]
        m, slots = len(p), np.ceil(p / width).astype(np.int64) + oversample
        most = int(slots.max()) + 1
        if few:
            at = np.minimum((folds.remainders(tau, p) / width).astype(np.int32) + 1, most - 1)
            _record(out, a, p, width, total, objective, *folds.box_runs(at, yc * iv, iv, slots, oversample, bins[bins < most], floor, objective != "snr")[1:])
            continue
        at = (np.minimum((np.mod(tau[None, :], p[:, None]) / width).astype(np.int64) + 1, most - 1) + np.arange(m)[:, None] * most).ravel()
        sums = []
        for x in (yc * iv, iv):
            h = np.bincount(at, np.tile(x, m), m * most).reshape(m, most)
            np.put_along_axis(h, (slots - oversample)[:, None] + np.arange(oversample), h[:, 1 : oversample + 1], axis=1)
            sums.append(np.cumsum(h, axis=1))
        best, start, size = np.zeros(m), np.full(m, -1), np.zeros(m, dtype=np.int64)  # squared objectives, less a common factor
        for kd in bins.tolist():
            if kd >= most:
                continue
            ina, inv = sums[0][:, kd:] - sums[0][:, :-kd], sums[1][:, kd:] - sums[1][:, :-kd]
            rest = total - inv
            bad = (inv < floor) | (rest < floor) | (ina > 0) | (np.arange(most - kd)[None, :] > (slots - kd)[:, None])
            den = inv * rest if objective == "snr" else inv * rest * rest
            den[bad] = 1.0
            ina *= ina
            ina /= den
            ina[bad] = -1.0
            v = ina.max(axis=1)
            i = np.argmax(ina >= (v - TIE * np.abs(v))[:, None], axis=1)  # boxes of the same points differ by rounding
            better = ~bad[np.arange(m), i] & ((v > best * (1 + TIE)) | (start < 0))
            best, start, size = np.where(better, v, best), np.where(better, i, start), np.where(better, kd, size)
        rows = np.arange(m)
        _record(out, a, p, width, total, objective, start, size, *(c[rows, start + size] - c[rows, start] for c in sums))
    return out


def _record(out: dict[str, np.ndarray], a: int, p: np.ndarray, width: float, total: float, objective: str, start: np.ndarray, size: np.ndarray, ina: np.ndarray, inv: np.ndarray) -> None:
    """Writes the FIELDS of the boxes found for the periods from ``a`` on."""
    found = np.flatnonzero(start >= 0)
    s, ina, inv = start[found], ina[found], inv[found]
    depth = -ina / (total - inv) - ina / inv
    error = np.sqrt(1 / inv + 1 / (total - inv))
    length = size[found] * width
    values = {"depth": depth, "depth_err": error, "depth_snr": depth / error, "duration": length, "t0": np.mod(s * width + 0.5 * length, p[found]), "log_likelihood": 0.5 * inv * depth * depth}
    for c, v in values.items():
        out[c][a + found] = v
    out["power"][a + found] = values["depth_snr" if objective == "snr" else "log_likelihood"]


def curves(obs: DataFrame) -> DataFrame:
    """One row an object: n, its first time, and its points as arrays in order of time."""
    points = F.array_sort(F.collect_list(F.struct("t", "rid", "y", F.coalesce(F.col("dy"), F.lit(1.0)).alias("dy"))))
    packed = obs.groupBy("object_id").agg(F.count("*").alias("n"), points.alias("p"))
    return packed.select("object_id", "n", F.col("p.t").alias("t"), F.col("p.y").alias("y"), F.col("p.dy").alias("dy"))


def pieces(segments: DataFrame, counts: DataFrame, work: float = spread.WORK / 4) -> DataFrame:
    """Segments cut into pieces of trials (k0 to k1) whose points times trials are some ``work`` at most."""
    s = segments.join(counts, "object_id").withColumn("size", F.greatest(F.floor(F.lit(float(work)) / F.col("n")), F.lit(1)).cast("long"))
    s = s.withColumn("k0", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("nf") - 1, F.lit(0).cast("long")), F.col("size"))))
    return s.withColumn("k1", F.least(F.col("k0") + F.col("size"), F.col("nf"))).select("object_id", "segment", "p_lo", "f0", "df", "k0", "k1", "n").where("k1 > k0")


def spread_trials(obs: DataFrame, segments: DataFrame, kernel: Callable, fields: tuple[str, ...], min_points: int, whole: bool, work: float, digits: int = 9, powers: Callable | None = None) -> DataFrame:
    """Runs ``kernel(tau, y, dy, periods, p_lo)`` -> {field: values} on all pieces of all segments: a row a trial (``whole``), or the best trial of each piece with the number, mean and squares of its powers.

    ``power`` is -inf and other fields null where a trial has nothing; ``t0`` counts from an object's first time.
    With ``powers``, which gives powers alone, other fields are found for the best trial only.
    """
    counts = obs.groupBy("object_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_points)
    cut = pieces(segments, counts, work)
    total = cut.agg(F.sum(F.col("n") * (F.col("k1") - F.col("k0")).cast("double"))).first()[0] or 0.0
    dealt = spread.deal(cut.drop("n").join(curves(obs), "object_id"), total, "object_id", "segment", "k0")
    schema = "object_id string, segment long, k long, period double, " + ", ".join(f"{c} double" for c in fields) + ("" if whole else ", trials long, mean double, m2 double")
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            best = []
            for r in pdf.itertuples():
                t, y, dy = (np.asarray(x, dtype=float) for x in (r.t, r.y, r.dy))
                k = np.arange(r.k1 - 1, r.k0 - 1, -1)  # ascending periods
                periods = 1.0 / (r.f0 + r.df * k)
                k, periods = k[periods > r.p_lo], periods[periods > r.p_lo]
                if powers is not None and not whole and len(periods):
                    power = powers(t - t[0], y, dy, periods, r.p_lo)
                    i = int(np.argmax(np.round(power, digits)))  # of equal ones the shortest period
                    got = {c: v[0] for c, v in kernel(t - t[0], y, dy, periods[i : i + 1], r.p_lo).items()}
                    got["t0"] += t[0]
                    best.append([r.object_id, r.segment, int(k[i]), periods[i], *(got[c] for c in fields), len(power), power.mean(), float(np.sum((power - power.mean()) ** 2))])
                    continue
                got = kernel(t - t[0], y, dy, periods, r.p_lo)
                real = np.isfinite(got["power"])
                got["t0"] = np.where(real, got["t0"] + t[0], 0.0)
                if whole:
                    rows = pd.DataFrame({"object_id": r.object_id, "segment": r.segment, "k": k, "period": periods, **{c: np.where(real, v, np.nan) for c, v in got.items()}})
                    yield rows[columns]
                elif len(periods):
                    power = np.where(real, got["power"], 0.0)
                    i = int(np.argmax(np.round(got["power"], digits)))  # of equal ones the shortest period
                    best.append([r.object_id, r.segment, int(k[i]), periods[i], *(got[c][i] if real[i] else math.nan for c in fields), len(power), power.mean(), float(np.sum((power - power.mean()) ** 2))])
            if best:  # a frame for each piece takes longer than some of the pieces
                yield pd.DataFrame(best, columns=columns)

    out = dealt.mapInPandas(run, schema)
    return out.select([F.when(~F.isnan(c), F.col(c)).alias(c) if c in fields else F.col(c) for c in columns])


def merge_pieces(parts: DataFrame, fields: tuple[str, ...], digits: int = 9) -> DataFrame:
    """The best trial of each object from ``spread_trials``: object_id, trials, segment, k, period, fields, and sde. Of equal powers the shortest period wins."""
    order = F.struct(F.round(F.coalesce("power", F.lit(float("-inf"))), digits), -F.col("period"))
    best = F.max_by(F.struct("segment", "k", "period", *fields), order).alias("b")
    s = parts.groupBy("object_id").agg(best, F.sum("trials").alias("trials"), (F.sum(F.col("trials") * F.col("mean")) / F.sum("trials")).alias("mean"), F.sum(F.col("m2") + F.col("trials") * F.col("mean") * F.col("mean")).alias("square"))
    sd = F.sqrt(F.greatest(F.col("square") / F.col("trials") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return s.select("object_id", "trials", "b.*", F.when(sd > 0, (F.coalesce(F.col("b.power"), F.lit(0.0)) - F.col("mean")) / sd).otherwise(0.0).alias("sde"))


def _run(obs: DataFrame, segments: DataFrame | None, objective: str, oversample: int, shares: tuple[float, float, int], least: float, min_points: int, whole: bool, work: float) -> DataFrame:
    def kernel(tau: np.ndarray, y: np.ndarray, dy: np.ndarray, periods: np.ndarray, p_lo: float) -> dict[str, np.ndarray]:
        return boxes(tau, y, dy, periods, durations(p_lo, shares, least), oversample, objective)

    return spread_trials(obs, grids.box_segments(obs) if segments is None else segments, kernel, FIELDS, min_points, whole, work)


def spectrum(obs: DataFrame, segments: DataFrame | None = None, objective: str = "snr", oversample: int = OVERSAMPLE, shares: tuple[float, float, int] = DURATIONS, least: float = LEAST_DURATION, min_points: int = 4, work: float = spread.WORK / 4) -> DataFrame:
    """The best box of every trial: object_id, segment, k, period and FIELDS. ``segments`` as ``grids.box_segments`` gives them (the default)."""
    return _run(obs, segments, objective, oversample, shares, least, min_points, True, work)


def search(obs: DataFrame, segments: DataFrame | None = None, objective: str = "snr", oversample: int = OVERSAMPLE, shares: tuple[float, float, int] = DURATIONS, least: float = LEAST_DURATION, min_points: int = 4, work: float = spread.WORK / 4) -> DataFrame:
    """The best box of each object: object_id, trials, segment, k, period, FIELDS and sde, how far its power stands above the mean of all trials in standard deviations. Of equal powers the shortest period wins."""
    return merge_pieces(_run(obs, segments, objective, oversample, shares, least, min_points, False, work), FIELDS)


def not_searched(obs: DataFrame, segments: DataFrame | None = None, min_points: int = 4) -> DataFrame:
    """object_id and reason of objects that ``search`` gives no row for."""
    segments = grids.box_segments(obs) if segments is None else segments
    n = obs.groupBy("object_id").agg(F.count("*").alias("n")).join(segments.groupBy("object_id").agg(F.sum("nf").alias("nf")), "object_id", "left")
    reason = F.when(F.col("n") < min_points, "too few points").when(F.coalesce("nf", F.lit(0)) < 1, "no trial period within the baseline")
    return n.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("object_id", "reason")


def log_segments(periods: DataFrame, factor: float = 2.0) -> DataFrame:
    """Any periods (object_id, period) with the segment they fall into: each ``factor`` long from the object's shortest one; and that segment's shortest period p_lo."""
    low = periods.groupBy("object_id").agg(F.min("period").alias("p0"))
    p = periods.join(low, "object_id").withColumn("segment", F.floor(F.log(F.col("period") / F.col("p0")) / math.log(factor) + 1e-9))
    return p.withColumn("p_lo", F.col("p0") * F.pow(F.lit(float(factor)), F.col("segment").cast("double"))).drop("p0")
