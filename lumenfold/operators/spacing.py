"""Period-spacing patterns in lists of modes: the comb, the chain of modes on it, and the tilt.

A comb's response at a spacing is the squared length of the mean phasor of the
periods folded on it; missing modes cost nothing. Modes of a series are the longest
path through the matrix of admissible steps: a step spans a whole number of spacings,
``max_gap`` at most, within ``tolerance`` of the spacing that the line ``a + b P``
gives at its middle. Line and path are found in turn until the path stays.

A series on a comb is on all combs of whole fractions of its spacing; the widest
multiple of the best spacing that keeps ``KEEPS`` of the response of that comb's own
modes is taken.

Defined results: an object whose modes hold no series of ``min_length`` gives no row;
null, non-finite and non-positive periods take no part; equal periods are no step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spread

#: Trials of the comb at most, share of the response that a wider comb must keep, multiples tried, and how far (in spacings) a mode may lie from its tooth.
MOST_TRIALS = 1 << 21
KEEPS = 0.8
MULTIPLES = 6
NEAR = 0.15
PASSES = 4

NUMBERS = ("comb_spacing", "comb_power", "mean_spacing", "intercept", "slope", "rms", "buoyancy_radius")
SERIES = "object_id string, n_modes long, n_members long, " + ", ".join(f"{c} double" for c in NUMBERS)
MEMBERS = "object_id string, member long, mode long, period double, step long, spacing double, predicted double"


def _response(inverse: np.ndarray, p: np.ndarray, w: np.ndarray) -> np.ndarray:
    out, step = np.empty(len(inverse)), max(1, (1 << 20) // max(len(p), 1))
    for a in range(0, len(inverse), step):
        out[a : a + step] = np.abs(np.exp(2j * np.pi * np.outer(inverse[a : a + step], p)) @ w) ** 2
    return out / w.sum() ** 2


def default_range(p: np.ndarray) -> tuple[float, float]:
    """Least and largest trial spacing of sorted periods, from their bulk: a far outlier moves neither."""
    gaps = np.diff(p)
    gaps = gaps[gaps > 0]
    span = float(p[-1] - p[0])
    middle = 2 * float(np.subtract(*np.percentile(p, [75, 25])))
    core = min(span, middle) if middle > 0 else span
    low = max(0.5 * float(gaps.min(initial=span)), core / (10 * len(p)))
    return low, max(min(span, max(core, 8 * float(np.median(gaps)) if len(gaps) else span)), 2 * low)


def comb(p: np.ndarray, weights: np.ndarray | None = None, low: float | None = None, high: float | None = None, oversample: int = 20) -> tuple[np.ndarray, np.ndarray, int]:
    """(trial spacings, responses, index of the spacing that is taken) of sorted periods."""
    auto = default_range(p)
    lo, hi = auto[0] if low is None else low, auto[1] if high is None else high
    if not 0 < lo < hi:
        raise ValueError("spacings need 0 < lowest < highest")
    w = np.ones(len(p)) if weights is None or not np.any(weights > 0) else np.abs(weights)
    n = min(math.ceil((1 / lo - 1 / hi) * max(oversample, 1) * (p[-1] - p[0])) + 1, MOST_TRIALS)
    u = np.linspace(1 / hi, 1 / lo, max(n, 2))
    power = _response(u, p, w)
    best = chosen = int(np.argmax(power))
    # teeth of the best comb: where its modes are by their mean phase
    phase = p * u[best]
    mine = p[np.abs((phase - np.angle(np.sum(np.exp(2j * np.pi * phase))) / (2 * np.pi) + 0.5) % 1 - 0.5) < NEAR]
    if len(mine) >= 3:
        ones = np.ones(len(mine))
        most = _response(u[best : best + 1], mine, ones)[0]
        for m in range(2, MULTIPLES + 1):
            around = np.flatnonzero(np.abs(u - u[best] / m) <= (oversample + 0.5) * (u[1] - u[0]))
            if u[best] / m < u[0] or not len(around):
                continue
            r = _response(u[around], mine, ones)
            if r.max() >= KEEPS * most:
                chosen = int(around[np.argmax(r)])
    return 1 / u, power, chosen


def longest_path(p: np.ndarray, intercept: float, slope: float, tolerance: float, max_gap: int) -> np.ndarray:
    """Indices of the longest chain of ascending periods whose steps are whole numbers of ``intercept + slope P``."""
    d, at = p[None, :] - p[:, None], intercept + slope * (p[None, :] + p[:, None]) / 2
    with np.errstate(all="ignore"):
        k = np.rint(d / at)
        ok = (d > 0) & (at > 0) & (k >= 1) & (k <= max_gap) & (np.abs(d - k * at) <= tolerance * at)
    length, before = np.ones(len(p), dtype=np.int64), np.full(len(p), -1)
    for j in range(1, len(p)):
        reach = np.where(ok[:j, j], length[:j] + 1, 1)
        i = int(np.argmax(reach))
        if reach[i] > 1:
            length[j], before[j] = reach[i], i
    chain, i = [], int(np.argmax(length)) if len(p) else -1
    while i >= 0:
        chain.append(i)
        i = before[i]
    return np.array(chain[::-1], dtype=np.int64)


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    if len(x) < 3:
        return float(y.mean()), 0.0
    b = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    return float(b[0]), float(b[1])


def search(p: np.ndarray, amplitude: np.ndarray | None = None, spacing: float | None = None, low: float | None = None, high: float | None = None, tolerance: float = 0.25, max_gap: int = 3, min_length: int = 4, oversample: int = 20, ell: int = 1) -> dict | None:
    """The series of a list of periods, or None: indices of its members (into the input, by ascending period), whole steps, and the columns of SERIES."""
    good = np.isfinite(p) & (p > 0) & (True if amplitude is None else np.isfinite(amplitude))
    index = np.flatnonzero(good)[np.argsort(p[good], kind="stable")]
    p = p[index]
    if len(p) < min_length or p[-1] <= p[0]:
        return None
    guess, power = spacing, math.nan
    if guess is None:
        trial, response, i = comb(p, None if amplitude is None else amplitude[index], low, high, oversample)
        guess, power = float(trial[i]), float(response[i])
    a, b, chain = guess, 0.0, np.zeros(0, dtype=np.int64)
    for _ in range(PASSES):
        found = longest_path(p, a, b, tolerance, max_gap)
        if len(found) < 2:
            break
        chain, d = found, np.diff(p[found])
        middle = (p[chain][1:] + p[chain][:-1]) / 2
        steps = _whole(d, a + b * middle)
        if steps.min() >= 2:  # every step skips modes: the spacing was a fraction of the true one
            a, b = a * steps.min(), b * steps.min()
            continue
        a, b = _line(middle, d / steps)
    if len(chain) < min_length:
        return None
    d, middle = np.diff(p[chain]), (p[chain][1:] + p[chain][:-1]) / 2
    steps = _whole(d, a + b * middle)
    each = d / steps
    a, b = _line(middle, each)
    mean = float(each.mean())
    return {
        "members": index[chain], "periods": p[chain], "steps": steps.astype(np.int64), "spacings": d, "predicted": a + b * middle, "n_modes": len(p), "n_members": len(chain), "comb_spacing": guess, "comb_power": power, "mean_spacing": mean,
        "intercept": a, "slope": b, "rms": float(np.sqrt(np.mean((each - a - b * middle) ** 2))), "buoyancy_radius": mean * math.sqrt(ell * (ell + 1)) * 86400,
    }


def _whole(d: np.ndarray, predicted: np.ndarray) -> np.ndarray:
    """Spacings that each step spans, one at least; one where the line gives none."""
    with np.errstate(all="ignore"):
        return np.maximum(np.rint(np.where(predicted > 0, d / predicted, 1.0)), 1.0)


def _grouped(modes: DataFrame, schema: str, rows, settings: dict) -> DataFrame:
    used = modes.select("object_id", F.col("period").cast("double").alias("period"), (F.col("amplitude") if "amplitude" in modes.columns else F.lit(1.0)).cast("double").alias("amplitude"))
    columns = {c.split()[0]: {"long": "int64", "double": "float64", "string": object}[c.split()[1]] for c in schema.split(", ")}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["period", "amplitude"])
        r = search(pdf["period"].to_numpy(float), pdf["amplitude"].fillna(0.0).to_numpy(float), **settings)
        return pd.DataFrame(rows(pdf["object_id"].iloc[0], r) if r else [], columns=list(columns)).astype(columns)

    return spread.deal_objects(used).groupBy("object_id").applyInPandas(run, schema)


def series(modes: DataFrame, **settings) -> DataFrame:
    """The series of each object's modes (object_id, period[, amplitude]), one row each. Settings as in ``search``."""
    out = _grouped(modes, SERIES, lambda key, r: [[key, r["n_modes"], r["n_members"], *(r[c] for c in NUMBERS)]], settings)
    return out.withColumn("comb_power", F.when(~F.isnan("comb_power"), F.col("comb_power")))


def members(modes: DataFrame, **settings) -> DataFrame:
    """The modes of each series by ascending period: its number, the step from the one before in spacings (null for the first), and that spacing as observed and by the line."""

    def rows(key: str, r: dict) -> list[list]:
        pad = lambda x: [math.nan, *x]
        return [[key, i + 1, int(m) + 1, p, k, s / max(k, 1), q] for i, (m, p, k, s, q) in enumerate(zip(r["members"], r["periods"], [0, *r["steps"]], pad(r["spacings"]), pad(r["predicted"]), strict=True))]

    out = _grouped(modes, MEMBERS, rows, settings)
    first = F.col("member") == 1
    return out.withColumns({c: F.when(~first, F.col(c)) for c in ("step", "spacing", "predicted")})
