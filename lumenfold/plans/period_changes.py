"""A catalogue of period changes: one grouped pass over the objects, three tables out, resumable.

Blocks of objects go through the chain in one call: running-median detrend, joint search
for period and rate about its seed, phase track with polynomial ephemerides, orbit of
the O-C, period profile and its laws. The call emits rows of one tagged table; a chunk
of objects is one Spark job whose commit writes the summary, the O-C segments and the
profile intervals together. A stage that cannot run leaves its columns null; an object
that cannot be searched has a summary row with the reason.

A sink is a folder with the request (JSON) and the tagged rows, partitioned by attempt
and table. A resumed run skips objects whose newest summary is "ok" and whose newest
O-C and profile rows are as many as it promises; others are done again, and readers
take an object's newest attempt only. So a run that is killed between or inside chunks
ends with the tables that an undisturbed one has.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, ephemeris, kernels, light_time, spread, tracking
from ..operators import period_laws as laws_of

SUMMARY = (
    "n long, baseline double, seed_source string, search_period double, search_pdot double, search_power double, search_steady_power double, search_at_edge boolean, "
    "track_period double, track_pdot double, track_pdot_error double, track_f_tail double, track_chi2 double, pddot double, pddot_error double, rms_2 double, rms_3 double, "
    "profile_first double, profile_last double, profile_change double, law string, law_pinned boolean, law_margin double, "
    "orbit_period double, orbit_amplitude double, orbit_delta_bic double, orbit_f_tail double, orbit_pdot double, orbit_mass_function double, n_segments long, n_intervals long"
)
OC = "segment long, mid double, delay double, delay_error double, residual double"
PROFILE = "interval long, period double, period_error double, law_period double"
TAGGED = f"object_id string, kind string, status string, {SUMMARY}, {OC}, {PROFILE}"
COLUMNS = [c.split()[0] for c in TAGGED.split(", ")]
TABLES = {"summary": ["status", *(c.split()[0] for c in SUMMARY.split(", "))], "oc": ["n", *(c.split()[0] for c in OC.split(", "))], "profile": ["n", "mid", *(c.split()[0] for c in PROFILE.split(", "))]}
DEFAULTS = {"method": "gls", "model": "constant", "n_rates": 12, "detrend_width": None, "segments": None, "per_interval": 30, "profile": True, "laws": list(laws_of.AUTO), "orbit": True, "period": None}


def detrended(t: np.ndarray, y: np.ndarray, width: float) -> np.ndarray:
    """Values less the median of the points within half a width, plus the median of all."""
    lo, hi = np.searchsorted(t, t - width / 2, "left"), np.searchsorted(t, t + width / 2, "right")
    return y - np.array([np.median(y[a:b]) for a, b in zip(lo, hi, strict=True)]) + np.median(y)


def _ephemeris(mid: np.ndarray, delay: np.ndarray, error: np.ndarray, period: float) -> dict:
    """Polynomials of degree 1 to 3 through the delays: rates, their errors inflated by the scatter, and the test of the square against the line."""
    w = 1 / error if np.all(np.isfinite(error) & (error > 0)) else np.ones(len(mid))
    x, scale = mid - mid.mean(), max(np.ptp(mid) / 2, 1e-300)
    out: dict = {}
    for d in (1, 2, 3):
        if len(mid) <= d + 1:
            break
        a = (x / scale)[:, None] ** np.arange(d + 1)
        beta = np.linalg.lstsq(a * w[:, None], delay * w, rcond=None)[0]
        rest = delay - a @ beta
        chi, dof = float(np.sum((w * rest) ** 2)), len(mid) - d - 1
        out[d] = chi, dof, beta / scale ** np.arange(d + 1), np.sqrt(np.diag(np.linalg.inv((a * w[:, None]).T @ (a * w[:, None]))) * max(1.0, chi / dof)) / scale ** np.arange(d + 1), rest
    found: dict = {}
    if 1 in out:
        found["track_period"] = period * (1 + out[1][2][1])
    if 2 in out:
        chi, dof, b, e, rest = out[2]
        found |= {"track_pdot": 2 * period * b[2], "track_pdot_error": 2 * period * e[2], "track_f_tail": ephemeris.f_test(out[1][0] - chi, 1, chi, dof)[1], "track_chi2": chi / dof, "rms_2": float(np.sqrt(np.mean(rest**2))), "residual": rest}
    if 3 in out:
        found |= {"pddot": 6 * period * out[3][2][3], "pddot_error": 6 * period * out[3][3][3], "rms_3": float(np.sqrt(np.mean(out[3][4] ** 2)))}
    return found


def _measured(t: np.ndarray, y: np.ndarray, dy: np.ndarray | None, seed: float | None, s: dict) -> dict:
    """What one object's points give by themselves: ``head``, the summary so far, and where there are some, ``track`` (columns and residuals) and ``profile`` (columns)."""
    head = {"kind": "summary", "n": len(t), "baseline": float(t[-1] - t[0]) if len(t) else 0.0, "n_segments": 0, "n_intervals": 0}
    if len(t) < 8 or head["baseline"] <= 0:
        return {"head": head | {"status": "under 8 points" if len(t) < 8 else "no time baseline"}}
    if s["detrend_width"]:
        y = detrended(t, y, s["detrend_width"])
    given = seed is not None and math.isfinite(seed) and seed > 0
    r = drift.search(t, y, dy, 1 / seed if given else drift.best_seed(t, y, dy), s["method"], s["n_rates"], s["model"])
    head |= {"status": "ok", "seed_source": "given" if given else "search", "search_period": r["period"], "search_pdot": r["pdot"], "search_power": r["power"], "search_steady_power": r["steady_power"], "search_at_edge": r["at_edge"]}
    out, period = {"head": head, "period": float(r["period"])}, float(r["period"])
    track = tracking.phase_track(t, y, period, s["segments"])
    if track:
        k, n, mid, delay, error = (np.array(x) for x in zip(*track, strict=True))
        fit = _ephemeris(mid, delay, error, period)
        residual = fit.pop("residual", np.full(len(k), np.nan))
        head |= fit
        out["track"] = k, n, mid, delay, error, residual
    rows = tracking.period_profile(t, y, period, s["per_interval"]) if s["profile"] else []
    if rows:
        k, n, mid, p, error = out["profile"] = tuple(np.array(x) for x in zip(*rows, strict=True))
        head |= {"profile_first": p[0], "profile_last": p[-1], "profile_change": p[-1] / p[0] - 1}
    return out


def _fitted(measured: list[dict], s: dict) -> list[list[dict]]:
    """The tagged rows of objects, whose orbits and laws take their steps together."""
    tracked = [x for x in measured if "track" in x] if s["orbit"] else []
    orbits = light_time.search_tables([(*x["track"][2:5], x["period"]) for x in tracked])
    orbit_of = {id(x): o for x, o in zip(tracked, orbits, strict=True) if o["reason"] is None}
    profiled = [x for x in measured if "profile" in x] if s["laws"] else []
    laws = laws_of.compare_tables([x["profile"][2:] for x in profiled], tuple(s["laws"]))
    laws_by = {id(x): found for x, found in zip(profiled, laws, strict=True)}
    out = []
    for x in measured:
        head, oc, intervals = dict(x["head"]), [], []
        if "track" in x:
            oc = [{"kind": "oc", "segment": int(a), "n": int(b), "mid": c, "delay": d, "delay_error": e, "residual": z} for a, b, c, d, e, z in zip(*x["track"], strict=True)]
        if o := orbit_of.get(id(x)):
            head |= {"orbit_period": o["outer_period"], "orbit_amplitude": o["amplitude"], "orbit_delta_bic": o["delta_bic"], "orbit_f_tail": o["f_tail"], "orbit_pdot": o["pdot"], "orbit_mass_function": o["mass_function"]}
        if "profile" in x:
            at, mid = np.full(len(x["profile"][0]), np.nan), x["profile"][2]
            if best := laws_by.get(id(x)):
                head |= {"law": best[0]["law"], "law_pinned": best[0]["pinned"], "law_margin": best[1]["bic_scaled"] - best[0]["bic_scaled"] if len(best) > 1 else math.nan}
                at = laws_of.values(best[0], mid)
            intervals = [{"kind": "profile", "interval": int(a), "n": int(b), "mid": c, "period": d, "period_error": e, "law_period": z} for a, b, c, d, e, z in zip(*x["profile"], at, strict=True)]
        out.append([head | {"n_segments": len(oc), "n_intervals": len(intervals)}, *oc, *intervals])
    return out


def analyse(t: np.ndarray, y: np.ndarray, dy: np.ndarray | None, seed: float | None, settings: dict) -> list[dict]:
    """The tagged rows of one object: a summary, its O-C segments and its profile intervals."""
    s = DEFAULTS | settings
    return _fitted([_measured(t, y, dy, seed, s)], s)[0]


#: Numbers of one object that do not end the catalogue.
FAILURES = (ArithmeticError, np.linalg.LinAlgError, ValueError)


def _failed(n: int, e: Exception) -> list[dict]:
    return [{"kind": "summary", "status": f"failed: {e}"[:200], "n": n, "n_segments": 0, "n_intervals": 0}]


def analyse_many(objects: list[tuple[np.ndarray, np.ndarray, np.ndarray | None, float | None]], settings: dict) -> list[list[dict]]:
    """``analyse`` of several objects; one that fails has a summary with the reason."""
    s, out, begun = DEFAULTS | settings, {}, {}
    for i, x in enumerate(objects):
        try:
            begun[i] = _measured(*x, s)
        except FAILURES as e:
            out[i] = _failed(len(x[0]), e)
    try:
        out |= dict(zip(begun, _fitted(list(begun.values()), s), strict=True))
    except FAILURES:  # of some object: each by itself
        for i, x in begun.items():
            try:
                out[i] = _fitted([x], s)[0]
            except FAILURES as e:
                out[i] = _failed(len(objects[i][0]), e)
    return [out[i] for i in range(len(objects))]


_KINDS = {c.split()[0]: {"long": "Int64", "double": "float64", "boolean": "boolean", "string": object}[c.split()[1]] for c in TAGGED.split(", ")}


def tagged_rows(obs: DataFrame, seeds: DataFrame | None = None, **settings) -> DataFrame:
    """Tagged rows of all objects in one grouped pass. ``seeds`` (object_id, period) may name some objects; others take ``period`` or their own search."""
    if wrong := set(settings) - set(DEFAULTS):
        raise ValueError(f"no setting {', '.join(sorted(wrong))}")
    drift.sharpness(settings.get("method", "gls"), {})
    default = settings.get("period")
    joined = obs.withColumn("_seed", F.lit(default).cast("double"))
    if seeds is not None:
        joined = obs.join(seeds.select("object_id", F.col("period").cast("double").alias("_p")), "object_id", "left").withColumn("_seed", F.coalesce("_p", F.lit(default).cast("double")))

    def run(objects: list[pd.DataFrame]) -> pd.DataFrame:
        found = analyse_many([(*kernels._points(o), float(o["_seed"].iloc[0])) for o in objects], settings)
        return pd.DataFrame([r | {"object_id": o["object_id"].iloc[0]} for o, rows in zip(objects, found, strict=True) for r in rows], columns=COLUMNS).astype(_KINDS)

    out = spread.in_blocks(spread.deal_objects(joined), run, TAGGED)
    return out.select([F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in out.schema])


def table(rows: DataFrame, kind: str) -> DataFrame:
    """One of the tables ``summary``, ``oc`` and ``profile`` of tagged rows."""
    return rows.where(F.col("kind") == kind).select("object_id", *TABLES[kind])


def _stored(spark: SparkSession, sink: str) -> DataFrame | None:
    try:
        return spark.read.schema(f"{TAGGED}, attempt long").parquet(f"{sink}/rows")
    except AnalysisException:
        return None


def _newest(rows: DataFrame) -> DataFrame:
    newest = rows.groupBy("object_id").agg(F.max("attempt").alias("attempt"))
    return rows.join(newest, ["object_id", "attempt"])


def finished(rows: DataFrame) -> DataFrame:
    """Objects whose newest attempt is whole: one ok summary, and as many segments and intervals as it says."""
    count = lambda k: F.count(F.when(F.col("kind") == k, True))
    said = lambda c: F.max(F.when((F.col("kind") == "summary") & (F.col("status") == "ok"), F.col(c)))
    s = _newest(rows).groupBy("object_id").agg(count("summary").alias("s"), count("oc").alias("o"), count("profile").alias("p"), said("n_segments").alias("so"), said("n_intervals").alias("sp"))
    return s.where("s = 1 AND o = so AND p = sp").select("object_id")


def run(obs: DataFrame, sink: str, seeds: DataFrame | None = None, chunks: int = 1, only: list[int] | None = None, **settings) -> dict[str, DataFrame]:
    """The three tables of a catalogue, from ``sink`` after all chunks (objects by a hash of their name) are in it. ``only``: the chunks to do in this call."""
    spark = obs.sparkSession
    request = json.dumps({k: v for k, v in (DEFAULTS | settings).items()}, sort_keys=True)
    try:
        old = spark.read.json(f"{sink}/request").first()["request"]
    except AnalysisException:
        old = None
    if old is not None and old != request:
        raise ValueError(f"the sink was made with other settings: {old}")
    if old is None:
        spark.createDataFrame([(request,)], "request string").coalesce(1).write.mode("overwrite").json(f"{sink}/request")
    for chunk in range(chunks) if only is None else only:
        rows, todo, attempt = _stored(spark, sink), obs.where(F.pmod(F.xxhash64("object_id"), F.lit(chunks)) == chunk), 0
        if rows is not None:
            attempt = (rows.agg(F.max("attempt")).first()[0] or 0) + 1
            todo = todo.join(finished(rows), "object_id", "left_anti")
        tagged_rows(todo, seeds, **settings).withColumn("attempt", F.lit(attempt).cast("long")).write.mode("append").partitionBy("attempt", "kind").parquet(f"{sink}/rows")
    rows = _stored(spark, sink)
    newest = _newest(rows)
    return {k: table(newest, k) for k in TABLES}
