"""Slow period changes: ephemerides, drift searches, pair statistics of O-C residuals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import physics
from . import kernels, readouts, spectra, spread


def linear_ephemeris(events: DataFrame, period: float) -> DataFrame:
    """Straight line through event times (object_id, t) against the nearest cycle numbers of a trial period."""
    first = events.groupBy("object_id").agg(F.min("t").alias("t0"))
    df = events.join(first, "object_id").withColumn("e", F.floor((F.col("t") - F.col("t0")) / period + 0.5).cast("double"))
    fit = df.groupBy("object_id").agg(F.count("*").alias("n"), F.regr_slope("t", "e").alias("period"), F.regr_intercept("t", "e").alias("epoch"), F.regr_r2("t", "e").alias("r2"))
    return fit.where("n > 2 and period is not null")


def residuals(events: DataFrame, period: float) -> DataFrame:
    """O-C of each event against the object's fitted linear ephemeris."""
    first = events.groupBy("object_id").agg(F.min("t").alias("t0"))
    fit = linear_ephemeris(events, period)
    df = events.join(first, "object_id").withColumn("e", F.floor((F.col("t") - F.col("t0")) / period + 0.5).cast("double"))
    return df.join(fit.select("object_id", "period", "epoch"), "object_id").withColumn("oc", F.col("t") - F.col("epoch") - F.col("e") * F.col("period"))


def quadratic_drift(oc: DataFrame) -> DataFrame:
    """Least-squares parabola through O-C against cycle number; pdot = 2 c / P."""
    m = oc.groupBy("object_id").agg(F.count("*").alias("n"), F.avg("e").alias("em"), F.stddev_pop("e").alias("sd"), F.first("period").alias("period"))
    df = oc.join(m.select("object_id", "em", "sd"), "object_id").where("sd > 0").withColumn("x", (F.col("e") - F.col("em")) / F.col("sd"))
    s = df.groupBy("object_id").agg(*[F.avg(F.pow("x", F.lit(p))).alias(f"x{p}") for p in (2, 3, 4)], F.avg("oc").alias("y0"), F.avg(F.col("x") * F.col("oc")).alias("y1"), F.avg(F.col("x") * F.col("x") * F.col("oc")).alias("y2"), F.first("period").alias("period"), F.first("sd").alias("sd"), F.count("*").alias("n"))
    # x has mean 0 and variance 1: normal equations by hand
    b2, b3 = F.col("y2") - F.col("y0"), F.col("x3")
    c = (b2 - b3 * F.col("y1")) / (F.col("x4") - 1 - b3 * b3)
    return s.where("n > 3 and x4 - 1 - x3 * x3 > 1e-9").select("object_id", "n", (2 * c / (F.col("sd") * F.col("sd")) / F.col("period")).alias("pdot"))


def drift_search(obs: DataFrame, rates: list[float], nf: int = 40) -> DataFrame:
    """Lomb-Scargle power over (rate, frequency): times are warped so that a drifting period is constant."""
    c = spectra.centred(obs, False)
    df = c.withColumn("a_idx", F.explode(F.sequence(F.lit(0), F.lit(len(rates) - 1)))).withColumn("a", F.get(F.array(*map(F.lit, rates)), F.col("a_idx")))
    df = df.withColumn("tau", physics.warp(F.col("tau"), F.col("a")))
    s = spectra.trig_sums(spectra.on_grid(df, nf), "object_id", "a_idx", "k")
    return s.select("object_id", "a_idx", "k", "f", spectra.closed_form().alias("power"))


def eddington_plakidis(oc: DataFrame, max_lag: int) -> DataFrame:
    """Mean absolute difference of O-C by cycle lag up to ``max_lag`` (Eddington & Plakidis 1929)."""
    a = oc.select("object_id", F.col("e").alias("e1"), F.col("oc").alias("oc1"))
    b = oc.select("object_id", F.col("e").alias("e2"), F.col("oc").alias("oc2"))
    pairs = a.join(b, (a["object_id"] == b["object_id"]) & (F.col("e2") > F.col("e1")) & (F.col("e2") <= F.col("e1") + max_lag)).select(a["object_id"], (F.col("e2") - F.col("e1")).alias("lag"), F.abs(F.col("oc2") - F.col("oc1")).alias("u"))
    return pairs.groupBy("object_id", "lag").agg(F.avg("u").alias("mean_u"), F.count("*").alias("pairs"))


def detectable_rate(timings: DataFrame, period: float, error: float) -> DataFrame:
    """object_id, n, baseline, sigma_rate and sigma_period: formal errors of a quadratic ephemeris through an object's times.

    Each time has the 1-sigma ``error`` (days). The inverse of the normal matrix is written out from power sums of the centred times.
    """
    g = Window.partitionBy("object_id")
    x = timings.withColumn("x", F.col("t") - F.avg("t").over(g)).withColumn("unit", F.max(F.abs("x")).over(g)).where("unit > 0").withColumn("x", F.col("x") / F.col("unit"))
    s = x.groupBy("object_id").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("baseline"), F.first("unit").alias("unit"), *[F.sum(F.pow("x", F.lit(float(k)))).alias(f"s{k}") for k in (1, 2, 3, 4)])
    det = F.col("n") * (F.col("s2") * F.col("s4") - F.col("s3") * F.col("s3")) - F.col("s1") * (F.col("s1") * F.col("s4") - F.col("s2") * F.col("s3")) + F.col("s2") * (F.col("s1") * F.col("s3") - F.col("s2") * F.col("s2"))
    s = s.withColumn("det", det).where(F.col("det") > 1e-9 * F.col("n"))
    v2 = (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")) / F.col("det")
    v1 = (F.col("n") * F.col("s4") - F.col("s2") * F.col("s2")) / F.col("det")
    rate = 2 * period * error * F.sqrt(v2) / (F.col("unit") * F.col("unit"))
    return s.select("object_id", "n", "baseline", rate.alias("sigma_rate"), (period * error * F.sqrt(v1) / F.col("unit")).alias("sigma_period"))


RATES = "object_id string, f double, rate double, pdot double, power double, steady_power double, correlation double"


def _vertex(lo: float, mid: float, hi: float) -> float:
    bend = lo - 2 * mid + hi
    return 0.5 * (lo - hi) / bend if bend < 0 else 0.0


def rate_search(obs: DataFrame, seeds: DataFrame, n_rates: int = 12, model: str = "constant") -> DataFrame:
    """Best frequency and relative drift rate of each object about its seed (object_id, f), refined by parabolas.

    Times are bent so that a drifting period is constant, and each rate is one Lomb-Scargle spectrum on the window
    of frequencies about the seed. ``correlation`` of both parameters comes from the curvature of the peak.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, y, dy = kernels._points(pdf)
        none = pd.DataFrame({"object_id": pd.Series([], dtype=object), **{c.split()[0]: pd.Series([], dtype=float) for c in RATES.split(", ")[1:]}})
        span = t[-1] - t[0] if len(t) else 0.0
        if len(t) < 8 or span <= 0:
            return none
        seed = float(pdf["_f"].iloc[0])
        w = kernels._weights(dy, len(t))
        tau = t - np.sum(w * t)
        f0, df, nf = readouts.frequency_window(seed, span)
        grid = f0 + df * np.arange(nf)
        rates = np.array([a for a in readouts.drift_rates(n_rates, seed, span) if 1 + a * tau.min() > 0.05 and 1 + a * tau.max() > 0.05])
        bend = (lambda a: np.log1p(a * tau) / a) if model == "constant" else (lambda a: -np.expm1(-a * tau) / a)
        power = np.stack([kernels.gls(tau if a == 0 else bend(a), y, dy, grid) for a in rates])
        j, i = np.unravel_index(int(np.argmax(np.round(power, 9))), power.shape)
        f, a, correlation = grid[i], rates[j], math.nan
        if 0 < i < nf - 1 and 0 < j < len(rates) - 1:
            p = power[j - 1 : j + 2, i - 1 : i + 2]
            f += _vertex(*p[1]) * df
            a += _vertex(*p[:, 1]) * (rates[1] - rates[0])
            cff, caa, cfa = p[1, 0] - 2 * p[1, 1] + p[1, 2], p[0, 1] - 2 * p[1, 1] + p[2, 1], (p[0, 0] + p[2, 2] - p[0, 2] - p[2, 0]) / 4
            correlation = float(cfa / math.sqrt(cff * caa)) if cff < 0 and caa < 0 else math.nan
        steady = float(power[int(np.flatnonzero(rates == 0)[0])].max())
        return pd.DataFrame([(pdf["object_id"].iloc[0], f, a, a / f, float(power[j, i]), steady, correlation)], columns=[c.split()[0] for c in RATES.split(", ")])

    return spread.deal_objects(obs.join(seeds.selectExpr("object_id", "f AS _f"), "object_id"), obs).groupBy("object_id").applyInPandas(run, RATES)
