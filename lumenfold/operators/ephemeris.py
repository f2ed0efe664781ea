"""Polynomial ephemerides of event times: sums per object by Spark, then one small linear system each."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import special

DEGREES = (1, 2, 3)
FIT = "degree int, c0 double, c1 double, c2 double, c3 double, e0 double, e1 double, e2 double, e3 double, chi2 double, dof long, bic double, aic double, f_ratio double, p_value double"


def sums(oc: DataFrame) -> DataFrame:
    """Per object: n, scale and the sums of powers of the scaled cycle count x, of x^k times the residual, and its squares.

    ``oc`` has object_id, e (cycle) and oc; a weight column w is used where there is one. All are additive, so an
    object of any size is aggregated before anything meets in one task.
    """
    w = F.col("w") if "w" in oc.columns else F.lit(1.0)
    scale = oc.groupBy("object_id").agg(F.greatest(F.max(F.abs("e")), F.lit(1.0)).alias("scale"))
    x = oc.join(scale, "object_id").withColumn("x", F.col("e") / F.col("scale"))
    power = lambda k: F.pow("x", F.lit(float(k))) if k else F.lit(1.0)
    return x.groupBy("object_id").agg(
        F.count("*").alias("n"), F.first("scale").alias("scale"), F.sum(w * F.col("oc") * F.col("oc")).alias("yy"),
        F.array(*[F.sum(w * power(k)) for k in range(2 * DEGREES[-1] + 1)]).alias("s"), F.array(*[F.sum(w * power(k) * F.col("oc")) for k in range(DEGREES[-1] + 1)]).alias("y"),
    )


def f_test(gain: float, extra: int, chi2: float, dof: int) -> tuple[float, float]:
    """Ratio and chance of a gain in chi2 by ``extra`` parameters."""
    if dof <= 0 or chi2 <= 0 or gain <= 0:
        return (math.nan, math.nan) if dof <= 0 else (math.inf, 0.0) if gain > 0 else (0.0, 1.0)
    ratio = (gain / extra) / (chi2 / dof)
    return ratio, float(special.f_sf(ratio, extra, dof))


def _fit(n: int, scale: float, yy: float, s: np.ndarray, y: np.ndarray, with_errors: bool) -> list[tuple]:
    out, before = [], None
    for d in DEGREES:
        if n <= d + 1:
            break
        h = np.array([[s[i + j] for j in range(d + 1)] for i in range(d + 1)])
        if np.linalg.cond(h) > 1e13:
            break
        c = np.linalg.solve(h, y[: d + 1])
        chi2, dof = max(float(yy - c @ y[: d + 1]), 0.0), n - d - 1
        unit = 1.0 if with_errors else chi2 / dof
        error = np.sqrt(np.diag(np.linalg.inv(h)) * unit)
        base = chi2 if with_errors else n * math.log(max(chi2, 1e-300) / n)
        ratio, p = (math.nan, math.nan) if before is None else f_test(before - chi2, 1, chi2, dof)
        down = scale ** np.arange(d + 1)
        pad = [math.nan] * (3 - d)
        out.append((d, *(c / down), *pad, *(error / down), *pad, chi2, dof, base + (d + 1) * math.log(n), base + 2 * (d + 1), ratio, p))
        before = chi2
    return out


def fits(oc: DataFrame) -> DataFrame:
    """One row per object and degree 1 to 3: coefficients in cycles, errors, chi2, BIC, AIC, and the F test against one degree less."""
    with_errors = "w" in oc.columns
    names = [c.split()[0] for c in FIT.split(", ")]

    @pandas_udf(f"array<struct<{', '.join(f'{a}: {b}' for a, b in (c.split() for c in FIT.split(', ')))}>>")
    def solve(n: pd.Series, scale: pd.Series, yy: pd.Series, s: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(names, r, strict=True)) for r in _fit(*row, with_errors)] for row in zip(n, scale, yy, s, y, strict=True)], dtype=object)

    return sums(oc).select("object_id", "n", F.explode(solve("n", "scale", "yy", "s", "y")).alias("f")).select("object_id", "n", "f.*")


def best_fit(found: DataFrame, by: str = "bic") -> DataFrame:
    """The degree with the least BIC (or AIC), the lower one of two."""
    columns = [c for c in found.columns if c != "object_id"]
    return found.groupBy("object_id").agg(F.min_by(F.struct(*columns), F.struct(F.round(by, 9), "degree")).alias("b")).select("object_id", "b.*")


def predict(e: Column) -> Column:
    """O-C of a row of ``fits`` at a cycle."""
    return sum((F.coalesce(F.nanvl(F.col(f"c{k}"), F.lit(0.0)), F.lit(0.0)) * F.pow(e, F.lit(float(k))) for k in range(1, 4)), F.col("c0"))


def period_rate(period: Column) -> Column:
    """dP/dt (day a day) of a quadratic row of ``fits``."""
    return 2 * F.col("c2") / period


def scaled_error() -> Column:
    """The quadratic coefficient's error times the root of the reduced chi2, where that exceeds 1."""
    return F.col("e2") * F.sqrt(F.greatest(F.col("chi2") / F.col("dof"), F.lit(1.0)))


def implied_model() -> Column:
    """The drift law that a cubic row favours: a rate that follows the period bends the diagram with the sign of its own rate."""
    return F.when(F.isnan("c3") | (F.abs("c3") < 2 * F.col("e3")), "constant").when(F.col("c2") * F.col("c3") > 0, "exponential").otherwise("constant")


def threshold(sigma: Column, n_sigma: float = 3.0) -> Column:
    """The least rate that stands ``n_sigma`` errors above zero."""
    return F.lit(float(n_sigma)) * sigma


def amplitude_floor(times: DataFrame, outer_periods: list[float], degree: int = 2) -> DataFrame:
    """object_id, outer_period and sigma: the error of a cycle's semi-amplitude, averaged over its phase, fitted together with a polynomial of ``degree``.

    ``times`` has object_id, t and sigma (the timing error). Sums of products of the columns are additive and come from an
    aggregate; a small system per object and period follows. Infinite where the times cannot tell the cycle from the polynomial.
    """
    k = degree + 3
    s = times.groupBy("object_id").agg(F.avg("t").alias("mid"), F.greatest((F.max("t") - F.min("t")) / 2, F.lit(1e-300)).alias("half"))
    x = times.join(s, "object_id").withColumn("x", (F.col("t") - F.col("mid")) / F.col("half")).withColumn("w", 1 / (F.col("sigma") * F.col("sigma")))
    x = x.withColumn("outer_period", F.explode(F.array(*[F.lit(float(p)) for p in outer_periods])))
    turn = 2 * math.pi * (F.col("t") - F.col("mid")) / F.col("outer_period")
    cols = [F.pow("x", F.lit(float(i))) if i else F.lit(1.0) for i in range(degree + 1)] + [F.cos(turn), F.sin(turn)]
    sums_ = x.groupBy("object_id", "outer_period").agg(F.array(*[F.sum(F.col("w") * cols[i] * cols[j]) for i in range(k) for j in range(k)]).alias("h"))

    @pandas_udf("double")
    def solve(h: pd.Series) -> pd.Series:
        out = []
        for row in h:
            m = np.array(row, dtype=float).reshape(k, k)
            d = np.sqrt(np.maximum(np.diag(m), 1e-300))
            n = m / np.outer(d, d)
            bad = not np.isfinite(n).all() or np.linalg.cond(n) > 1e12
            v = None if bad else np.diag(np.linalg.inv(n)) / d**2
            out.append(math.inf if bad else math.sqrt(max(0.5 * (v[-1] + v[-2]), 0.0)))
        return pd.Series(out)

    return sums_.select("object_id", "outer_period", solve("h").alias("sigma"))
