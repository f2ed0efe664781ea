"""Periodogram statistics as grouped aggregations over (object x trial frequency).

Observations are dealt by object once, to tasks for their points times trials;
exploding the trial grid and grouping by (object, k) keeps that partitioning, so a
statistic costs a single shuffle of the observations, and a task's groups fit in
memory however large the table is. For grids of many thousand trials
use ``kernels``, which stream the grid through memory instead of exploding it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import spread

KEY = ["object_id"]
TWO_PI = 2 * math.pi


def object_stats(obs: DataFrame, *by: str) -> DataFrame:
    """Points, time span and value moments per object."""
    return obs.groupBy(*(by or KEY)).agg(
        F.count("*").alias("n"), F.min("t").alias("tmin"), F.max("t").alias("tmax"), (F.max("t") - F.min("t")).alias("baseline"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std")
    )


def centred(obs: DataFrame, weighted: bool = True, by: tuple[str, ...] = ("object_id",), over: tuple[str, ...] | None = None) -> DataFrame:
    """tau, baseline, n, normalised weight w, centred value yc and yy = sum(w yc^2) on every point.

    ``by`` is the group whose mean and weights are used; ``over`` (the object by default) sets the time origin.
    """
    g, o = Window.partitionBy(*by), Window.partitionBy(*(over or KEY))
    raw = 1.0 / (F.col("dy") * F.col("dy")) if weighted else F.lit(1.0)
    df = obs.withColumn("tmin", F.min("t").over(o)).withColumn("baseline", F.max("t").over(o) - F.col("tmin")).withColumn("n", F.count("*").over(g))
    df = df.withColumn("w0", raw).withColumn("wsum", F.sum("w0").over(g)).withColumn("w", F.col("w0") / F.col("wsum")).withColumn("tau", F.col("t") - F.col("tmin"))
    df = df.withColumn("yc", F.col("y") - F.sum(F.col("w") * F.col("y")).over(g))
    return df.withColumn("yy", F.sum(F.col("w") * F.col("yc") * F.col("yc")).over(g)).where("baseline > 0")


def on_grid(df: DataFrame, nf: int, oversample: float = 5.0) -> DataFrame:
    """One row per point and trial: k and f = 1/T + k / (oversample T)."""
    f = 1.0 / F.col("baseline") + F.col("k") * (1.0 / (F.lit(oversample) * F.col("baseline")))
    return df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(nf - 1)))).withColumn("f", f)


def trig_sums(df: DataFrame, *by: str) -> DataFrame:
    """The sums of one sinusoid per group: c, s, yc_, ys_, c2, s2."""
    th = F.lit(TWO_PI) * F.col("f") * F.col("tau")
    w, wy = F.col("w"), F.col("w") * F.col("yc")
    return df.withColumn("th", th).groupBy(*by).agg(
        F.first("f").alias("f"), F.first("yy").alias("yy"), F.first("n").alias("n"), F.first("baseline").alias("baseline"), F.first("wsum").alias("wsum"),
        F.sum(w * F.cos("th")).alias("c"), F.sum(w * F.sin("th")).alias("s"), F.sum(wy * F.cos("th")).alias("yc_"), F.sum(wy * F.sin("th")).alias("ys_"),
        F.sum(w * F.cos(2 * F.col("th"))).alias("c2"), F.sum(w * F.sin(2 * F.col("th"))).alias("s2"),
    )


def closed_form(fit_mean: bool = True) -> Column:
    """Power of the best sinusoid (Zechmeister & Kuerster 2009) from ``trig_sums``, clipped to 0..1."""
    c, s = (F.col("c"), F.col("s")) if fit_mean else (F.lit(0.0), F.lit(0.0))
    cc, ss, cs = (1 + F.col("c2")) / 2 - c * c, (1 - F.col("c2")) / 2 - s * s, F.col("s2") / 2 - c * s
    y, z = F.col("yc_"), F.col("ys_")
    d = F.col("yy") * (cc * ss - cs * cs)
    p = (ss * y * y + cc * z * z - 2 * cs * y * z) / d
    return F.when((F.col("yy") > 0) & (F.abs(d) > 1e-12 * F.col("yy")) & (p > 0), F.least(p, F.lit(1.0))).otherwise(F.lit(0.0))


def gls(obs: DataFrame, nf: int = 200, fit_mean: bool = True, weighted: bool = True) -> DataFrame:
    """Generalised Lomb-Scargle power: object_id, k, f, power, n, baseline."""
    sums = trig_sums(on_grid(centred(spread.deal_trials(obs, nf), weighted), nf), "object_id", "k")
    return sums.select("object_id", "k", "f", closed_form(fit_mean).alias("power"), "n", "baseline")


def aov(obs: DataFrame, nf: int = 200) -> DataFrame:
    """Analysis-of-variance F statistic of one harmonic (Schwarzenberg-Czerny 1996), unweighted."""
    p = gls(obs, nf, True, False)
    return p.where("n > 3").withColumn("power", (F.col("power") / 2) / (F.greatest(1 - F.col("power"), F.lit(1e-12)) / (F.col("n") - 3)))


def amplitude_spectrum(obs: DataFrame, nf: int = 200, least_squares: bool = True) -> DataFrame:
    """Amplitude and phase of the least-squares sinusoid, or of the discrete Fourier transform, per trial."""
    s = trig_sums(on_grid(centred(spread.deal_trials(obs, nf), False), nf), "object_id", "k")
    if least_squares:
        cc, ss, cs = (1 + F.col("c2")) / 2, (1 - F.col("c2")) / 2, F.col("s2") / 2
        d = cc * ss - cs * cs
        a, b = (F.col("yc_") * ss - F.col("ys_") * cs) / d, (F.col("ys_") * cc - F.col("yc_") * cs) / d
        a, b = (F.when(F.abs(d) > 1e-9, x).otherwise(F.lit(0.0)) for x in (a, b))
    else:
        a, b = 2 * F.col("yc_"), 2 * F.col("ys_")
    return s.select("object_id", "k", "f", F.hypot(a, b).alias("amplitude"), F.atan2(a, b).alias("phase"))


def spectral_window(obs: DataFrame, nf: int = 200) -> DataFrame:
    """Modulus of the sampling's transform per trial."""
    s = trig_sums(on_grid(centred(spread.deal_trials(obs, nf), False), nf), "object_id", "k")
    return s.select("object_id", "k", "f", F.hypot("c", "s").alias("power"))


def folded(df: DataFrame) -> DataFrame:
    """``on_grid`` rows with period p = 1/f and phase."""
    q = F.col("tau") / F.col("p")
    return df.withColumn("p", 1.0 / F.col("f")).withColumn("phi", q - F.floor(q))


def pdm(obs: DataFrame, nf: int = 200, n_bins: int = 10, n_covers: int = 3, by: tuple[str, ...] = ("object_id",)) -> DataFrame:
    """Phase dispersion (Stellingwerf 1978): one fine histogram is regrouped into all covers."""
    g = n_bins * n_covers
    fine = folded(on_grid(centred(spread.deal_trials(obs, nf), False, by), nf)).withColumn("b", F.least(F.greatest(F.floor(F.col("phi") * g), F.lit(0)), F.lit(g - 1)))
    hist = fine.groupBy(*by, "k", "b").agg(F.first("f").alias("f"), F.first("yy").alias("yy"), F.first("n").alias("n"), F.count("*").alias("m"), F.sum("yc").alias("sy"), F.sum(F.col("yc") * F.col("yc")).alias("syy"))
    covers = hist.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_covers - 1)))).withColumn("j", F.floor(((F.col("b") + F.col("c")) % g) / n_covers))
    coarse = covers.groupBy(*by, "k", "c", "j").agg(F.first("f").alias("f"), F.first("yy").alias("yy"), F.first("n").alias("n"), F.sum("m").alias("m"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"))
    out = coarse.groupBy(*by, "k").agg(F.first("f").alias("f"), F.first("yy").alias("yy"), F.first("n").alias("n"), F.sum(F.col("syy") - F.col("sy") * F.col("sy") / F.col("m")).alias("ssd"), F.count("*").alias("filled"))
    sigma2 = F.col("yy") * F.col("n") / (F.col("n") - 1)
    dof = F.col("n") * n_covers - F.col("filled")
    theta = F.when(sigma2 <= 0, F.lit(1.0)).when(dof <= 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("ssd"), dof) / sigma2)
    return out.where("n > 1").select(*by, "k", "f", theta.alias("power"), "n")


def conditional_entropy(obs: DataFrame, nf: int = 200, n_phase: int = 10, n_mag: int = 10, by: tuple[str, ...] = ("object_id",)) -> DataFrame:
    """Entropy of the value given the phase (Graham et al. 2013)."""
    g = Window.partitionBy(*by)
    df = centred(spread.deal_trials(obs, nf), False, by).withColumn("lo", F.min("y").over(g)).withColumn("hi", F.max("y").over(g))
    level = F.when(F.col("hi") > F.col("lo"), (F.col("y") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).otherwise(F.lit(0.0))
    clip = lambda x, n: F.least(F.greatest(F.floor(x * n), F.lit(0)), F.lit(n - 1))
    df = folded(on_grid(df.withColumn("i", clip(level, n_mag)), nf)).withColumn("j", clip(F.col("phi"), n_phase))
    cells = df.groupBy(*by, "k", "j", "i").agg(F.first("f").alias("f"), F.first("n").alias("n"), F.count("*").alias("m"))
    cells = cells.withColumn("mj", F.sum("m").over(Window.partitionBy(*by, "k", "j")))
    return cells.groupBy(*by, "k").agg(F.first("f").alias("f"), (F.sum(F.col("m") * F.log(F.col("mj") / F.col("m"))) / F.first("n")).alias("power"), F.first("n").alias("n"))


def string_length(obs: DataFrame, nf: int = 200, by: tuple[str, ...] = ("object_id",)) -> DataFrame:
    """Length of the folded curve with its wrap segment (Dworetsky 1983); ties in phase keep row order."""
    g = Window.partitionBy(*by)
    df = centred(spread.deal_trials(obs, nf), False, by).withColumn("lo", F.min("y").over(g)).withColumn("hi", F.max("y").over(g))
    m = F.when(F.col("hi") > F.col("lo"), (F.col("y") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 0.5 - 0.25).otherwise(F.lit(0.0))
    df = folded(on_grid(df.withColumn("m", m), nf))
    run = Window.partitionBy(*by, "k").orderBy("phi", "rid")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("dphi", F.col("phi") - F.coalesce(F.lag("phi").over(run), F.last("phi").over(whole) - 1)).withColumn("dm", F.col("m") - F.coalesce(F.lag("m").over(run), F.last("m").over(whole)))
    return df.groupBy(*by, "k").agg(F.first("f").alias("f"), F.sum(F.sqrt(F.col("dphi") * F.col("dphi") + F.col("dm") * F.col("dm"))).alias("power"), F.first("n").alias("n"))


def pooled(band_spectrum: DataFrame, weight: Column) -> DataFrame:
    """Weighted mean over bands of a per-band statistic on the object's shared grid."""
    df = band_spectrum.withColumn("bw", weight).where("bw > 0")
    return df.groupBy("object_id", "k").agg(F.first("f").alias("f"), (F.sum(F.col("bw") * F.col("power")) / F.sum("bw")).alias("power"), F.count("*").alias("n_bands"))


def gls_offsets(obs: DataFrame, nf: int = 200) -> DataFrame:
    """One sinusoid shared by all bands with a constant per band."""
    per_band = ("object_id", "band")
    df = centred(spread.deal_trials(obs, nf), True, per_band)
    share = F.col("wsum") / F.sum(F.when(F.col("_one") == 1, F.col("wsum"))).over(Window.partitionBy("object_id"))
    one = F.row_number().over(Window.partitionBy(*per_band).orderBy("rid"))
    df = df.withColumn("_one", one).withColumn("share", share)
    s = trig_sums(on_grid(df, nf).withColumn("yy", F.col("yy") * F.col("share")).withColumn("w", F.col("w") * F.col("share")).withColumn("wsum", F.col("share")), "object_id", "band", "k")
    a = lambda e, name: F.sum(e).alias(name)
    c, sn = F.col("c"), F.col("s")
    t = s.groupBy("object_id", "k").agg(
        F.first("f").alias("f"), a(F.col("yy"), "yy"), a((F.col("wsum") + F.col("c2")) / 2 - c * c / F.col("wsum"), "cc"), a((F.col("wsum") - F.col("c2")) / 2 - sn * sn / F.col("wsum"), "ss"),
        a(F.col("s2") / 2 - c * sn / F.col("wsum"), "cs"), a(F.col("yc_"), "y1"), a(F.col("ys_"), "y2"),
    )
    d = F.col("yy") * (F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs"))
    p = (F.col("ss") * F.col("y1") * F.col("y1") + F.col("cc") * F.col("y2") * F.col("y2") - 2 * F.col("cs") * F.col("y1") * F.col("y2")) / d
    return t.select("object_id", "k", "f", F.when((F.col("yy") > 0) & (F.abs(d) > 1e-12 * F.col("yy")) & (p > 0), F.least(p, F.lit(1.0))).otherwise(F.lit(0.0)).alias("power"))


def gls_per_band(obs: DataFrame, nf: int = 200) -> DataFrame:
    """Independent sinusoids; band powers weighted by each band's chi-squared about its mean."""
    s = trig_sums(on_grid(centred(spread.deal_trials(obs, nf), True, ("object_id", "band")), nf), "object_id", "band", "k")
    return pooled(s.select("object_id", "band", "k", "f", closed_form().alias("power"), "yy", "wsum"), F.col("yy") * F.col("wsum"))
