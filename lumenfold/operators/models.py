"""Relational companions of the sinusoid models: evaluation, uncertainties, combs, weights, profiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .windows import by_time

#: Share of the largest residual within which one is nothing.
ZERO = 1e-9


def evaluate(obs: DataFrame, components: DataFrame, epoch: float = 0.0) -> DataFrame:
    """Each point with ``model`` = sum of A sin(2 pi f (t - epoch) + phase) over its object's components."""
    c = components.select("object_id", "frequency", "amplitude", "phase")
    part = F.col("amplitude") * F.sin(F.lit(2 * math.pi) * F.col("frequency") * (F.col("t") - F.lit(epoch)) + F.col("phase"))
    m = obs.select("object_id", "rid", "t").join(c, "object_id").groupBy("object_id", "rid").agg(F.sum(part).alias("model"))
    return obs.join(m, ["object_id", "rid"], "left").withColumn("model", F.coalesce("model", F.lit(0.0)))


def correlation_factor(residuals: DataFrame) -> DataFrame:
    """max(mean length of runs of equal sign / 2, 1) of a column ``residual`` in time order. A residual of nothing counts as positive, also where sums in another order leave it a rounding below: within ZERO of the object's largest."""
    sign = F.when(F.col("residual") >= -ZERO * F.max(F.abs("residual")).over(Window.partitionBy("object_id")), 1).otherwise(-1)
    df = residuals.withColumn("_s", sign).withColumn("_n", F.when(F.col("_s") == F.lag("_s").over(by_time()), 0).otherwise(1))
    return df.groupBy("object_id").agg(F.greatest(F.count("*") / F.sum("_n") / 2, F.lit(1.0)).alias("factor"), F.sum("_n").alias("n_runs"))


def analytic_uncertainties(components: DataFrame, stats: DataFrame) -> DataFrame:
    """Errors of amplitude, phase and frequency from n, baseline and residual sigma (Montgomery & O'Donoghue 1999)."""
    df = components.join(stats.select("object_id", "n", "baseline", "sigma"), "object_id")
    sa = F.sqrt(2.0 / F.col("n")) * F.col("sigma")
    return df.withColumn("amplitude_error", sa).withColumn("phase_error", sa / F.col("amplitude")).withColumn("frequency_error", F.sqrt(6.0 / F.col("n")) * F.col("sigma") / (F.lit(math.pi) * F.col("baseline") * F.col("amplitude")))


def comb_response(values: DataFrame, spacings: list[float]) -> DataFrame:
    """|sum a exp(2 pi i x / s)|^2 / (sum a)^2 per object and trial spacing, from columns x and a."""
    df = values.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(spacings) - 1)))).withColumn("spacing", F.get(F.array(*map(F.lit, spacings)), F.col("k")))
    th = F.lit(2 * math.pi) * F.col("x") / F.col("spacing")
    s = df.groupBy("object_id", "k").agg(F.first("spacing").alias("spacing"), F.sum(F.col("a") * F.cos(th)).alias("c"), F.sum(F.col("a") * F.sin(th)).alias("s"), F.sum("a").alias("a"))
    return s.select("object_id", "k", "spacing", ((F.col("c") * F.col("c") + F.col("s") * F.col("s")) / (F.col("a") * F.col("a"))).alias("power"))


def subset_weights(residuals: DataFrame, subset: str = "band") -> DataFrame:
    """1 / rms^2 of each subset's residuals, with mean 1 over the object's subsets."""
    s = residuals.groupBy("object_id", subset).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rms")).where("rms > 0")
    raw = 1.0 / (F.col("rms") * F.col("rms"))
    return s.withColumn("weight", raw / F.avg(raw).over(Window.partitionBy("object_id")))


def balanced_intervals(obs: DataFrame, intervals: int) -> DataFrame:
    """Interval numbers from 0 that deal an object's points evenly in time order."""
    w = Window.partitionBy("object_id")
    return obs.withColumn("interval", F.floor((F.row_number().over(by_time()) - 1) * intervals / F.count("*").over(w)))


def fold(obs: DataFrame, period: float, epoch: float = 0.0, cycles: int = 2) -> DataFrame:
    """Each point at its phase and, for more cycles, again at phase + 1, ..."""
    q = (F.col("t") - F.lit(epoch)) / F.lit(period)
    df = obs.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(cycles - 1))))
    return df.withColumn("phase", q - F.floor(q) + F.col("_c")).drop("_c")


def rate_profile(search: DataFrame, by: str) -> DataFrame:
    """Best power per rate (``a_idx``) or per frequency (``k``) of a drift search."""
    return search.groupBy("object_id", by).agg(F.max("power").alias("power"))


def standardised(obs: DataFrame) -> DataFrame:
    """Values less their band's mean in units of its standard deviation; constant bands are left out."""
    w = Window.partitionBy("object_id", "band")
    sd = F.stddev_pop("y").over(w)
    df = obs.withColumn("_sd", sd).withColumn("y", (F.col("y") - F.avg("y").over(w)) / F.nullif(sd, F.lit(0.0)))
    return df.where("_sd > 0").drop("_sd")


def robust_scatter(obs: DataFrame) -> DataFrame:
    """1.4826 times the median absolute deviation per object and band."""
    w = Window.partitionBy("object_id", "band")
    df = obs.withColumn("_d", F.abs(F.col("y") - F.expr("percentile(y, 0.5D)").over(w)))
    return df.groupBy("object_id", "band").agg((1.4826 * F.expr("percentile(_d, 0.5D)")).alias("scatter"))


def period_law(track: DataFrame) -> DataFrame:
    """Constant and linear period laws of (object_id, t, period), weighted equally, and which has the lower BIC."""
    s = track.groupBy("object_id").agg(
        F.count("*").alias("n"), F.avg("period").alias("mean"), F.regr_slope("period", "t").alias("slope"), F.regr_intercept("period", "t").alias("at_zero"),
        F.var_pop("period").alias("v"), F.regr_r2("period", "t").alias("r2"),
    )
    left = F.col("v") * (1 - F.col("r2"))
    bic = lambda v, k: F.col("n") * F.log(F.greatest(v, F.lit(1e-300))) + k * F.log("n")
    s = s.where("n > 2 and v > 0 and r2 is not null").withColumn("bic_constant", bic(F.col("v"), 1)).withColumn("bic_linear", bic(left, 2))
    return s.withColumn("law", F.when(F.col("bic_linear") < F.col("bic_constant"), "linear").otherwise("constant")).drop("v", "r2")
