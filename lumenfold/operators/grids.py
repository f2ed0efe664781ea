"""Trial grids that follow each object's sampling: one row (object_id, f0, df, nf, ...) per object, by aggregates and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Most samples of a grid, and the size from which an automatic one is marked as large.
MAX_SIZE = 250_000_000
LARGE_SIZE = 5_000_000
#: Rayleigh widths that the ceiling of a multi-exposure cadence may span, the gap (in median gaps) that ends
#: a visit, and the most exposures of a visit.
VISIT_BUDGET = 100_000.0
VISIT_GAP = 10.0
VISIT_SIZE = 10
#: Gaps a lattice must hold, its largest divisor, tolerance, coherence, and the gaps needed to judge it.
LATTICE_SHARE = 0.9
LATTICE_DIVISORS = 10
LATTICE_TOLERANCE = 0.01
LATTICE_COHERENCE = 0.9
LATTICE_GAPS = 8


def _gaps(obs: DataFrame) -> DataFrame:
    """Points with the gap to the one before and the object's median positive gap."""
    w = Window.partitionBy("object_id").orderBy("t", "rid")
    return obs.select("object_id", "t", "rid").withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("median_gap", F.expr("percentile(CASE WHEN gap > 0 THEN gap END, 0.5D) OVER (PARTITION BY object_id)"))


def pseudo_nyquist(obs: DataFrame, factor: float = 5.0) -> DataFrame:
    """object_id, n, baseline and fmax: ``factor`` / 2 over the median gap, or a ceiling by visits where most gaps lie inside short ones."""
    w = Window.partitionBy("object_id").orderBy("t", "rid")
    g = _gaps(obs).withColumn("new", F.coalesce(F.col("gap") > VISIT_GAP * F.col("median_gap"), F.lit(False)).cast("int"))
    g = g.withColumn("visit", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = g.withColumn("size", F.count("*").over(Window.partitionBy("object_id", "visit")))
    starts = g.groupBy("object_id", "visit").agg(F.min("t").alias("start"))
    starts = starts.withColumn("between", F.col("start") - F.lag("start").over(Window.partitionBy("object_id").orderBy("visit")))
    visits = starts.groupBy("object_id").agg(F.expr("percentile(CASE WHEN between > 0 THEN between END, 0.5D)").alias("visit_gap"))
    inside = (F.col("new") == 0) & (F.col("gap") > 0) & (F.col("size") <= VISIT_SIZE)
    s = g.groupBy("object_id").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("baseline"), F.first("median_gap").alias("median_gap"), F.count_if(F.col("gap") > 0).alias("gaps"), F.count_if(inside).alias("inside"))
    s = s.join(visits, "object_id")
    classic = F.lit(factor * 0.5) / F.col("median_gap")
    budget = VISIT_BUDGET * max(1.0, factor / 5.0)
    by_visit = F.coalesce(F.lit(factor * 0.5) / F.col("visit_gap"), F.lit(0.0))
    plain = (classic * F.col("baseline") <= budget) | (F.col("inside") * 2 < F.col("gaps"))
    fmax = F.when(F.col("gaps") == 0, F.lit(float(factor))).when(plain, classic).otherwise(F.least(classic, F.greatest(F.lit(budget) / F.col("baseline"), by_visit)))
    return s.select("object_id", "n", "baseline", fmax.alias("fmax"))


def lattice_nyquist(obs: DataFrame) -> DataFrame:
    """object_id, divisor, step, coherence and nyquist (1/2 over the step) of objects that are sampled on a lattice."""
    g = _gaps(obs)
    ratio = lambda d: F.col("gap") * d / F.col("median_gap")
    on = [F.avg(F.when(F.col("gap") > 0, (F.abs(ratio(d) - F.round(ratio(d))) <= LATTICE_TOLERANCE).cast("double"))).alias(f"d{d}") for d in range(1, LATTICE_DIVISORS + 1)]
    s = g.groupBy("object_id").agg(F.count_if(F.col("gap") > 0).alias("gaps"), *on).where(F.col("gaps") >= LATTICE_GAPS)
    first = F.coalesce(*[F.when(F.col(f"d{d}") >= LATTICE_SHARE, F.lit(d)) for d in range(1, LATTICE_DIVISORS + 1)])
    s = s.select("object_id", first.alias("divisor")).where(F.col("divisor").isNotNull())
    w = Window.partitionBy("object_id").orderBy("t", "rid").rowsBetween(Window.unboundedPreceding, 0)
    p = g.join(s, "object_id").withColumn("index", F.sum(F.coalesce(F.round(ratio(F.col("divisor"))), F.lit(0.0))).over(w))
    p = p.withColumn("offset", F.col("t") - F.min("t").over(Window.partitionBy("object_id")))
    fit = p.groupBy("object_id").agg(F.first("divisor").alias("divisor"), F.regr_slope("offset", "index").alias("step"), F.regr_intercept("offset", "index").alias("at")).where("step > 0")
    turn = 2 * math.pi * (F.col("offset") - F.col("at") - F.col("step") * F.col("index")) / F.col("step")
    r = p.select("object_id", "offset", "index").join(fit, "object_id").groupBy("object_id").agg(F.first("divisor").alias("divisor"), F.first("step").alias("step"), F.hypot(F.avg(F.cos(turn)), F.avg(F.sin(turn))).alias("coherence"))
    return r.where(F.col("coherence") >= LATTICE_COHERENCE).withColumn("nyquist", 0.5 / F.col("step"))


def _size(x: Column) -> Column:
    return F.least(x, F.lit(float(1 << 62))).cast("long")


def uniform_size(baseline: Column, fmax: Column, f0: Column, samples_per_peak: float = 5.0) -> Column:
    """Samples of a uniform grid from f0 that reaches fmax."""
    return _size(F.greatest(F.ceil((fmax - f0) * samples_per_peak * baseline) + 1, F.lit(1)))


def checked(grid: DataFrame, limit: int = MAX_SIZE, refuse: bool = True) -> DataFrame:
    """``grid`` with ``large`` (an automatic grid past LARGE_SIZE); raises when an object's grid exceeds the limit, or with ``refuse`` off makes its nf null."""
    error = F.raise_error(F.concat(F.lit("the grid of object "), "object_id", F.lit(f" exceeds {limit} samples")))
    return grid.withColumn("nf", F.when(F.col("nf") > limit, error.cast("long") if refuse else F.lit(None).cast("long")).otherwise(F.col("nf"))).withColumn("large", F.coalesce(F.col("nf") > LARGE_SIZE, F.lit(True)))


def without_trials(obs: DataFrame, grid: DataFrame) -> DataFrame:
    """object_id and reason of objects that a grid table has no trials for."""
    known = grid.groupBy("object_id").agg(F.max("nf").alias("nf"))
    lost = obs.select("object_id").distinct().join(known, "object_id", "left").where("nf IS NULL")
    return lost.join(grid.select("object_id").distinct().withColumn("listed", F.lit(True)), "object_id", "left").select("object_id", F.when(F.col("listed"), "its grid exceeds the largest size").otherwise("no trial period within the baseline").alias("reason"))


def gls_grid(obs: DataFrame, samples_per_peak: float = 5.0, factor: float = 5.0, fmin: float | None = None, fmax: float | None = None, refuse: bool = True) -> DataFrame:
    """1/T to ``factor`` times the average Nyquist frequency N/2T, stopped at the Nyquist frequency of a lattice; objects without a baseline have no row."""
    s = obs.groupBy("object_id").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("baseline")).where("baseline > 0")
    f0 = F.lit(fmin) if fmin is not None else 1.0 / F.col("baseline")
    s = s.withColumn("f0", f0)
    if fmax is None:
        s = s.withColumn("fmax", factor * 0.5 * F.col("n") / F.col("baseline")).join(lattice_nyquist(obs).select("object_id", "nyquist"), "object_id", "left")
        s = s.withColumn("fmax", F.when((F.col("nyquist") > F.col("f0")) & (F.col("nyquist") < F.col("fmax")), F.col("nyquist")).otherwise(F.col("fmax")))
    else:
        s = s.withColumn("fmax", F.lit(float(fmax)))
    s = s.where("fmax > f0").withColumn("df", 1.0 / (samples_per_peak * F.col("baseline")))
    # half a sample is rounded down: for odd N the exact size ends in one half, which noise would decide
    nf = _size(F.floor((F.col("fmax") - F.col("f0")) / F.col("df") + 0.5 - 1e-6) + 1)
    return checked(s.select("object_id", "n", "baseline", "f0", "df", "fmax", nf.alias("nf")), refuse=refuse)


def fold_grid(obs: DataFrame, samples_per_peak: float = 5.0, factor: float = 5.0, floor: float = 0.0, stop_at_nyquist: bool = False, refuse: bool = True) -> DataFrame:
    """1/T to the pseudo-Nyquist frequency (``floor`` at least), for methods that fold."""
    s = pseudo_nyquist(obs, factor).where("baseline > 0").withColumn("fmax", F.greatest("fmax", F.lit(float(floor))))
    if stop_at_nyquist:
        s = s.join(lattice_nyquist(obs).select("object_id", "nyquist"), "object_id", "left").withColumn("fmax", F.least("fmax", "nyquist"))
    s = s.withColumn("f0", 1.0 / F.col("baseline")).withColumn("df", 1.0 / (samples_per_peak * F.col("baseline"))).where("fmax > f0")
    return checked(s.select("object_id", "n", "baseline", "f0", "df", "fmax", uniform_size(F.col("baseline"), F.col("fmax"), F.col("f0"), samples_per_peak).alias("nf")), refuse=refuse)


def box_segments(obs: DataFrame, shortest: float = 0.2, longest: float = 100.0, transits: int = 2, factor: float = 2.0, share: float = 0.05, oversample: int = 2, refuse: bool = True) -> DataFrame:
    """Period segments of the box search (object_id, segment, p_lo, p_hi, f0, df, nf): each ``factor`` long, uniform in frequency."""
    s = obs.groupBy("object_id").agg((F.max("t") - F.min("t")).alias("baseline")).withColumn("p_max", F.least(F.lit(longest), F.col("baseline") / transits)).where(F.col("p_max") > shortest)
    last = F.ceil(F.log(F.col("p_max") / shortest) / math.log(factor) - 1e-9) - 1
    s = s.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    s = s.withColumn("p_lo", shortest * F.pow(F.lit(factor), F.col("segment").cast("double"))).withColumn("p_hi", F.least(F.col("p_lo") * factor, F.col("p_max")))
    s = s.withColumn("f0", 1.0 / F.col("p_hi")).withColumn("df", F.lit(share) / (oversample * F.col("baseline")))
    return checked(s.select("object_id", "segment", "p_lo", "p_hi", "f0", "df", _size(F.ceil((1.0 / F.col("p_lo") - F.col("f0")) / F.col("df"))).alias("nf")), refuse=refuse)


def transit_grid(obs: DataFrame, shortest: float = 0.5, longest: float = 100.0, transits: int = 2, share: float = 0.05, least_duration: float = 0.01, oversample: int = 2, refuse: bool = True) -> DataFrame:
    """Trial frequencies of the transit search: the step drifts no more than twice the shortest transit over the baseline."""
    s = obs.groupBy("object_id").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("baseline")).withColumn("p_max", F.least(F.lit(longest), F.col("baseline") / transits)).where(F.col("p_max") > shortest)
    s = s.withColumn("f0", 1.0 / F.col("p_max")).withColumn("df", F.lit(min(share, 2.0 * least_duration)) / (oversample * F.col("baseline")))
    return checked(s.select("object_id", "n", "baseline", "f0", "df", F.lit(1.0 / shortest).alias("fmax"), _size(F.ceil((1.0 / shortest - F.col("f0")) / F.col("df"))).alias("nf")), refuse=refuse)


def box_grid(obs: DataFrame, refuse: bool = True, **settings) -> DataFrame:
    """The segments of the box search as one grid of frequencies."""
    s = box_segments(obs, refuse=refuse, **settings).groupBy("object_id").agg(F.min("f0").alias("f0"), F.first("df").alias("df"), (1.0 / F.min("p_lo")).alias("fmax"))
    stats = obs.groupBy("object_id").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("baseline"))
    return checked(stats.join(s, "object_id").select("object_id", "n", "baseline", "f0", "df", "fmax", _size(F.ceil((F.col("fmax") - F.col("f0")) / F.col("df"))).alias("nf")), refuse=refuse)


def log_periods(objects: DataFrame, shortest: float, longest: float, n: int) -> DataFrame:
    """(object_id, k, period): ``n`` periods in even steps of their logarithm, both ends included."""
    step = (math.log(longest) - math.log(shortest)) / max(n - 1, 1)
    k = objects.select("object_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return k.withColumn("period", F.exp(math.log(shortest) + F.col("k") * F.lit(step)))


GRIDS = {"gls": gls_grid, "pdm": fold_grid, "ce": fold_grid, "sl": fold_grid, "mhaov": fold_grid, "supersmoother": fold_grid, "bls": box_grid, "tls": transit_grid}


def default_grid(obs: DataFrame, method: str, oversized: str = "raise", **settings) -> DataFrame:
    """The automatic grid of a method. An object whose grid exceeds MAX_SIZE ends the query, or with ``oversized`` "skip" has nf null and is searched by none."""
    if method not in GRIDS:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(sorted(GRIDS))}")
    if oversized not in ("raise", "skip"):
        raise ValueError("oversized grids raise or skip")
    return GRIDS[method](obs, refuse=oversized == "raise", **settings)
