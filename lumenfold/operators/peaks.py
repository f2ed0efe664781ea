"""Peak selection, downsampling, aliases and combinations on spectra (object_id, k, f, power)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Cycles per day of the sidereal and solar day, synodic month and year.
CLASSIC_WINDOW = ((1.00273791, "sidereal day"), (1.0, "solar day"), (0.03386319, "synodic month"), (0.00273791, "year"))


def _score(sense: str) -> Column:
    s = F.col("power") if sense == "max" else -F.col("power")
    return F.when(F.isnan(s) | s.isNull(), F.lit(float("-inf"))).otherwise(s)


def local_maxima(spectrum: DataFrame, sense: str = "max") -> DataFrame:
    """Interior samples above the one before and not below the one after, and rising edges of the grid."""
    w = Window.partitionBy("object_id").orderBy("k")
    df = spectrum.withColumn("score", _score(sense)).withColumn("_p", F.lag("score").over(w)).withColumn("_n", F.lead("score").over(w))
    keep = (F.col("_p").isNull() | (F.col("score") > F.col("_p"))) & (F.col("_n").isNull() | (F.col("score") >= F.col("_n"))) & (F.col("_p").isNotNull() | F.col("_n").isNotNull())
    return df.where(keep).drop("_p", "_n")


def refined(spectrum: DataFrame, sense: str = "max") -> DataFrame:
    """Local maxima with the frequency of the parabola through three samples."""
    w = Window.partitionBy("object_id").orderBy("k")
    df = spectrum.withColumn("_a", F.lag("power").over(w)).withColumn("_c", F.lead("power").over(w)).withColumn("_df", F.lead("f").over(w) - F.col("f"))
    bend = F.col("_a") - 2 * F.col("power") + F.col("_c")
    shift = F.when(bend != 0, 0.5 * (F.col("_a") - F.col("_c")) / F.nullif(bend, F.lit(0.0))).otherwise(F.lit(0.0))
    better = (lambda x: F.col("power") > x, lambda x: F.col("power") >= x) if sense == "max" else (lambda x: F.col("power") < x, lambda x: F.col("power") <= x)
    return df.where(better[0](F.col("_a")) & better[1](F.col("_c"))).withColumn("f_refined", F.col("f") + shift * F.col("_df")).drop("_a", "_c", "_df")


def best_peak(spectrum: DataFrame, sense: str = "max", digits: int = 9) -> DataFrame:
    """The best sample per object; the lowest k wins ties of the rounded score."""
    s = spectrum.withColumn("_s", F.struct(F.round(_score(sense), digits).alias("s"), (-F.col("k")).alias("k")))
    return s.groupBy("object_id").agg(F.max_by(F.struct("k", "f", "power"), "_s").alias("b")).select("object_id", "b.*").withColumn("period", 1.0 / F.col("f"))


def top_peaks(spectrum: DataFrame, n: int = 3, separation: int = 15, sense: str = "max", digits: int = 9) -> DataFrame:
    """Greedy choice of the ``n`` best local maxima that lie ``separation`` grid steps or more apart; rank from 1."""
    c = local_maxima(spectrum, sense)
    packed = c.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct((-F.round("score", digits)).alias("s"), "k", "f", "power"))).alias("c"))
    item = "struct<s:double,k:int,f:double,power:double>"

    def take(acc: Column, x: Column) -> Column:
        free = (F.size(acc) < n) & F.forall(acc, lambda a: F.abs(a["k"] - x["k"]) >= separation)
        return F.when(free, F.concat(acc, F.array(x))).otherwise(acc)

    chosen = F.aggregate(F.col("c").cast(f"array<{item}>"), F.array().cast(f"array<{item}>"), take)
    out = packed.select("object_id", F.posexplode(chosen).alias("rank", "b"))
    return out.select("object_id", (F.col("rank") + 1).alias("rank"), "b.k", "b.f", "b.power")


def alias_related(f: Column, other: Column, tolerance: Column, harmonics: int = 8) -> Column:
    """Whether two frequencies are harmonics, or a sampling alias of the day or year, of each other."""
    close = lambda a, b, m=1.0: F.abs(a - b) <= m * tolerance
    out = close(f, other)
    for m in range(2, harmonics + 1):
        out = out | close(f, m * other, m) | close(m * f, other, m)
    for day, _ in CLASSIC_WINDOW[:2]:
        for m in (1, 2):
            out = out | close(f, other + m * day) | close(f, F.abs(other - m * day))
    year = CLASSIC_WINDOW[3][0]
    return out | close(f, other + year) | close(f, other - year)


def diverse_peaks(spectrum: DataFrame, n: int = 3, sense: str = "max", digits: int = 9, tolerance: float = 0.01) -> DataFrame:
    """Greedy choice that skips peaks related to a chosen one as harmonic or alias."""
    c = local_maxima(spectrum, sense)
    packed = c.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct((-F.round("score", digits)).alias("s"), "k", "f", "power"))).alias("c"))
    item = "struct<s:double,k:int,f:double,power:double>"

    def take(acc: Column, x: Column) -> Column:
        free = (F.size(acc) < n) & ~F.exists(acc, lambda a: alias_related(x["f"], a["f"], F.lit(tolerance)))
        return F.when(free, F.concat(acc, F.array(x))).otherwise(acc)

    chosen = F.aggregate(F.col("c").cast(f"array<{item}>"), F.array().cast(f"array<{item}>"), take)
    out = packed.select("object_id", F.posexplode(chosen).alias("rank", "b"))
    return out.select("object_id", (F.col("rank") + 1).alias("rank"), "b.k", "b.f", "b.power")


def downsample(spectrum: DataFrame, bins: int = 20, sense: str = "max", digits: int = 9) -> DataFrame:
    """The best sample of each of ``bins`` equal stretches of the grid; the first wins ties."""
    nf = F.max("k").over(Window.partitionBy("object_id")) + 1
    df = spectrum.withColumn("bin", F.floor(F.col("k") * bins / nf)).withColumn("_s", F.struct(F.round(_score(sense), digits).alias("s"), (-F.col("k")).alias("k")))
    return df.groupBy("object_id", "bin").agg(F.max_by(F.struct("k", "f", "power"), "_s").alias("b")).select("object_id", "bin", "b.*")


def detection_efficiency(spectrum: DataFrame) -> DataFrame:
    """Signal detection efficiency: power standardised over the object's grid."""
    w = Window.partitionBy("object_id")
    sd = F.stddev_pop("power").over(w)
    return spectrum.withColumn("sde", F.when(sd > 0, (F.col("power") - F.avg("power").over(w)) / F.nullif(sd, F.lit(0.0))).otherwise(F.lit(0.0)))


def noise_level(spectrum: DataFrame, half_width: float = 1.0) -> DataFrame:
    """Mean amplitude within ``half_width`` in frequency of each sample."""
    over = f"OVER (PARTITION BY object_id ORDER BY f RANGE BETWEEN {half_width}D PRECEDING AND {half_width}D FOLLOWING)"
    return spectrum.withColumn("noise", F.expr(f"avg(amplitude) {over}")).withColumn("n_noise", F.expr(f"count(amplitude) {over}"))


def alias_candidates(best: DataFrame, harmonics: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(object_id, f0, kind, predicted): aliases f0 +- m fw of the classic window and (sub)harmonics."""
    rows = [F.struct(F.lit(f"{name} {'+' if s > 0 else '-'}{m}").alias("kind"), F.abs(F.col("f") + s * m * F.lit(fw)).alias("predicted")) for fw, name in CLASSIC_WINDOW for m in (1, 2) for s in (1, -1)]
    rows += [F.struct(F.lit(f"harmonic {h}").alias("kind"), (F.col("f") * h).alias("predicted")) for h in harmonics]
    rows += [F.struct(F.lit(f"subharmonic {h}").alias("kind"), (F.col("f") / h).alias("predicted")) for h in harmonics]
    return best.select("object_id", F.col("f").alias("f0"), F.explode(F.array(*rows)).alias("c")).select("object_id", "f0", "c.*")


def match_aliases(spectrum: DataFrame, candidates: DataFrame, reach: float = 3.0, sense: str = "max") -> DataFrame:
    """The nearest local optimum within ``reach`` / T of each candidate. ``spectrum`` has baseline."""
    optima = local_maxima(spectrum, sense).select(F.col("object_id").alias("_o"), F.col("f").alias("f_peak"), "power", "baseline")
    j = candidates.join(optima, (F.col("object_id") == F.col("_o")) & (F.abs(F.col("f_peak") - F.col("predicted")) <= reach / F.col("baseline")))
    near = F.struct(F.round(F.abs(F.col("f_peak") - F.col("predicted")), 9), "f_peak")
    return j.groupBy("object_id", "kind").agg(F.min_by(F.struct("predicted", "f_peak", "power"), near).alias("b")).select("object_id", "kind", "b.*")


def combinations(components: DataFrame, tolerance: float, order: int = 2) -> DataFrame:
    """Components (object_id, rank, f) that are n1 f_i + n2 f_j of stronger ones, simplest match first."""
    vectors = [(a, b) for a in range(-order, order + 1) for b in range(-order, order + 1) if (a or b) and abs(a) + abs(b) > 1]
    table = F.array(*[F.struct(F.lit(a).alias("n1"), F.lit(b).alias("n2")) for a, b in vectors])
    parents = components.select("object_id", F.col("rank").alias("r1"), F.col("f").alias("f1"))
    second = components.select("object_id", F.col("rank").alias("r2"), F.col("f").alias("f2"))
    pairs = parents.join(second, "object_id").where("r1 < r2").unionByName(parents.withColumn("r2", F.col("r1")).withColumn("f2", F.lit(0.0)))
    children = components.select("object_id", "rank", "f")
    j = children.join(pairs, "object_id").where("r1 < rank and r2 < rank").withColumn("v", F.explode(table)).where("r1 <> r2 or v.n2 = 0")
    hit = j.withColumn("value", F.col("v.n1") * F.col("f1") + F.col("v.n2") * F.col("f2")).where(F.abs(F.col("value") - F.col("f")) <= tolerance)
    order_by = F.struct(F.abs("v.n1") + F.abs("v.n2"), F.round(F.abs(F.col("value") - F.col("f")), 9), "r1", "r2", "v.n1", "v.n2")
    return hit.groupBy("object_id", "rank").agg(F.min_by(F.struct("f", "r1", "r2", F.col("v.n1").alias("n1"), F.col("v.n2").alias("n2"), "value"), order_by).alias("b")).select("object_id", "rank", "b.*")


def wide_rows(peaks: DataFrame, n: int = 3) -> DataFrame:
    """One row per object: period_k and power_k for each rank."""
    cols = []
    for r in range(1, n + 1):
        cols += [F.max(F.when(F.col("rank") == r, 1.0 / F.col("f"))).alias(f"period_{r}"), F.max(F.when(F.col("rank") == r, F.col("power"))).alias(f"power_{r}")]
    return peaks.groupBy("object_id").agg(*cols)


def noise_curve(spectrum: DataFrame, window: float = 1.0, estimator: str = "mean", least: int = 25) -> DataFrame:
    """``spectrum`` (object_id, k from 0, f, amplitude) with ``noise``: mean or median amplitude within ``window`` of each frequency, or of the ``least`` nearest samples where the window holds fewer.

    Non-finite amplitudes count as samples but not in the estimate. Boxes are RANGE frames; where they are too small,
    ROWS frames, which at the ends of the grid become its first or last samples.
    """
    if estimator not in ("mean", "median"):
        raise ValueError(f"unknown estimator {estimator!r}; there are mean, median")
    g = Window.partitionBy("object_id")
    value = F.when(~F.isnan("amplitude"), F.col("amplitude"))
    level = (lambda x: F.avg(x)) if estimator == "mean" else (lambda x: F.percentile(x, F.lit(0.5)))
    near = f"OVER (PARTITION BY object_id ORDER BY f RANGE BETWEEN {float(window)}D PRECEDING AND {float(window)}D FOLLOWING)"
    half = max(1, least // 2)
    rows = g.orderBy("k").rowsBetween(-half, least - half - 1)
    s = spectrum.withColumn("_v", value).withColumn("_n", F.count("*").over(g)).withColumn("_box", F.expr(f"count(*) {near}"))
    first, last = level(F.when(F.col("k") < least, F.col("_v"))).over(g), level(F.when(F.col("k") >= F.col("_n") - least, F.col("_v"))).over(g)
    few = F.when((F.col("k") <= half) | (F.col("_n") <= least), first).when(F.col("k") - half > F.col("_n") - least, last).otherwise(level("_v").over(rows))
    short = F.col("_box") < F.least(F.lit(least), F.col("_n"))
    return s.withColumn("noise", F.when(short, few).otherwise(F.expr(f"{'avg(_v)' if estimator == 'mean' else 'percentile(_v, 0.5D)'} {near}"))).drop("_v", "_n", "_box")
