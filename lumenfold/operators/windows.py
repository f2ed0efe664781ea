"""Time windows over observations: cadence, partitions, trends, sliding spectra, wavelets."""

from __future__ import annotations

import math

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import spectra


def by_time(*by: str):
    return Window.partitionBy(*(by or ("object_id",))).orderBy("t", "rid")


def cadence(obs: DataFrame) -> DataFrame:
    """Positive gaps per object: number, median, and the pseudo-Nyquist frequency 0.5 / median."""
    gaps = obs.withColumn("gap", F.col("t") - F.lag("t").over(by_time())).where("gap > 0")
    return gaps.groupBy("object_id").agg(F.count("*").alias("n_gaps"), F.expr("percentile(gap, 0.5D)").alias("median_gap")).withColumn("pseudo_nyquist", 0.5 / F.col("median_gap"))


def gap_partition(obs: DataFrame, min_gap: float) -> DataFrame:
    """A new subset (code from 0) after each gap longer than ``min_gap`` days."""
    new = F.when(F.col("t") - F.lag("t").over(by_time()) > min_gap, 1).otherwise(0)
    return obs.withColumn("_new", new).withColumn("subset", F.sum("_new").over(by_time().rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def chunk_partition(obs: DataFrame, length: float, origin: float | None = None) -> DataFrame:
    """Fixed-length chunks from the first time or an origin."""
    start = F.min("t").over(Window.partitionBy("object_id")) if origin is None else F.lit(origin)
    return obs.withColumn("subset", F.floor((F.col("t") - start) / length))


def range_partition(obs: DataFrame, edges: list[float]) -> DataFrame:
    """The number of edges at or before each time."""
    at = sum((F.when(F.col("t") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return obs.withColumn("subset", at)


def subset_spans(parts: DataFrame) -> DataFrame:
    """Points and first and last time of each subset."""
    return parts.groupBy("object_id", "subset").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def runs(obs: DataFrame, label: str = "band") -> DataFrame:
    """Maximal runs of equal labels in time order."""
    change = F.when(F.col(label).eqNullSafe(F.lag(label).over(by_time())), 0).otherwise(1)
    df = obs.withColumn("_c", change).withColumn("run", F.sum("_c").over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy("object_id", "run").agg(F.first(label).alias(label), F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


def running_median(obs: DataFrame, width: float, min_points: int = 5) -> DataFrame:
    """Median within ``width`` / 2 days on either side; thin windows take the object's median."""
    near = f"OVER (PARTITION BY object_id ORDER BY t RANGE BETWEEN {width / 2}D PRECEDING AND {width / 2}D FOLLOWING)"
    local, n = F.expr(f"percentile(y, 0.5D) {near}"), F.expr(f"count(y) {near}")
    whole = F.expr("percentile(y, 0.5D) OVER (PARTITION BY object_id)")
    return obs.withColumn("_whole", whole).withColumn("trend", F.when(n >= min_points, local).otherwise(F.col("_whole")))


def detrend(obs: DataFrame, width: float, min_points: int = 5) -> DataFrame:
    """Values less their running median, at the object's median level."""
    return running_median(obs, width, min_points).withColumn("y", F.col("y") - F.col("trend") + F.col("_whole")).drop("_whole", "trend")


def binned_trend(obs: DataFrame, width: float) -> DataFrame:
    """Median time and value of half-width bins."""
    df = chunk_partition(obs, width / 2)
    return df.groupBy("object_id", "subset").agg(F.expr("percentile(t, 0.5D)").alias("t"), F.expr("percentile(y, 0.5D)").alias("y"), F.count("*").alias("n"))


def interpolated_trend(obs: DataFrame, width: float, least: int = 1) -> DataFrame:
    """``obs`` with ``trend``: straight lines between the medians of half-width bins of ``least`` points or more, level beyond the first and last; an object of under two such bins takes its median."""
    nodes = binned_trend(obs, width).where(F.col("n") >= least).select("object_id", F.col("t").alias("nt"), F.col("y").alias("ny"))
    line = nodes.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("nt", "ny"))).alias("_n"))
    df = obs.join(line, "object_id", "left").withColumn("_m", F.expr("percentile(y, 0.5D) OVER (PARTITION BY object_id)"))
    after = F.size(F.filter("_n", lambda p: p["nt"] <= F.col("t")))  # nodes up to the point
    lo, hi = F.get(F.col("_n"), F.greatest(after - 1, F.lit(0))), F.get(F.col("_n"), F.least(after, F.size("_n") - 1))
    inside = (after > 0) & (after < F.size("_n"))
    slope = (hi["ny"] - lo["ny"]) / F.nullif(hi["nt"] - lo["nt"], F.lit(0.0))
    level = F.when(inside, lo["ny"] + slope * (F.col("t") - lo["nt"])).when(after == 0, lo["ny"]).otherwise(hi["ny"])
    return df.withColumn("trend", F.when(F.coalesce(F.size("_n"), F.lit(0)) < 2, F.col("_m")).otherwise(level)).drop("_n", "_m")


def window_starts(obs: DataFrame, window: float, step: float) -> DataFrame:
    """(object_id, w_idx, w_start, w_end, is_last): windows every ``step`` while they fit, and one flush with the end if more than half a step is left.

    Objects whose baseline is shorter than the window have none. The last window reaches the last point where it falls short of it by rounding alone.
    """
    s = obs.groupBy("object_id").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    tiny = 1e-9 * max(window, 1.0)
    count = F.floor((F.col("t1") - F.col("t0") - window + tiny) / step) + 1
    s = s.withColumn("count", count).where("count >= 1")
    start = F.transform(F.sequence(F.lit(0).cast("long"), F.col("count") - 1), lambda i: F.col("t0") + F.lit(step) * i)
    left = F.col("t1") - (F.col("t0") + F.lit(step) * (F.col("count") - 1) + window)
    s = s.withColumn("starts", F.when(left > 0.5 * step, F.concat(start, F.array(F.col("t1") - window))).otherwise(start))
    s = s.select("object_id", "t1", F.size("starts").alias("m"), F.posexplode("starts").alias("w_idx", "w_start"))
    s = s.withColumn("is_last", F.col("w_idx") == F.col("m") - 1).withColumn("hi", F.col("w_start") + window)
    snap = F.col("is_last") & (F.col("hi") < F.col("t1")) & (F.col("t1") - F.col("hi") <= tiny)
    return s.select("object_id", F.col("w_idx").cast("long").alias("w_idx"), "w_start", F.when(snap, F.col("t1")).otherwise(F.col("hi")).alias("w_end"), "is_last")


def in_windows(obs: DataFrame, window: float, step: float) -> DataFrame:
    """Points copied into each of their object's ``window_starts``; the last window is closed."""
    w = window_starts(obs, window, step).groupBy("object_id").agg(F.collect_list(F.struct("w_idx", "w_start", "w_end", "is_last")).alias("_w"))
    df = obs.join(w, "object_id").withColumn("_x", F.explode("_w")).select(*obs.columns, "_x.*")
    inside = (F.col("t") >= F.col("w_start")) & ((F.col("t") < F.col("w_end")) | F.col("is_last") & (F.col("t") <= F.col("w_end")))
    return df.where(inside).drop("w_end", "is_last")


def sliding_gls(obs: DataFrame, window: float, step: float, f0: float, df: float, nf: int, min_points: int = 8) -> DataFrame:
    """Lomb-Scargle power of each window on one shared grid: object_id, w_idx, k, f, power, mid."""
    key = ("object_id", "w_idx")
    part = in_windows(obs, window, step)
    c = spectra.centred(part, False, key, key).where(F.col("n") >= min_points)
    g = c.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(nf - 1)))).withColumn("f", F.lit(f0) + F.col("k") * F.lit(df))
    mid = g.groupBy(*key).agg(F.first("w_start").alias("w_start"))
    s = spectra.trig_sums(g, *key, "k").select(*key, "k", "f", spectra.closed_form().alias("power"))
    return s.join(mid, [*key]).withColumn("mid", F.col("w_start") + window / 2).drop("w_start")


def partition_gls(points: DataFrame, f0: float, df: float, nf: int, min_points: int = 8) -> DataFrame:
    """Lomb-Scargle power of each subset of a partition on one shared grid: object_id, subset, k, f, power."""
    key = ("object_id", "subset")
    c = spectra.centred(points, False, key, key).where(F.col("n") >= min_points)
    g = c.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(nf - 1)))).withColumn("f", F.lit(f0) + F.col("k") * F.lit(df))
    return spectra.trig_sums(g, *key, "k").select(*key, "k", "f", spectra.closed_form().alias("power"))


def window_periodogram(sliding: DataFrame, window: int) -> DataFrame:
    """The spectrum of one window of a sliding map, as a spectrum of its own."""
    return sliding.where(F.col("w_idx") == window).select("object_id", "k", "f", "power")


def period_trend(sliding: DataFrame) -> DataFrame:
    """Straight line through each window's best frequency: slope of f and the relative period change a day."""
    best = sliding.withColumn("_s", F.struct(F.round("power", 9).alias("s"), (-F.col("k")).alias("k"))).groupBy("object_id", "w_idx").agg(F.max_by(F.struct("f", "mid"), "_s").alias("b")).select("object_id", "b.*")
    out = best.groupBy("object_id").agg(F.count("*").alias("n"), F.regr_slope("f", "mid").alias("slope"), F.avg("f").alias("mean_f"))
    return out.withColumn("relative_change", -F.col("slope") / F.col("mean_f"))


def wwz(obs: DataFrame, n_tau: int, frequencies: list[float] | None = None, c: float = 0.0125, min_neff: float = 3.5, fmax: float | None = None) -> DataFrame:
    """Weighted wavelet Z (Foster 1996) on ``n_tau`` times over the baseline and a list of frequencies, or on each object's own: from 2/T up to ``fmax`` (half the average sampling rate) in the ratio that keeps the wavelet's resolution.

    The projection on (1, cos, sin) is solved in closed form from twelve sums.
    """
    g = Window.partitionBy("object_id")
    df = obs.withColumn("_t0", F.min("t").over(g)).withColumn("_t1", F.max("t").over(g)).withColumn("yc", F.col("y") - F.avg("y").over(g))
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_tau - 1))))
    if frequencies is None:
        ratio, span = 1.0 + math.sqrt(2.0 * c) / 4.0, F.col("_t1") - F.col("_t0")
        top = F.lit(fmax) if fmax is not None else 0.5 * F.count("*").over(Window.partitionBy("object_id", "i")) / span
        df = df.where(span > 0).withColumn("_last", F.floor(F.log(top * span / 2) / math.log(ratio) + 1e-9).cast("int")).where("_last >= 0")
        df = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_last")))).withColumn("f", 2.0 / span * F.pow(F.lit(ratio), F.col("k").cast("double")))
    else:
        df = df.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(frequencies) - 1)))).withColumn("f", F.get(F.array(*map(F.lit, frequencies)), F.col("k")))
    df = df.withColumn("shift", F.col("_t0") + F.col("i") * (F.col("_t1") - F.col("_t0")) / F.lit(float(n_tau - 1)))
    df = df.withColumn("z", F.lit(2 * math.pi) * F.col("f") * (F.col("t") - F.col("shift"))).withColumn("w", F.exp(-c * F.col("z") * F.col("z")))
    w, co, si, y = F.col("w"), F.cos("z"), F.sin("z"), F.col("yc")
    s = df.groupBy("object_id", "i", "k").agg(
        F.first("f").alias("f"), F.first("shift").alias("shift"), F.sum(w).alias("s0"), F.sum(w * w).alias("sq"), F.sum(w * y).alias("sy"), F.sum(w * y * y).alias("syy"),
        F.sum(w * co).alias("sc"), F.sum(w * si).alias("ss"), F.sum(w * co * co).alias("scc"), F.sum(w * si * si).alias("sss"), F.sum(w * co * si).alias("scs"),
        F.sum(w * y * co).alias("syc"), F.sum(w * y * si).alias("sys"),
    )
    n = s.withColumn("neff", F.col("s0") * F.col("s0") / F.col("sq")).where(F.col("neff") >= min_neff)
    for a in ("sy", "syy", "sc", "ss", "scc", "sss", "scs", "syc", "sys"):
        n = n.withColumn(a, F.col(a) / F.col("s0"))
    cc, ss, cs = F.col("scc") - F.col("sc") * F.col("sc"), F.col("sss") - F.col("ss") * F.col("ss"), F.col("scs") - F.col("sc") * F.col("ss")
    yc, ys = F.col("syc") - F.col("sy") * F.col("sc"), F.col("sys") - F.col("sy") * F.col("ss")
    n = n.withColumn("det", cc * ss - cs * cs).withColumn("vx", F.col("syy") - F.col("sy") * F.col("sy")).where("det > 1e-9 and vx > 0")
    n = n.withColumn("vy", (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / F.col("det"))
    power = (F.col("neff") - 3) * F.col("vy") / (2 * F.greatest(F.col("vx") - F.col("vy"), 1e-12 * F.col("vx")))
    amplitude = F.hypot((ss * yc - cs * ys) / F.col("det"), (cc * ys - cs * yc) / F.col("det"))
    return n.select("object_id", "i", "k", "f", "shift", "neff", power.alias("power"), amplitude.alias("amplitude"))


def labelled(points: DataFrame, prefix: str = "N") -> DataFrame:
    """Points of a partition with label (prefix and number in order of subset) and weight 1."""
    number = F.dense_rank().over(Window.partitionBy("object_id").orderBy("subset"))
    return points.withColumn("label", F.concat(F.lit(prefix), number.cast("string"))).withColumn("weight", F.lit(1.0))


def _renumbered(points: DataFrame, *order: str) -> DataFrame:
    return points.withColumn("subset", (F.dense_rank().over(Window.partitionBy("object_id").orderBy(*order)) - 1).cast("long"))


def crossed(points: DataFrame, other: DataFrame) -> DataFrame:
    """Every (subset, other subset) that holds points, labelled a/b, weighing the product. Both are ``labelled`` points with rid."""
    o = other.select("object_id", "rid", F.col("subset").alias("_s"), F.col("label").alias("_l"), F.col("weight").alias("_w"))
    j = points.join(o, ["object_id", "rid"]).withColumn("_a", F.col("subset")).withColumn("label", F.concat_ws("/", "label", "_l")).withColumn("weight", F.col("weight") * F.col("_w"))
    return _renumbered(j, "_a", "_s").drop("_a", "_s", "_l", "_w")


def merged(points: DataFrame, a: int, b: int) -> DataFrame:
    """Subsets a and b as one at the lower number, with both labels and the lower one's weight."""
    lo, hi = min(a, b), max(a, b)
    g = Window.partitionBy("object_id")
    find = lambda c, n: F.max(F.when(F.col("subset") == n, F.col(c))).over(g)
    both = find("label", lo).isNotNull() & find("label", hi).isNotNull()
    new_label, new_weight = F.concat_ws("+", find("label", lo), find("label", hi)), find("weight", lo)
    part = both & F.col("subset").isin(lo, hi)
    df = points.withColumn("_part", part).withColumn("_l", new_label).withColumn("_w", new_weight).withColumn("_both", both)
    df = df.withColumn("label", F.when(F.col("_part"), F.col("_l")).otherwise(F.col("label"))).withColumn("weight", F.when(F.col("_part"), F.col("_w")).otherwise(F.col("weight")))
    moved = F.when(F.col("_part"), F.lit(lo)).when(F.col("_both") & (F.col("subset") > hi), F.col("subset") - 1).otherwise(F.col("subset"))
    return df.withColumn("subset", moved.cast("long")).drop("_part", "_l", "_w", "_both")


def split_at(points: DataFrame, time: float) -> DataFrame:
    """Subsets with points on both sides of a time as two, labelled with a and b."""
    w = Window.partitionBy("object_id", "subset")
    late = F.col("t") >= F.lit(time)
    df = points.withColumn("_late", late.cast("int")).withColumn("_cut", (F.min("t").over(w) < F.lit(time)) & (F.max("t").over(w) >= F.lit(time)))
    df = df.withColumn("label", F.when(F.col("_cut"), F.concat("label", F.when(late, "b").otherwise("a"))).otherwise(F.col("label")))
    df = df.withColumn("_old", F.col("subset")).withColumn("_late", F.when(F.col("_cut"), F.col("_late")).otherwise(F.lit(0)))
    return _renumbered(df, "_old", "_late").drop("_old", "_late", "_cut")


def renamed(points: DataFrame, subset: int, label: str) -> DataFrame:
    return points.withColumn("label", F.when(F.col("subset") == subset, F.lit(label)).otherwise(F.col("label")))


def with_weights(points: DataFrame, weights: DataFrame) -> DataFrame:
    """New weights from (object_id, subset, weight); subsets without one keep theirs."""
    w = weights.select("object_id", "subset", F.col("weight").alias("_w"))
    return points.join(w, ["object_id", "subset"], "left").withColumn("weight", F.coalesce("_w", "weight")).drop("_w")


def _regroup(points: DataFrame, choose) -> DataFrame:
    """Points with new subset numbers that ``choose`` gives from each object's subsets (subset, n, first, last), in order of time.

    Only one row per subset goes to Python, all of an object in one group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "subset"])
        return pd.DataFrame({"object_id": pdf["object_id"].to_numpy(), "subset": pdf["subset"].to_numpy(), "_new": choose(pdf["n"].tolist(), pdf["first"].tolist(), pdf["last"].tolist())})

    spans = points.groupBy("object_id", "subset").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    new = spans.groupBy("object_id").applyInPandas(run, "object_id string, subset long, _new long")
    return points.join(new, ["object_id", "subset"]).withColumn("subset", F.col("_new")).drop("_new")


def joined_runs(points: DataFrame, max_span: float) -> DataFrame:
    """Consecutive subsets as one while they span no more than ``max_span``."""

    def choose(n: list, first: list, last: list) -> list[int]:
        out, begin, number = [], first[0], 0
        for a, b in zip(first, last, strict=True):
            if b - begin > max_span and out:
                begin, number = a, number + 1
            out.append(number)
        return out

    return _regroup(points, choose)


def merged_small(points: DataFrame, min_points: int) -> DataFrame:
    """Subsets below ``min_points``, smallest first, joined to the neighbour across the smaller gap until none or one is left."""

    def choose(n: list, first: list, last: list) -> list[int]:
        groups = [[c, a, b, [i]] for i, (c, a, b) in enumerate(zip(n, first, last, strict=True))]
        while len(groups) > 1 and min(g[0] for g in groups) < min_points:
            i = min(range(len(groups)), key=lambda j: (groups[j][0], j))
            left = groups[i][1] - groups[i - 1][2] if i else math.inf
            right = groups[i + 1][1] - groups[i][2] if i + 1 < len(groups) else math.inf
            k = i - 1 if left <= right else i
            a, b = groups[k], groups.pop(k + 1)
            groups[k] = [a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), a[3] + b[3]]
        number = {i: g for g, group in enumerate(groups) for i in group[3]}
        return [number[i] for i in range(len(n))]

    return _regroup(points, choose)


#: Fixed values (days): gap and greatest median span of nights, gap of seasons, gap and span of sectors, least points of a subset.
NIGHT_GAP, NIGHT_SPAN, SEASON_GAP, SECTOR_GAP, SECTOR_SPAN, LEAST_POINTS = 0.5, 0.75, 60.0, 0.5, 28.5, 10


def suggest_partition(obs: DataFrame) -> DataFrame:
    """object_id and kind (night, season, sector or null): the obvious split of each object's sampling."""
    nights = merged_small(gap_partition(obs, NIGHT_GAP), LEAST_POINTS)
    sectors = merged_small(joined_runs(gap_partition(obs, SECTOR_GAP), SECTOR_SPAN), LEAST_POINTS)
    seasons = merged_small(gap_partition(obs, SEASON_GAP), LEAST_POINTS)
    span = nights.groupBy("object_id", "subset").agg((F.max("t") - F.min("t")).alias("span")).groupBy("object_id").agg(F.count("*").alias("nights"), F.expr("percentile(span, 0.5D)").alias("span"))
    count = lambda df, name: df.groupBy("object_id").agg(F.count_distinct("subset").alias(name))
    j = span.join(count(seasons, "seasons"), "object_id").join(count(sectors, "sectors"), "object_id")
    kind = F.when((F.col("nights") >= 2) & (F.col("span") < NIGHT_SPAN), "night").when(F.col("seasons") >= 2, "season").when(F.col("sectors") >= 2, "sector")
    return j.select("object_id", "nights", "seasons", "sectors", kind.alias("kind"))
