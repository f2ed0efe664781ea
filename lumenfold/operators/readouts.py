"""What is read off spectra, models, components and drift searches, as projections and aggregates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels, peaks, spread

#: Astronomical units a light day, days a year, and the greatest frequency at which window peaks are measured.
AU_PER_LIGHT_DAY = 173.14463267424034
DAYS_PER_YEAR = 365.25
WINDOW_FMAX = 5.5


def foldable(longest: Column, period: Column) -> Column:
    """Whether folding by a period gives finite phases."""
    q = longest / F.nullif(period, F.lit(0.0))
    return F.coalesce((period > 0) & (q < float("inf")), F.lit(False))


def valid_trials(valid: Column, value: Column) -> Column:
    """The value of valid trials, NaN of others."""
    return F.when(valid, value).otherwise(F.lit(float("nan")))


def in_domain(obs: DataFrame, domain: str, zero_point: float = 25.0) -> DataFrame:
    """Values and errors as flux or magnitude; ``obs`` has a column domain. Fluxes that are not positive have no magnitude."""
    flux, mag = F.pow(F.lit(10.0), -0.4 * (F.col("y") - zero_point)), F.when(F.col("y") > 0, -2.5 * F.log10("y") + zero_point)
    scale = F.lit(2.5 / math.log(10.0))
    there = F.col("domain") == domain
    y = F.when(there, F.col("y")).otherwise(flux if domain == "flux" else mag)
    dy = F.when(there, F.col("dy")).otherwise(F.col("dy") / scale * flux if domain == "flux" else F.when(F.col("y") > 0, scale * F.col("dy") / F.col("y")))
    return obs.withColumn("_y", y).withColumn("_dy", dy).drop("y", "dy").withColumnsRenamed({"_y": "y", "_dy": "dy"}).withColumn("domain", F.lit(domain))


def unused_removed(points: DataFrame, deleted: DataFrame, subsets: DataFrame) -> DataFrame:
    """Points that are neither deleted (object_id, rid) nor in an excluded subset (object_id, subset)."""
    return points.join(deleted.select("object_id", "rid").distinct(), ["object_id", "rid"], "left_anti").join(subsets.select("object_id", "subset").distinct(), ["object_id", "subset"], "left_anti")


def weighted_epoch(obs: DataFrame) -> DataFrame:
    """object_id and epoch: mean time, weighted by the errors where all are usable."""
    good = F.min(F.coalesce((F.col("dy") > 0) & (F.col("dy") < float("inf")), F.lit(False)))
    w = 1.0 / (F.col("dy") * F.col("dy"))
    return obs.groupBy("object_id").agg(F.when(good, F.sum(w * F.col("t")) / F.sum(w)).otherwise(F.avg("t")).alias("epoch"))


def centred_bands(obs: DataFrame) -> DataFrame:
    """Each band less its median, times from the object's first: what a joint search takes."""
    return obs.withColumn("y", F.col("y") - F.expr("percentile(y, 0.5D) OVER (PARTITION BY object_id, band)")).withColumn("tau", F.col("t") - F.min("t").over(Window.partitionBy("object_id")))


def readings(spectrum: DataFrame, wanted: DataFrame) -> DataFrame:
    """(object_id, wanted, k, f, power): the grid sample nearest to each wanted frequency, the lower one of two."""
    j = spectrum.join(wanted.select("object_id", "wanted"), "object_id")
    near = F.struct(F.round(F.abs(F.col("f") - F.col("wanted")), 12), "k")
    return j.groupBy("object_id", "wanted").agg(F.min_by(F.struct("k", "f", "power"), near).alias("b")).select("object_id", "wanted", "b.*")


def unblocked(spectrum: DataFrame, taken: DataFrame, separation: float) -> DataFrame:
    """Samples further than ``separation`` from every taken frequency (object_id, f) of their object."""
    t = taken.groupBy("object_id").agg(F.collect_list("f").alias("_taken"))
    free = F.forall(F.coalesce("_taken", F.array().cast("array<double>")), lambda x: F.abs(x - F.col("f")) > separation)
    return spectrum.join(t, "object_id", "left").where(free).drop("_taken")


def peak_score(spectrum: DataFrame, sense: str = "max") -> DataFrame:
    """``score`` from 0 to 1: power over the best power, or for minimised statistics the way from the worst to the best."""
    g = Window.partitionBy("object_id")
    if sense == "max":
        best = F.max("power").over(g)
        return spectrum.withColumn("score", F.when(best > 0, F.col("power") / F.nullif(best, F.lit(0.0))).otherwise(F.lit(0.0)))
    worst, best = F.max("power").over(g), F.min("power").over(g)
    return spectrum.withColumn("score", F.when(worst > best, (worst - F.col("power")) / F.nullif(worst - best, F.lit(0.0))).otherwise(F.lit(0.0)))


def window_peaks(window_spectrum: DataFrame, n: int = 3, separation: int = 5) -> DataFrame:
    """The ``n`` highest peaks of each spectral window up to 5.5 a day: what an object's own sampling aliases with."""
    return peaks.top_peaks(window_spectrum.where(F.col("f") <= WINDOW_FMAX), n, separation)


def ridge(wavelets: DataFrame) -> DataFrame:
    """(object_id, i, shift, f, power): the best frequency of each time of a wavelet map."""
    s = F.struct(F.round("power", 9).alias("s"), (-F.col("k")).alias("k"))
    return wavelets.groupBy("object_id", "i").agg(F.max_by(F.struct("shift", "f", "power", "amplitude"), s).alias("b")).select("object_id", "i", "b.*")


def ridge_trend(line: DataFrame) -> DataFrame:
    """Straight line through a ridge: n, slope of the frequency, mean, and the relative period change a day."""
    out = line.groupBy("object_id").agg(F.count("*").alias("n"), F.regr_slope("f", "shift").alias("slope"), F.avg("f").alias("mean_f"))
    return out.withColumn("relative_change", -F.col("slope") / F.col("mean_f"))


def wavelet_frequencies(baseline: float, fmax: float, c: float = 0.0125) -> list[float]:
    """Geometric frequencies from 2/T with the ratio that keeps the wavelet's resolution."""
    ratio, f, out = 1.0 + math.sqrt(2.0 * c) / 4.0, 2.0 / baseline, []
    while f <= fmax:
        out.append(f)
        f *= ratio
    return out


def frequency_profile(search: DataFrame) -> DataFrame:
    """Best power of each frequency over all drift rates."""
    return search.groupBy("object_id", "k").agg(F.first("f").alias("f"), F.max("power").alias("power"))


def zero_rate(search: DataFrame, rates: list[float]) -> DataFrame:
    """The spectrum without drift."""
    return search.where(F.col("a_idx") == rates.index(0.0)).drop("a_idx")


def drift_rates(n: int, fcentre: float, baseline: float, samples_per_peak: float = 5.0, harmonics: float = 1.0) -> list[float]:
    """2n + 1 relative rates about zero, a step of 4 / (samples a peak * f T^2 h) apart."""
    step = 4.0 / (samples_per_peak * fcentre * baseline * baseline * harmonics)
    return [k * step for k in range(-n, n + 1)]


def frequency_window(fcentre: float, baseline: float, reach: float = 30.0, samples: float = 10.0) -> tuple[float, float, int]:
    """(f0, df, nf) from ``reach`` Rayleigh widths below a frequency to as many above, positive only."""
    df = 1.0 / (samples * baseline)
    f0 = max(fcentre - reach / baseline, df)
    return f0, df, int(math.floor((fcentre + reach / baseline - f0) / df + 1e-9)) + 1


def model_quality(fits: DataFrame, with_errors: bool) -> DataFrame:
    """reduced_chi2, bic and aic of fits (n, parameters, rss): chi2 plus penalty with errors, n ln(rss / n) plus penalty without."""
    base = F.col("rss") if with_errors else F.col("n") * F.log(F.greatest(F.col("rss"), F.lit(1e-300)) / F.col("n"))
    m = F.col("parameters")
    return fits.withColumn("reduced_chi2", F.when(F.col("n") > m, F.col("rss") / F.nullif(F.col("n") - m, F.lit(0)))).withColumn("bic", base + m * F.log("n")).withColumn("aic", base + 2 * m)


def independent(components: DataFrame, tolerance: float) -> DataFrame:
    """Components that are no combination of stronger ones."""
    return components.join(peaks.combinations(components, tolerance).select("object_id", "rank"), ["object_id", "rank"], "left_anti")


def amplitude_ratio(fitted: Column, spectrum: Column) -> Column:
    return F.when(spectrum > 0, fitted / F.nullif(spectrum, F.lit(0.0)))


def spacing_line(periods: DataFrame) -> DataFrame:
    """object_id, n, a and b: the spacing of consecutive periods as a + b P."""
    w = Window.partitionBy("object_id").orderBy("period")
    s = periods.withColumn("spacing", F.lead("period").over(w) - F.col("period")).where("spacing is not null")
    return s.groupBy("object_id").agg(F.count("*").alias("n"), F.regr_intercept("spacing", "period").alias("a"), F.regr_slope("spacing", "period").alias("b")).where("b is not null")


def predicted_spacing(line: DataFrame, period: Column) -> Column:
    return line["a"] + line["b"] * period


def mass_function(amplitude: Column, outer_period: Column) -> Column:
    """Solar masses, from the light-time semi-amplitude (days) and the outer period (days)."""
    au, years = amplitude * AU_PER_LIGHT_DAY, outer_period / DAYS_PER_YEAR
    return au * au * au / (years * years)


def minimum_third_mass(f: Column, inner: Column, steps: int = 80) -> Column:
    """The mass m with m^3 / (inner + m)^2 = f, by bisection between 0 and a bound; 0 for f = 0."""
    bound = 2 * (f + F.pow(f * inner * inner, F.lit(1.0 / 3.0))) + inner
    value = lambda m: m * m * m / ((inner + m) * (inner + m))

    def halve(acc: Column, _: Column) -> Column:
        mid = (acc["lo"] + acc["hi"]) / 2
        low = value(mid) < f
        return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.array_repeat(F.lit(0), steps), F.struct((f * 0.0).alias("lo"), bound.alias("hi")), halve, lambda acc: F.when(f == 0, F.lit(0.0)).otherwise((acc["lo"] + acc["hi"]) / 2))


def total_change(profile: DataFrame) -> DataFrame:
    """Last over first period of each object's profile, less 1."""
    ends = profile.groupBy("object_id").agg(F.min_by("period", "mid").alias("first"), F.max_by("period", "mid").alias("last"), F.count("*").alias("n"))
    return ends.withColumn("change", F.col("last") / F.col("first") - 1)


def timescale_years(period: Column, rate: Column) -> Column:
    """P over |dP/dt| in years; infinite without a rate."""
    return F.when(rate != 0, period / F.abs(F.nullif(rate, F.lit(0.0))) / DAYS_PER_YEAR).otherwise(F.lit(float("inf")))


def measured_window_peaks(obs: DataFrame, n: int = 3, fmax: float = WINDOW_FMAX, samples: float = 10.0) -> DataFrame:
    """object_id, rank, f, amplitude and ratio (to the highest): the ``n`` highest peaks of each object's own spectral window, ``samples`` trials a width up to ``fmax``.

    Peaks below two widths 1/T belong to the one at zero and are left out; others lie two widths apart. Objects whose band lies inside that peak have none.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, _, dy = kernels._points(pdf.assign(y=0.0))
        rows, span = [], t[-1] - t[0] if len(t) > 1 else 0.0
        if span > 0 and fmax > 2 / span:
            f = kernels.frequency_grid(span, fmax, samples)
            a = np.abs(kernels._trig_sums(t - t[0], kernels._weights(dy, len(t))[None, :], f)[0])
            peak = np.r_[False, (a[1:-1] > a[:-2]) & (a[1:-1] >= a[2:]), False] & (f >= 2 / span)
            for i in np.flatnonzero(peak)[np.argsort(-np.round(a[peak], 9), kind="stable")]:
                if len(rows) < n and all(abs(f[i] - r[2]) >= 2 / span for r in rows):
                    rows.append((pdf["object_id"].iloc[0], len(rows) + 1, f[i], a[i]))
        out = pd.DataFrame(rows, columns=["object_id", "rank", "f", "amplitude"]).astype({"object_id": object, "rank": "int64", "f": float, "amplitude": float})
        return out.assign(ratio=out["amplitude"] / out["amplitude"].iloc[0] if len(out) else out["amplitude"])

    return spread.deal_objects(obs.select("object_id", "t", "dy", "rid")).groupBy("object_id").applyInPandas(run, "object_id string, rank long, f double, amplitude double, ratio double")


def alias_report(obs: DataFrame, spectrum: DataFrame, n_window: int = 3, orders: tuple[int, ...] = (1, 2), harmonics: tuple[int, ...] = (2, 3), reach: float = 3.0, sense: str = "max") -> DataFrame:
    """What each object's best peak may be mistaken for, by the object's own sampling: object_id, kind, predicted, f_peak, power and relative power of the nearest optimum within ``reach`` / T.

    Candidates are the best frequency plus and minus ``orders`` of the measured window peaks (kind "window RANK +m"), and its harmonics and fractions. ``spectrum`` has baseline. Candidates at or below zero, or past the grid, match nothing.
    """
    best = peaks.best_peak(spectrum, sense).select("object_id", F.col("f").alias("f0"), F.col("power").alias("p0"))
    own = measured_window_peaks(obs, n_window).select("object_id", "rank", F.col("f").alias("fw"))
    signs = F.array(*[F.struct(F.lit(s * m).alias("m"), F.lit(f"{'+' if s > 0 else '-'}{m}").alias("name")) for m in orders for s in (1, -1)])
    shifted = best.join(own, "object_id").withColumn("s", F.explode(signs)).select("object_id", "f0", F.concat(F.lit("window "), "rank", F.lit(" "), "s.name").alias("kind"), F.abs(F.col("f0") + F.col("s.m") * F.col("fw")).alias("predicted"))
    multiples = [F.struct(F.lit(f"harmonic {h}").alias("kind"), (F.col("f0") * h).alias("predicted")) for h in harmonics] + [F.struct(F.lit(f"subharmonic {h}").alias("kind"), (F.col("f0") / h).alias("predicted")) for h in harmonics]
    related = best.select("object_id", "f0", F.explode(F.array(*multiples)).alias("c")).select("object_id", "f0", "c.*")
    found = peaks.match_aliases(spectrum, shifted.unionByName(related).where("predicted > 0"), reach, sense)
    return found.join(best, "object_id").select("object_id", "kind", "predicted", "f_peak", "power", (F.col("power") / F.nullif(F.col("p0"), F.lit(0.0))).alias("relative"))
