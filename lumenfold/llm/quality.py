"""Quality rules with adaptive thresholds [DataFrame functions only].

Every text is reduced to a few counts inside its own row. Their ratios go into
mergeable relative-error quantile sketches (DDSketch: counts of logarithmic
buckets; merging is adding) per language and source. Each group's sketch is
merged with its language's, weighing ``PRIOR_ROWS`` rows, and that likewise with
the whole corpus's, so a group of few rows follows its parent and one of many
itself. A cutoff lies ``SPREAD`` times as far beyond the ``TAIL`` quantile as
that is from the median: no ratio has a fixed limit or margin. A text fails
where its count exceeds the cutoff by more than ``SIGMA`` standard deviations
of a count of its size, so that short texts are not judged by chance. Bucket
counts are partially aggregated before the shuffle, so a hot source costs no
more than a small one.

Defined results: a null or blank text has no words, fails the base rule and is
not kept; null language or source form a group of their own; repeated rows
count and are judged one by one; an empty table gives an empty result; columns
of the input that are not named here pass through ``filter_documents``
untouched and are ignored elsewhere, and clash with nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, cut

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
GAMMA = 1.02
#: Upper and lower tail of a group that its cutoffs are extrapolated from, and how far.
TAIL = 0.8
SPREAD = 5.0
#: Rows that the parent's sketch weighs in a group's.
PRIOR_ROWS = 200
#: Standard deviations by which a count must exceed a cutoff.
SIGMA = 3.0
#: Per metric: the count, what it is a share of, and how many come at a time (a repeat covers two windows at least).
METRICS = {
    "word_length": ("word_chars", "n_words", 1),
    "symbols": ("n_symbols", "n_words", 1),
    "dup_lines": ("n_dup_lines", "n_lines", 1),
    "repeats": ("n_repeat_words", "n_words", 2 * WINDOW),
    "capitals": ("n_upper", "word_chars", 1),
}
#: Metrics whose lower tail is judged as well.
TWO_SIDED = ("word_length",)
#: Largest table of groups that is sent to every executor; a larger one is joined in SALT parts.
BROADCAST_GROUPS = 100_000
SALT = 16


def base_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines, n_upper.

    Repeated windows are compared by 64-bit hashes within one text. Only texts
    that hold a repeat sort their windows, so the common case is linear.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(*keep, t.alias("_t")).withColumn("_w", F.array_remove(F.split("_t", SPACE), ""))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_wh", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_w")
    at = lambda a, i: F.get(F.col(a), i)
    # the hash of eight words is built from those of two and four: three linear passes
    pairs = lambda a, k: F.zip_with(F.slice(a, 1, F.size(a) - k), F.slice(a, k + 1, F.size(a)), lambda x, y: F.xxhash64(x, y))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("_h2", F.when(n >= WINDOW, pairs("_wh", 1)).otherwise(none))
    df = df.withColumn("_h4", F.when(n >= WINDOW, pairs("_h2", 2)).otherwise(none))
    df = df.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.when(n >= WINDOW, pairs("_h4", 4)).otherwise(none).alias("_h"),
    )
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(repeated, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    twin = lambda x, i: F.coalesce(at("_s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(at("_s", i + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", twin), lambda x: x["p"])))
    own = F.transform("_p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(at("_p", i + 1) - p, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return df.drop("_h", "_s", "_p").withColumn("base_failed", failed)


def metrics() -> dict[str, Column]:
    """The judged ratios of a row of ``base_counts``."""
    return {k: F.col(count) / F.greatest(F.col(size), F.lit(1)).cast("double") for k, (count, size, _) in METRICS.items()}


def bucket(value: Column) -> Column:
    """Sketch bucket of a value from 0: 0 for values under 0.001, then powers of GAMMA."""
    scaled = F.greatest(value * 1000.0, F.lit(1.0))
    return F.when(value < 0.001, F.lit(0)).otherwise(F.ceil(F.log(scaled) / F.log(F.lit(GAMMA))) + 1).cast("int")


def bucket_value(b: Column) -> Column:
    """The value that stands for a bucket: within 1 % of all its members."""
    return F.when(b <= 0, F.lit(0.0)).otherwise(2.0 * F.pow(F.lit(GAMMA), (b - 1).cast("double")) / (GAMMA + 1.0) / 1000.0)


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) over rows that pass the base rule."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in metrics().items()])
    rows = counts.where(~F.col("base_failed")).select("lang", "source", F.explode(each).alias("m"))
    return rows.groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, parent: DataFrame | None, *group: str) -> DataFrame:
    """The sketch of each group and metric with ``PRIOR_ROWS`` rows of its parent's: n (fractional), and the share p of each bucket."""
    own = sketch.groupBy(*group, "metric", "bucket").agg(F.sum("n").cast("double").alias("n"))
    if parent is not None:
        names, shared = own.select(*group, "metric").distinct(), [g for g in group if g in parent.columns]
        on = F.col("metric") == F.col("_m")
        for g in shared:
            on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
        prior = names.join(parent.select(F.col("metric").alias("_m"), *[F.col(g).alias(f"_{g}") for g in shared], "bucket", (F.col("p") * PRIOR_ROWS).alias("n")), on)
        own = own.unionByName(prior.select(*group, "metric", "bucket", "n")).groupBy(*group, "metric", "bucket").agg(F.sum("n").alias("n"))
    return own.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*group, "metric")))


def cutoffs(sketch: DataFrame, *group: str) -> DataFrame:
    """lo and hi of each group and metric of a ``merged`` sketch."""
    key = [*group, "metric"]
    run = sketch.withColumn("upto", F.sum("p").over(Window.partitionBy(*key).orderBy("bucket")))
    at = lambda q: bucket_value(F.min(F.when(F.col("upto") >= q - 1e-9, F.col("bucket"))))
    q = run.groupBy(*key).agg(at(1 - TAIL).alias("low"), at(0.5).alias("mid"), at(TAIL).alias("high"))
    return q.select(*key, (F.col("low") - SPREAD * (F.col("mid") - F.col("low"))).alias("lo"), (F.col("high") + SPREAD * (F.col("high") - F.col("mid"))).alias("hi"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per (lang, source): lo_ and hi_ of each metric."""
    langs = merged(sketch, merged(sketch, None), "lang")
    df = cutoffs(merged(sketch, langs, "lang", "source"), "lang", "source")
    pivot = [F.max(F.when(F.col("metric") == k, F.col(side))).alias(f"{side}_{k}") for k in METRICS for side in ("lo", "hi")]
    return df.groupBy("lang", "source").agg(*pivot)


def fits() -> Column:
    """Whether a row of ``base_counts`` with its group's ``thresholds`` keeps to all of them."""
    chance = lambda count, unit: SIGMA * F.sqrt(F.col(count) * float(unit))
    high = [F.col(count) - chance(count, unit) <= F.col(f"hi_{k}") * F.col(size) for k, (count, size, unit) in METRICS.items()]
    low = [F.col(METRICS[k][0]) + chance(METRICS[k][0], METRICS[k][2]) >= F.col(f"lo_{k}") * F.col(METRICS[k][1]) for k in TWO_SIDED]
    return reduce(lambda a, b: a & b, [*high, *low])


def verdicts(counts: DataFrame) -> DataFrame:
    """``base_counts`` rows plus ``kept``. ``counts`` is read twice: give a stored table.

    A row is kept if the base rule holds and every ratio lies within its group's cutoffs.
    """
    limits = cut(thresholds(sketches(counts)))
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    on = counts["lang"].eqNullSafe(limits["_lang"]) & counts["source"].eqNullSafe(limits["_source"])
    if limits.count() <= BROADCAST_GROUPS:
        joined = counts.join(F.broadcast(limits), on, "left")
    else:
        dealt = limits.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = counts.withColumn("_salt", (F.rand(SALT) * SALT).cast("int")).join(dealt, on & (F.col("_salt") == F.col("_part")), "left")
    kept = ~F.col("base_failed") & F.coalesce(fits(), F.lit(True))
    return joined.select(*[counts[c] for c in counts.columns], kept.alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    return verdicts(cut(base_counts(docs)))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Rows are stored with their counts, so that the texts are read once and do not
    move: each row's verdict needs its counts and the table of cutoffs only.
    """
    row = f"_row_{uuid.uuid4().hex}"
    whole = docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias(row), "text", "lang", "source")
    judged = verdicts(cut(base_counts(whole, keep=(row, "lang", "source"))))
    return judged.where("kept").select(*[F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(docs.columns)])
