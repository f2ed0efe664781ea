"""Benchmark decontamination with a positional inverted index [DataFrame functions only].

The index holds one posting (term, document row, position) for every training
token that some benchmark window uses. It is sharded by document and stored in
the shared folder, where a column scan with a term filter is cheap. A window is
looked up from its rarest terms: the postings of the rarest, less its offset,
give possible starts; the postings of the next rarest, less theirs, must agree.
What is left is compared word by word with the text, so hits are exact.
``proximity_matches`` relaxes the agreement of the lists by a slop.

Postings are never gathered per term, so a word or passage that a third of all
documents share stays spread out. The starts found are joined by document, as
their number grows with the corpus.

Defined results: a null or empty text has no words and no hits; an item without
words has no window; repeated items and repeated documents are each reported;
an empty table on either side gives no hits; further columns are ignored, or
pass through ``clean_documents`` untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, content_key, cut

#: Everything that is no word character after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 10
#: Largest table of benchmark windows or terms that is sent to every executor.
BROADCAST_ROWS = 200_000
#: Parts that the windows of one term are dealt to.
SALT = 16


def words(text: str) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), GAP), "")


def benchmark_windows(items: DataFrame, text: str = "text", size: int = SIZE) -> DataFrame:
    """(item_id, phrase, n): every window of ``size`` words, or the whole of a shorter item."""
    w = items.select("item_id", words(text).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = w.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("p"))
    return each.select("item_id", F.array_join("p", " ").alias("phrase"), F.size("p").alias("n")).distinct()


def window_terms(phrases: DataFrame) -> DataFrame:
    """(phrase, n, off, term) of distinct phrases; term is a 64-bit hash, as every hit is compared in full."""
    p = phrases.select("phrase", "n").distinct()
    return p.select("phrase", "n", F.posexplode(F.split("phrase", " ")).alias("off", "word")).withColumn("term", F.xxhash64("word"))


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with row keys that depend on doc_id and text alone: _row for postings, which are checked in full, and _row2 beside it."""
    k1, k2 = content_key("doc_id", text)
    return docs.withColumn("_row", k1).withColumn("_row2", k2)


def build_index(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """The stored postings (term, _row, pos) of all tokens of ``keyed`` documents that occur in ``terms``."""
    vocabulary = cut(terms.select("word", "term").distinct())
    tokens = docs.select("_row", F.posexplode(words(text)).alias("pos", "token"))
    found = tokens.join(_maybe_broadcast(vocabulary, vocabulary.count()), F.col("token") == F.col("word"))
    return cut(found.select("term", "_row", "pos"))


def rarest_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``terms`` with their corpus frequency and rank in the phrase, rarest first; only phrases whose terms all occur."""
    frequency = index.groupBy("term").agg(F.count("*").alias("freq"))
    parts = F.sequence(F.lit(0), F.lit(SALT - 1))
    dealt = frequency.select("term", "freq", F.explode(parts).alias("_salt"))
    rated = terms.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)).cast("int")).join(dealt, ["term", "_salt"], "left").drop("_salt")
    by = Window.partitionBy("phrase")
    rated = rated.withColumn("known", F.count("freq").over(by)).where(F.col("known") == F.col("n"))
    return rated.withColumn("rank", F.row_number().over(by.orderBy("freq", "off"))).drop("known")


def phrase_starts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(_row, phrase, n, start) where the lists of a phrase's two rarest terms agree."""
    ranked = cut(rarest_terms(index, terms).where(F.col("rank") <= 2))
    rows = ranked.count()
    first = ranked.where("rank = 1").select("term", "phrase", "n", F.col("off").alias("off1"))
    second = ranked.where("rank = 2").select(F.col("phrase").alias("_p"), F.col("term").alias("term2"), F.col("off").alias("off2"))
    starts = index.join(_maybe_broadcast(first, rows), "term").select("_row", "phrase", "n", (F.col("pos") - F.col("off1")).alias("start")).where("start >= 0")
    starts = starts.join(_maybe_broadcast(second, rows), F.col("phrase") == F.col("_p"), "left").drop("_p")
    wanted = ranked.where("rank = 2").select(F.col("term").alias("_t")).distinct()
    others = index.join(_maybe_broadcast(wanted, rows), F.col("term") == F.col("_t")).select(F.col("term").alias("term2"), F.col("_row").alias("_row2"), F.col("pos").alias("pos2"))
    alone = starts.where(F.col("term2").isNull()).select("_row", "phrase", "n", "start")
    both = starts.join(others, (starts["term2"] == others["term2"]) & (F.col("_row") == F.col("_row2")) & (F.col("pos2") == F.col("start") + F.col("off2")), "left_semi")
    return both.select("_row", "phrase", "n", "start").unionByName(alone)


def proximity_matches(docs: DataFrame, phrases: DataFrame, slop: int, text: str = "text") -> DataFrame:
    """(doc_id, phrase, start) where every term of a phrase lies within ``slop`` words of its place.

    ``phrases`` has columns phrase (words joined by spaces) and n. With slop 0 this is the exact phrase.
    """
    k = keyed(docs, text)
    terms = cut(window_terms(phrases))
    index = build_index(k, terms, text)
    ranked = rarest_terms(index, terms)
    starts = index.join(ranked.where("rank = 1").select("term", "phrase", "n", "off"), "term").select("_row", "phrase", "n", (F.col("pos") - F.col("off")).alias("start"))
    need = starts.join(terms.select("phrase", "off", "term"), "phrase")
    near = need.join(index.withColumnsRenamed({"_row": "_r", "pos": "p", "term": "t"}), (F.col("_row") == F.col("_r")) & (F.col("term") == F.col("t")) & (F.abs(F.col("p") - F.col("off") - F.col("start")) <= slop))
    full = near.groupBy("_row", "phrase", "n", "start").agg(F.countDistinct("off").alias("found")).where(F.col("found") == F.col("n"))
    return k.select("doc_id", "_row").join(full, "_row").select("doc_id", "phrase", "start")


def _covered(hits: Column) -> Column:
    """Words under the union of sorted (start, n) intervals."""
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end"))

    def step(acc: Column, x: Column) -> Column:
        end = x["start"] + x["n"]
        return F.struct((acc["sum"] + F.greatest(F.lit(0), end - F.greatest(x["start"], acc["end"]))).alias("sum"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(hits, zero, step, lambda acc: acc["sum"])


def with_hits(docs: DataFrame, items: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column (n_words, n_hit, phrases: the distinct windows that occur), and its name, which no other column has."""
    terms = cut(window_terms(benchmark_windows(items)))
    k = keyed(docs.select("doc_id", text), text)
    starts = phrase_starts(build_index(k, terms, text), terms)
    name = f"_hits_{uuid.uuid4().hex}"
    row = f"{name}_row"
    per_doc = cut(starts.groupBy(F.col("_row").alias(row)).agg(F.collect_set(F.struct("start", "n", "phrase")).alias(name)))
    joined = docs.withColumn(row, content_key("doc_id", text)[0]).hint("merge").join(per_doc, row, "left").drop(row)
    joined = joined.withColumn(f"{name}_w", words(text))
    same = lambda x: F.array_join(F.slice(F.col(f"{name}_w"), x["start"] + 1, x["n"]), " ") == x["phrase"]
    joined = joined.withColumn(name, F.when(F.col(name).isNotNull(), F.sort_array(F.filter(name, same))))
    found = F.struct(
        F.size(f"{name}_w").cast("long").alias("n_words"),
        F.coalesce(_covered(F.col(name)), F.lit(0)).cast("long").alias("n_hit"),
        F.array_distinct(F.transform(name, lambda x: x["phrase"])).alias("phrases"),
    )
    return joined.withColumn(name, found).drop(f"{name}_w"), name


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    hit, name = with_hits(docs.select("doc_id", "text"), items)
    found = cut(keyed(hit).select("_row", "_row2", "doc_id", f"{name}.*"))
    owners = benchmark_windows(items).select("phrase", "item_id")
    hits = found.select("_row", "_row2", F.explode("phrases").alias("phrase")).distinct().join(owners, "phrase")
    named = hits.groupBy("_row", "_row2").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    named = named.select("_row", "_row2", F.size("ids").cast("long").alias("n"), F.array_join(F.sort_array("ids"), ",").alias("list"))
    out = found.join(named, ["_row", "_row2"], "left")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.coalesce("n", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("list", F.lit("")), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, all columns kept."""
    hit, name = with_hits(docs, items)
    return hit.where(F.col(f"{name}.n_hit") == 0).select(*docs.columns)
