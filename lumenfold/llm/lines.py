"""Line dedup by a segment-partition edit join [DataFrame functions only].

Lines are trimmed of ASCII white space; blank ones are left alone. A line goes
if an equal line, or one within ``EDITS`` edit, stands earlier in the corpus
(by doc_id, then line number). Near matches need ``MIN_CHARS`` characters, so
that short lines only ever match exactly.

Distinct lines are split into threshold-plus-one segments. A pair within the
threshold agrees in a whole segment, so each line enters an index under (length,
segment, content) and probes it under its own and the next shorter length, with
the last segment aligned from the end. Candidates are verified by a banded
bit-parallel automaton. A bucket with more than ``MAX_BUCKET`` lines is not
paired up: within it, lines are keyed by all but one of some parts, one of which
must hold the edit, first of few parts, then of many; what is still crowded is
keyed by all but one character. Lines of one length that share such a key are
true neighbours, so one link to the earliest says all; a line one longer is
looked up by what it is without each of its characters. So no group is ever
paired up whole, and what a line costs is bounded by its own length, in time by
its square: such keys are hashes made one by one, never stored strings.

Defined results: a null or empty text has no lines; of rows with equal doc_id
and text one counts as the first and the others lose all lines; rows without a
doc_id come first; an empty table gives an empty result; further columns pass
through ``remove_repeated_lines`` and are ignored elsewhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import content_key, cut

#: Edits that segments, parts and probes are laid out for; ``within_edits`` takes any number.
EDITS = 1
MIN_CHARS = 24
#: Largest bucket whose lines are compared in pairs; parts of the lines of larger ones, level by level.
MAX_BUCKET = 16
PARTS = (8, 64)

BLANKS = " \t\r\x0b\x0c"
_ID = ["h1", "h2"]
_ROW = ["_k1", "_k2"]


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    k1, k2 = content_key("doc_id", text)
    return docs.withColumn("_k1", k1).withColumn("_k2", k2)


def occurrences(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_k1, _k2, doc_id, no, line, h1, h2, n) of the lines that hold a word; h1 and h2 identify the trimmed line."""
    each = docs.select(*_ROW, "doc_id", F.posexplode(F.split(F.col(text), "\n")).alias("no", "raw"))
    each = each.select(*_ROW, "doc_id", "no", F.trim("raw", F.lit(BLANKS)).alias("line")).where("line != ''")
    return each.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line")).withColumn("n", F.length("line"))


def segment_keys(line: Column, n: Column) -> tuple[list[Column], list[Column]]:
    """Index keys of a line, and those it probes among lines one character shorter."""
    half = lambda m: F.floor(m / 2).cast("int")
    m = n - 1
    own = [F.xxhash64(n, F.lit(0), F.substr(line, F.lit(1), half(n))), F.xxhash64(n, F.lit(1), F.substr(line, half(n) + 1))]
    short = [F.xxhash64(m, F.lit(0), F.substr(line, F.lit(1), half(m))), F.xxhash64(m, F.lit(1), F.substr(line, n - (m - half(m)) + 1))]
    return own, short


def _role(keys: DataFrame, *columns: str) -> DataFrame:
    """One row per key of the lists ``own`` (index) and ``short`` (probes of lines one shorter)."""
    each = F.array(F.struct(F.lit(1).alias("own"), F.col("own").alias("keys")), F.struct(F.lit(0).alias("own"), F.col("short").alias("keys")))
    return keys.select(*columns, F.explode(each).alias("k")).select(*columns, F.col("k.own").alias("own"), F.explode("k.keys").alias("key"))


def _shared(keys: DataFrame) -> DataFrame:
    """``keys`` that an index line and another line have, with the bucket's size c; stored."""
    sizes = keys.groupBy("key").agg(F.sum("own").alias("n_own"), F.count("*").alias("c")).where("n_own > 0 and c > 1")
    return cut(keys.hint("merge").join(sizes.select("key", "c"), "key"))


def _pairs(met: DataFrame) -> DataFrame:
    """Different lines (h1, h2, g1, g2) that meet in a small bucket: index lines with each other, and with longer ones."""
    small = met.where(F.col("c") <= MAX_BUCKET)
    left = small.where("own = 1").select("key", *_ID)
    right = small.select("key", F.col("own").alias("_own"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    differ = F.when(F.col("_own") == 1, F.struct(*_ID) < F.struct("g1", "g2")).otherwise((F.col("h1") != F.col("g1")) | (F.col("h2") != F.col("g2")))
    return left.join(right, "key").where(differ).select(*_ID, "g1", "g2")


def _part_keys(crowd: DataFrame, parts: int) -> DataFrame:
    """Keys within its bucket of all but one of the parts of a line, laid out for its length as an index line, for one less as a probe."""
    m = F.length("line") - (1 - F.col("own"))
    shift = 1 - F.col("own")
    at = lambda j: F.floor(m * j / parts).cast("int")
    key = lambda j: F.xxhash64("key", j, F.substr("line", F.lit(1), at(j)), F.substr("line", at(j + 1) + 1 + shift))
    each = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), key)
    return crowd.select(*_ID, "own", F.explode(F.array_distinct(each)).alias("key"))


def _neighbours(crowd: DataFrame) -> DataFrame:
    """(h1, h2, g1, g2) of lines that are still crowded: by all but one character among index lines, by whole lines for probes."""
    places = F.sequence(F.lit(1), F.length("line"))
    without = lambda i: (F.substr("line", F.lit(1), i - 1), F.substr("line", i + 1))
    place = crowd.where("own = 1").select(*_ID, "first", F.explode(F.transform(places, lambda i: F.struct(F.xxhash64("key", i, *without(i)).alias("k1"), F.xxhash64(F.lit(1), i, *without(i)).alias("k2")))).alias("k"))
    place = place.select(*_ID, "first", "k.k1", "k.k2")
    head = place.groupBy("k1", "k2").agg(F.min(F.struct("first", *_ID)).alias("head"), F.count("*").alias("c")).where("c > 1").select("k1", "k2", F.col("head.h1").alias("g1"), F.col("head.h2").alias("g2"))
    links = place.join(head, ["k1", "k2"]).where((F.col("h1") != F.col("g1")) | (F.col("h2") != F.col("g2"))).select(*_ID, "g1", "g2")
    rest = lambda i: F.concat(*without(i))
    whole = crowd.where("own = 0").select(*_ID, F.explode(F.transform(places, lambda i: F.struct(F.xxhash64(rest(i)).alias("g1"), F.xxhash64(F.lit(1), rest(i)).alias("g2")))).alias("v")).select(*_ID, "v.*")
    index = crowd.where("own = 1").select(F.col("h1").alias("g1"), F.col("h2").alias("g2")).distinct()
    return links.unionByName(whole.join(index, ["g1", "g2"], "left_semi"))


def within_edits(a: Column, b: Column, k: int = EDITS) -> Column:
    """Whether two strings are within ``k`` edits: a bit per diagonal of the band, a word per number of errors.

    ``r_d`` has bit i set if the first j + i - k characters of ``a`` match the
    first j of ``b`` with d errors or fewer.
    """
    band = (1 << (2 * k + 1)) - 1
    start = [sum(1 << (k + e) for e in range(d + 1)) for d in range(k + 1)]
    zero = F.struct(*[F.lit(v).alias(f"r{d}") for d, v in enumerate(start)])

    def run(pair: Column) -> Column:
        def step(acc: Column, j: Column) -> Column:
            same = None
            for i in range(2 * k + 1):
                bit = F.when(F.coalesce(F.get(pair["x"], j + i - k) == F.get(pair["y"], j), F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0))
                same = bit if same is None else same.bitwiseOR(bit)
            rows = [acc["r0"].bitwiseAND(same)]
            for d in range(1, k + 1):
                before = acc[f"r{d - 1}"]
                r = acc[f"r{d}"].bitwiseAND(same).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(rows[-1], 1))
                rows.append(r.bitwiseAND(F.lit(band)))
            return F.struct(*[r.alias(f"r{d}") for d, r in enumerate(rows)])

        return F.aggregate(F.sequence(F.lit(0), F.size(pair["y"]) - 1), zero, step, lambda acc: acc[f"r{k}"])

    # as a lambda variable the characters are split once per pair, not once per step
    pair = F.array(F.struct(F.split(a, "").alias("x"), F.split(b, "").alias("y")))
    gap = F.length(a) - F.length(b)
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(2 * k + 1)]), F.least(F.greatest(gap + k + 1, F.lit(1)), F.lit(2 * k + 1)))
    hit = F.get(F.transform(pair, run), F.lit(0)).bitwiseAND(bit) != 0
    return F.when(F.abs(gap) > k, F.lit(False)).when(F.length(b) == 0, F.length(a) <= k).otherwise(hit)


def candidates(docs: DataFrame, distinct: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs to be verified, links that need none, and the text of each line that meets another.

    ``docs`` is ``keyed``; ``distinct`` has h1, h2, first (a position struct) and keys (own and short lists) of each long line.
    """
    met = _shared(_role(distinct, *_ID))
    wanted = met.select(*_ID).distinct()
    # one row a line and task moves, however often a line is there
    text = occurrences(docs).where(F.col("n") >= MIN_CHARS).groupBy(*_ID).agg(F.first("line").alias("line"))
    lines = cut(text.hint("merge").join(wanted, _ID).hint("merge").join(distinct.select(*_ID, "first"), _ID))
    pairs = _pairs(met)
    crowded = lambda met: met.where(F.col("c") > MAX_BUCKET).select("key", "own", *_ID).join(lines, _ID)
    crowd = crowded(met)
    for parts in PARTS:
        met = _shared(_part_keys(crowd, parts))
        pairs = pairs.unionByName(_pairs(met))
        crowd = crowded(met)
    return pairs.distinct(), _neighbours(crowd), lines


def near_links(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2, g1, g2): links between different lines; in crowded buckets one link to the earliest line for all."""
    pairs, links, lines = candidates(docs, distinct)
    other = lines.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("other"))
    checked = pairs.join(lines.select(*_ID, "line"), _ID).join(other, ["g1", "g2"]).where(within_edits(F.col("line"), F.col("other")))
    return checked.select(*_ID, "g1", "g2").unionByName(links).distinct()


def distinct_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored (h1, h2, at) of every line of ``keyed`` documents, and (h1, h2, first, times, own, short) of every distinct one."""
    own, short = segment_keys(F.col("line"), F.col("n"))
    long = F.col("n") >= MIN_CHARS
    at = F.struct("doc_id", *_ROW, "no")
    seen = cut(occurrences(docs).select(*_ID, at.alias("at"), F.when(long, F.array(*own)).alias("own"), F.when(long, F.array(*short)).alias("short")))
    return seen, cut(seen.groupBy(*_ID).agg(F.min("at").alias("first"), F.count("*").alias("times"), F.first("own").alias("own"), F.first("short").alias("short")))


def removals(docs: DataFrame) -> DataFrame:
    """(_k1, _k2, exact, near, copies) of ``keyed`` documents: the numbers of the lines that go, by reason, and how often the row is there; stored.

    Only documents with a line that goes are listed.
    """
    seen, lines = distinct_lines(docs)
    links = cut(near_links(docs, lines.where(F.col("own").isNotNull()).select(*_ID, "first", "own", "short")))
    both = links.unionByName(links.select(F.col("g1").alias("h1"), F.col("g2").alias("h2"), F.col("h1").alias("g1"), F.col("h2").alias("g2")))
    firsts = lines.select(*_ID, "first")
    ends = firsts.hint("merge").join(both.select(F.col("g1").alias("h1"), F.col("g2").alias("h2")).distinct(), _ID).select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first").alias("other"))
    earliest = both.join(ends, ["g1", "g2"]).groupBy(*_ID).agg(F.min("other").alias("other"))
    near = firsts.hint("merge").join(earliest, _ID).where(F.col("other") < F.col("first")).select(F.col("first").alias("at"), F.lit(True).alias("near"))
    repeated = lines.where("times > 1").select(*_ID, "first")
    # of a row that is there several times each line stands at one place as often, its first one included
    again = seen.select(*_ID, "at").hint("merge").join(repeated, _ID).select("at", (F.col("at") == F.col("first")).alias("is_first"))
    again = again.groupBy("at", "is_first").agg(F.count("*").alias("copies")).where("not is_first or copies > 1")
    gone = again.select("at", F.lit(False).alias("near"), (~F.col("is_first")).alias("goes"), "copies")
    gone = gone.unionByName(near.select("at", "near", F.lit(True).alias("goes"), F.lit(1).cast("long").alias("copies"))).select("at.*", "near", "goes", "copies")
    pick = lambda c: F.collect_set(F.when(c & F.col("goes"), F.col("no")))
    return cut(gone.groupBy(*_ROW).agg(pick(~F.col("near")).alias("exact"), pick(F.col("near")).alias("near"), F.max("copies").alias("copies")))


def _with_removals(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a struct column of the numbers of the lines that go, and that column's name (no other has it).

    Texts and lists are joined the same way at every size.
    """
    gone = removals(keyed(docs.select("doc_id", "text")))
    several = bool(gone.where("copies > 1").limit(1).count())
    name = f"_gone_{uuid.uuid4().hex}"
    keys = [f"{name}_1", f"{name}_2"]
    gone = gone.select(F.col("_k1").alias(keys[0]), F.col("_k2").alias(keys[1]), F.struct("exact", "near", "copies").alias(name))
    k1, k2 = content_key("doc_id", "text")
    joined = docs.withColumn(keys[0], k1).withColumn(keys[1], k2).hint("merge").join(gone, keys, "left")
    if several:  # all but one of equal rows have no line of their own
        whole = joined.where(F.coalesce(F.col(f"{name}.copies"), F.lit(1)) == 1)
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
        twins = joined.where(F.col(f"{name}.copies") > 1).withColumn(f"{name}_no", number)
        lines_ = F.split("text", "\n")
        every = F.filter(F.transform(lines_, lambda x, i: F.when(F.trim(x, F.lit(BLANKS)) != "", i)), lambda i: i.isNotNull())
        none = F.array().cast("array<int>")
        own = F.when(F.col(f"{name}_no") == 1, F.col(name)).otherwise(F.struct(every.alias("exact"), none.alias("near"), F.lit(1).cast("long").alias("copies")))
        joined = whole.unionByName(twins.withColumn(name, own).drop(f"{name}_no"))
    return joined.drop(*keys), name


def _kept(gone: str) -> Column:
    """The text without the lines that go; untouched if none does."""
    stay = F.filter(F.split(F.col("text"), "\n"), lambda _, i: ~(F.array_contains(F.col(f"{gone}.exact"), i) | F.array_contains(F.col(f"{gone}.near"), i)))
    return F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with a word), n_exact, n_near (lines that go as equal to, or near, an earlier one) and kept_sha256."""
    joined, gone = _with_removals(docs.select("doc_id", "text"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    count = lambda c: F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(f"{gone}.{c}")).cast("long")
    return joined.select(
        "doc_id",
        F.size(words).cast("long").alias("n_lines"),
        count("exact").alias("n_exact"),
        count("near").alias("n_near"),
        F.sha2(F.coalesce(_kept(gone), F.lit("")), 256).alias("kept_sha256"),
    )


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, all other columns as they are."""
    joined, gone = _with_removals(docs)
    return joined.withColumn("text", _kept(gone)).select(*docs.columns)
