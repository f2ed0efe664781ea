"""Near copies by exact Jaccard similarity of five-word shingles.

Texts with the same shingles collapse first. Fingerprints of the shingle sets
then go through the vantage-point tree of ``simhash``: what it links within two
bits is verified on the whole sets, and star contraction joins it. Two bits do
not reach all pairs at the threshold (most similar texts differ in more), so a
second step finds the links between the components that this leaves. There the
sets enter buckets by bands of minimum hashes, and only buckets that hold more
than one component are looked at: a pair at similarity s meets unless all bands differ, which at
0.8 happens to 3 pairs in a million and above it to fewer. Whatever meets is
verified in the same way, so no link is an estimate. In a bucket with
more than ``MAX_BUCKET`` members its most central one, which meets most others
in all its buckets, is held against all: variants of one text are linked to that
text. Members of buckets that still hold more than one component are compared by
a prefix join: of two sets within the threshold, the rarest fifth of each share
a shingle, and what follows the first shared one must be long enough. So no link
is lost there, and variants that are too far from each other never meet.

Defined results: null, empty and blank texts have no shingles and are copies of
each other; a text of fewer than five words is one shingle; repeated rows get
equal results; an empty table gives an empty result; further columns pass
through ``keep_first``.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from .common import content_key, cut
from .components import components
from .simhash import RADIUS, first_rows, majority
from .simhash import _links as fingerprint_links

SHINGLE = 5
SEED = 42
#: Least similarity of near copies, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 5
#: Largest bucket whose members are compared in pairs.
MAX_BUCKET = 16
#: Ratio of neighbouring bins of set sizes.
SIZE_STEP = 1.1
_CHUNK = 1024
_MIX = np.uint64(0xD6E8FEB86659FD93)
_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _random.integers(0, 2**63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of five words, with A-Z in lower case."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if len(words) < SHINGLE:
        parts, n = iter([b" ".join(words)]), min(1, len(words))
    else:
        parts, n = map(b" ".join, zip(*(words[k:] for k in range(SHINGLE)), strict=False)), len(words) - SHINGLE + 1
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype="<u8", count=n))


def bands(found: np.ndarray) -> np.ndarray:
    """Bucket keys of a shingle set."""
    if not len(found):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(found), _CHUNK):
        np.minimum(least, (found[None, at : at + _CHUNK] * _TIMES + _PLUS).min(axis=1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ least[r::ROWS]) * _MIX
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def digest(found: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(found.tobytes())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * shared >= SIMILAR[0] * (len(a) + len(b) - shared)


def _described(texts: pd.Series) -> pd.DataFrame:
    found = [shingles(t) for t in texts]
    fps = np.array([majority(f) for f in found], dtype=np.uint64).view(np.int64)
    return pd.DataFrame({"digest": [digest(f) for f in found], "n": np.array([len(f) for f in found], dtype=np.int32), "fp": fps, "keys": [bands(f) for f in found]})


def _sets(texts: pd.Series) -> pd.DataFrame:
    found = [shingles(t) for t in texts]
    return pd.DataFrame({"digest": [digest(f) for f in found], "found": [f.view(np.int64) for f in found]})


def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _fits(a: str, b: str):
    """Whether two set sizes allow the similarity at all."""
    return SIMILAR[1] * F.least(a, b) >= SIMILAR[0] * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` whose sets are similar."""
    left = sets.select(F.col("node").alias("u"), F.col("found").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("found").alias("b"))
    return pairs.select("u", "v").distinct().join(left, "u").join(right, "v").where(pandas_udf(_similar, "boolean")("a", "b")).select("u", "v")


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v) of ``nodes`` (node, fp) that the vantage-point tree links within ``RADIUS`` bits: a star for each fingerprint and shard."""
    first = cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(first, "fp").select(F.col("first").alias("u"), F.col("node").alias("v"))
    u, v = (first.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}")) for x in ("u", "v"))
    near = fingerprint_links(first.select("fp"), RADIUS).join(u, "u").join(v, "v").select(F.least("first_u", "first_v").alias("u"), F.greatest("first_u", "first_v").alias("v"))
    return same.unionByName(near).where("u != v")


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with their component."""
    named = members.join(roots, members["node"] == roots["u"], "left").select("key", "node", "n", "c", F.coalesce("root", "node").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return cut(named.join(mixed, "key"))


def _prefix_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of different components that share one of their rarest shingles; holds all similar pairs."""
    nodes = members.select("node", "n", "root").distinct()
    each = cut(nodes.join(sets.select("node", "found"), "node").select("node", "n", "root", F.explode("found").alias("s")))
    common = each.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("c", "s"))
    ranked = each.join(common, "s", "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("rank", rank)
    # two similar sets share ceil(0.8 n) shingles or more, so all but that many, and one more, must meet
    prefix = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1]) + 1).where("c > 1")
    # if s is the first shared shingle, no more is shared than it and what follows: that leaves some sizes to the other set
    whole = SIMILAR[0] + SIMILAR[1]
    most = F.col("n") - F.col("rank") + 1
    low, high = F.ceil(F.col("n") * SIMILAR[0] / SIMILAR[1]), F.floor(most * whole / SIMILAR[0]) - F.col("n")
    size = lambda n: F.floor(F.log(F.greatest(n, F.lit(1)).cast("double")) / F.log(F.lit(SIZE_STEP)))
    rows = prefix.withColumn("low", low).withColumn("high", high).where("high >= low")
    rows = rows.select("s", "node", "n", "root", "rank", size(F.col("n")).alias("own"), F.explode(F.sequence(size(F.col("low")), size(F.col("high")))).alias("partner"))
    # one side is not of the group's largest component
    group = [F.col("s"), F.least("own", "partner").alias("lo"), F.greatest("own", "partner").alias("hi")]
    named = rows.select("*", *group[1:])
    counts = named.groupBy("s", "lo", "hi", "root").agg(F.count("*").alias("c")).groupBy("s", "lo", "hi").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    mixed = cut(named.join(counts.select("s", "lo", "hi", "main"), ["s", "lo", "hi"]))
    a = mixed.where("root != main").select("s", F.col("own").alias("x"), F.col("partner").alias("y"), F.col("node").alias("u"), F.col("n").alias("nu"), F.col("root").alias("ru"), F.col("rank").alias("iu"))
    b = mixed.select("s", F.col("partner").alias("x"), F.col("own").alias("y"), F.col("node").alias("v"), F.col("n").alias("nv"), F.col("root").alias("rv"), F.col("rank").alias("iv"), (F.col("root") == F.col("main")).alias("of_main"))
    shared = 1 + F.least(F.col("nu") - F.col("iu"), F.col("nv") - F.col("iv"))
    enough = whole * shared >= SIMILAR[0] * (F.col("nu") + F.col("nv"))
    met = a.join(b, ["s", "x", "y"]).where((F.col("of_main") | (F.col("u") < F.col("v"))) & (F.col("ru") != F.col("rv")) & _fits("nu", "nv") & enough)
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _links(nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(u, v) links between ``nodes`` (node, doc, digest, n, fp, keys) that connect all similar ones that meet."""
    near = cut(_fingerprint_pairs(nodes))
    each = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    met = cut(each.join(shared, "key"))
    ends = near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node")))
    wanted = met.select("node").unionByName(ends).distinct().join(nodes.select("node", "doc", F.col("digest").alias("_digest")), "node")
    texts = docs.select(F.col("doc_id").alias("doc"), F.col(text).alias("_text")).join(wanted, "doc").select("node", "_digest", pandas_udf(_sets, "digest binary, found array<long>")("_text").alias("s"))
    sets = cut(texts.where("_digest = s.digest").select("node", F.col("s.found").alias("found")).dropDuplicates(["node"]))
    close = cut(_verified(near, sets))
    met = _labelled(met, components(close))
    small = met.where(F.col("c") <= MAX_BUCKET)
    other = small.select("key", F.col("node").alias("v"), F.col("n").alias("nv"), F.col("root").alias("other"))
    pairs = small.join(other, "key").where((F.col("node") < F.col("v")) & (F.col("root") != F.col("other")) & _fits("n", "nv")).select(F.col("node").alias("u"), "v")
    crowd = met.where(F.col("c") > MAX_BUCKET)
    meets = crowd.groupBy("node").agg(F.sum("c").alias("meets"))
    pivots = crowd.join(meets, "node").groupBy("key").agg(F.max_by(F.struct("node", "root"), F.struct("meets", "node")).alias("p")).select("key", F.col("p.node").alias("pivot"), F.col("p.root").alias("main"))
    stars = crowd.join(pivots, "key").where("root != main").select(F.least("pivot", "node").alias("u"), F.greatest("pivot", "node").alias("v"))
    links = close.unionByName(cut(_verified(pairs.unionByName(stars), sets)))
    if not crowd.limit(1).count():
        return links
    crowd = _labelled(crowd.drop("root"), components(links))
    return links.unionByName(_verified(_prefix_pairs(crowd, sets), sets)) if crowd.limit(1).count() else links


def _components(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, _k1, _k2 (content key) and node (one of the component's) of every row."""
    k1, k2 = content_key("doc_id", text)
    marked = cut(docs.select("doc_id", k1.alias("_k1"), k2.alias("_k2"), pandas_udf(_described, "digest binary, n int, fp long, keys array<long>")(text).alias("d")).select("doc_id", "_k1", "_k2", "d.*"))
    alone = marked.groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = cut(alone.withColumn("node", F.monotonically_increasing_id()))
    roots = components(_links(nodes.where(F.col("doc").isNotNull()), docs, text))
    named = nodes.join(roots, nodes["node"] == roots["u"], "left").select("digest", F.coalesce("root", "node").alias("node"))
    return marked.select("doc_id", "_k1", "_k2", "digest").join(named, "digest").select("doc_id", "_k1", "_k2", "node")


def near_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and component_id (its smallest doc_id) of every row; links are pairs with a similarity of 0.8 or more."""
    found = cut(_components(docs, text))
    first = cut(found.groupBy("node").agg(F.min("doc_id").alias("component_id")))
    return found.join(first, "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their component; see ``simhash.first_rows``."""
    return first_rows(docs, cut(_components(docs, text)), text)
