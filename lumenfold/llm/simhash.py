"""SimHash near-duplicates through a vantage-point tree over Hamming space.

Fingerprints are computed per document; equal ones collapse before anything
else. A vantage-point tree built from a bounded sample deals the distinct
fingerprints to shards: those within the ball of a vantage point go inside, the
others outside, and by the triangle inequality only those within ``radius`` of
the boundary need to stand on both sides. So each pair within ``radius`` meets
in a shard. Shards find their pairs with the same tree rule in memory and
return a star per group, not all pairs. A shard that outgrows ``MAX_SHARD``
(one dense cluster) is instead dealt by one-bit neighbours: two fingerprints
within two bits share a neighbour, and no neighbour has more than 65 members.
Components are then joined across shards with distributed star contraction.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; repeated rows get equal results; an empty table gives an
empty result; further columns are ignored by ``near_duplicates`` and pass
through ``keep_first``.
"""

from __future__ import annotations

import uuid
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import content_key, cut
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Distinct fingerprints sampled to place vantage points; bounds what the driver holds.
SAMPLE = 32_768
#: Distinct fingerprints aimed at per shard as long as there are fewer than SHARDS; then shards grow to BIG, and their
#: own trees, in memory, do the rest: each level of the outer tree deals boundary points twice.
SHARD, SHARDS, BIG = 4096, 64, 5 << 18
#: Most fingerprints that one task takes: 16 bytes each.
MAX_SHARD = 24 << 20
#: Below this many, a shard's part is compared directly.
DIRECT = 768
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority of the bits of all shingle hashes, as an unsigned 64-bit integer."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        parts, n = iter([b" ".join(words)]), 1
    else:
        parts, n = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)), len(words) - shingle + 1
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), dtype="<u8", count=n))


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; of none, zero."""
    n, ones = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        some = hashes[at : at + _CHUNK]
        ones += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(column: str = "text"):
    """Signed 64-bit fingerprint of a text column."""

    @pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return of(F.col(column))


def _split(points: np.ndarray, radius: int, tries: int = 8) -> tuple[int, int] | None:
    """The vantage point and ball radius with the smallest larger side; None if no ball divides the points well."""
    best, found = 0.85 * len(points), None
    step = max(1, len(points) // tries)
    for v in points[::step][:tries]:
        d = np.bitwise_count(points ^ v).astype(np.int64)
        mu = int(np.median(d))
        for m in (mu, mu - 1):
            size = max(np.count_nonzero(d <= m), np.count_nonzero(d > m - radius))
            if size < best:
                best, found = size, (int(v), m)
    return found


def build_tree(sample: np.ndarray, shards: int, radius: int = RADIUS):
    """Nested (vantage point, ball radius, inside, outside) with shard numbers at the leaves, and their number."""
    count = 0

    def grow(points: np.ndarray, wanted: int):
        nonlocal count
        cut_at = _split(points, radius) if wanted > 1 and len(points) >= 32 else None
        if cut_at is None:
            count += 1
            return count - 1
        v, m = cut_at
        d = np.bitwise_count(points ^ np.uint64(v))
        return v, m, grow(points[d <= m], (wanted + 1) // 2), grow(points[d.astype(np.int64) > m - radius], wanted // 2)

    tree = grow(np.unique(sample), shards)
    return tree, count


def route(tree, points: np.ndarray, radius: int = RADIUS) -> list[list[int]]:
    """The shards of each point: its own and those whose boundary is within ``radius``."""
    out: list[list[int]] = [[] for _ in range(len(points))]

    def walk(node, idx: np.ndarray) -> None:
        if not len(idx):
            return
        if isinstance(node, int):
            for i in idx:
                out[i].append(node)
            return
        v, m, inside, outside = node
        d = np.bitwise_count(points[idx] ^ np.uint64(v)).astype(np.int64)
        walk(inside, idx[d <= m])
        walk(outside, idx[d > m - radius])

    walk(tree, np.arange(len(points)))
    return out


def _pairs(points: np.ndarray, idx: np.ndarray, radius: int, found: list) -> None:
    """Appends index pairs that connect all points within ``radius``."""
    if len(idx) <= DIRECT:
        i, j = np.nonzero(np.triu(np.bitwise_count(points[idx][:, None] ^ points[idx][None, :]) <= radius, 1))
        found.append((idx[i], idx[j]))
        return
    at = _split(points[idx], radius)
    if at is None:  # one dense cluster: meet at one-bit neighbours
        masks = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
        for m in range(0, len(masks), 65):
            keys = (points[idx][:, None] ^ masks[None, m : m + 65]).ravel()
            order = np.argsort(keys, kind="stable")
            same = keys[order][1:] == keys[order][:-1]
            who = np.repeat(idx, len(masks))[order]
            found.append((who[1:][same], who[:-1][same]))
        return
    d = np.bitwise_count(points[idx] ^ np.uint64(at[0])).astype(np.int64)
    _pairs(points, idx[d <= at[1]], radius, found)
    _pairs(points, idx[d > at[1] - radius], radius, found)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n vertices."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while not np.array_equal(nxt := root[root], root):
            root = nxt


def shard_links(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, root) of each distinct signed fingerprint of a shard that is linked to a smaller one."""
    points = np.sort(points)
    found: list = []
    _pairs(points.view(np.uint64), np.arange(len(points)), radius, found)
    root = _roots(len(points), *(np.concatenate(x) for x in zip(*found, strict=True)))
    moved = root != np.arange(len(points))
    return points[moved], points[root[moved]]


def shard_count(n: int) -> int:
    """Shards for so many distinct fingerprints."""
    return max(1, min(-(-n // SHARD), SHARDS), -(-n // BIG))


def _links(nodes: DataFrame, radius: int) -> DataFrame:
    """(u, v) links that connect all of the distinct fingerprints ``nodes`` (fp) within ``radius`` bits."""
    n = nodes.count()
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect()], dtype=np.int64).view(np.uint64)
    tree, _ = build_tree(sample, shard_count(n), radius)

    @pandas_udf("array<int>")
    def shards(fps: pd.Series) -> pd.Series:
        return pd.Series(route(tree, fps.to_numpy(np.int64).view(np.uint64), radius))

    routed = cut(nodes.select("fp", F.explode(shards("fp")).alias("shard")))
    sizes = routed.groupBy("shard").count()
    hot = [r["shard"] for r in sizes.where(F.col("count") > MAX_SHARD).select("shard").collect()]  # at most SAMPLE / 32 shard numbers

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = shard_links(pdf["fp"].to_numpy(np.int64), radius)
        return pd.DataFrame({"u": u, "v": v})

    links = routed.where(~F.col("shard").isin(hot)).groupBy("shard").applyInPandas(link, "u long, v long")
    if hot:
        flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), k) for k in range(64)])
        crowd = routed.where(F.col("shard").isin(hot)).select("fp").distinct()
        keys = crowd.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))
        met = keys.groupBy("key").agg(F.collect_set("fp").alias("fps"))  # a neighbour has 65 members at most
        links = links.unionByName(met.where(F.size("fps") > 1).select(F.explode("fps").alias("u"), F.array_min("fps").alias("v")))
    return links


def _labelled(docs: DataFrame, text: str, radius: int) -> DataFrame:
    """doc_id, _k1, _k2 (content key), fp and node (one fingerprint of the component) of every row."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    k1, k2 = content_key("doc_id", text)
    marked = cut(docs.select("doc_id", k1.alias("_k1"), k2.alias("_k2"), fingerprint_column(text).alias("fp")))
    roots = components(_links(cut(marked.select("fp").distinct()), radius))
    return marked.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("doc_id", "_k1", "_k2", "fp", F.coalesce("root", "fp").alias("node"))


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (signed 64-bit) and component_id (its smallest doc_id) of every row. ``radius`` is 2 or less."""
    found = cut(_labelled(docs, text, radius))
    first = cut(found.groupBy("node").agg(F.min("doc_id").alias("component_id")))  # apart from the join, which can then split a large component
    return found.join(first, "node").select("doc_id", "fp", "component_id")


def first_rows(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """The first row of each component: smallest doc_id, of rows that share it the one with the smallest content key.

    ``found`` has doc_id, _k1, _k2 (content key of doc_id and text) and node. Rows
    without a doc_id belong to no group and stay; of equal rows one stays.
    """
    named = found.where(F.col("doc_id").isNotNull())
    first = named.groupBy("node").agg(F.min(F.struct("doc_id", "_k1", "_k2")).alias("f"), F.count("*").alias("n"))
    name = f"_first_{uuid.uuid4().hex}"
    keys = [f"{name}_1", f"{name}_2"]
    k1, k2 = content_key("doc_id", text)
    chosen = first.select(F.col("f._k1").alias(keys[0]), F.col("f._k2").alias(keys[1]))
    kept = docs.where(F.col("doc_id").isNotNull()).withColumn(keys[0], k1).withColumn(keys[1], k2).hint("merge").join(chosen, keys, "left_semi")
    if named.groupBy("_k1", "_k2").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(keys)
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def keep_first(docs: DataFrame, text: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, all columns kept; see ``first_rows``."""
    return first_rows(docs, cut(_labelled(docs, text, radius)), text)
