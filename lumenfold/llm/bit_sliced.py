"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers. A block of rows is indexed by slices: for each
attribute, one bitmap per binary digit of its distance from the block's least value.
A query multiplies an attribute by its own value's signed digits: each digit adds the
attribute's slices, shifted, or their complements. Bitmaps of equal weight are added
by carry-save adders, three at a time, until one bitmap a weight is left: the slices
of the score. From the most significant slice downward, rows that must be among the
first k and rows that still can be are told apart by counting bits; what is left when
the slices end has equal scores, and the smallest ids fill up. The few rows found get
their scores from their integers.

Blocks of the index and chunks of queries meet pair by pair, each query keeps k rows a
block, and the k best of all blocks are ranked. Work follows queries times rows, as
every query is held against every row; memory follows a block and a few queries.

Defined results: vectors that are null, or hold nulls, non-finite components or ones
beyond ``LIMIT`` after quantisation, and rows without an id take no part; a query
meets vectors of its own length only; rows with equal ids are rows of their own, and
a query leaves out only itself; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

SCALE = 64
EVERY = 20
K = 20
#: Rows of a block of the index, queries of a chunk, queries that are added up at once.
BLOCK = 1 << 14
CHUNK = 512
AT_ONCE = 8
#: Largest size of a quantised component: sums of 500 products of two such stay within 64 bits.
LIMIT = 1 << 27

INDEX_SCHEMA = "dim int, block int, ids binary, rids binary, vectors binary, low binary, first binary, slices binary"


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(shift, sign) of the digits of an integer in non-adjacent form, the fewest that there are."""
    out, shift = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((shift, digit))
            value -= digit
        value >>= 1
        shift += 1
    return out


def slice_block(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least value of each attribute, first slice of each attribute and their number, all slices as rows of 64-bit words) of a block."""
    n, dim = vectors.shape
    low = vectors.min(axis=0) if n else np.zeros(dim, np.int64)
    above = vectors - low
    depth = [int(x).bit_length() for x in above.max(axis=0)] if n else [0] * dim
    first = np.concatenate([[0], np.cumsum(depth, dtype=np.int64)])
    bits = np.zeros((int(first[-1]), -(-n // 64) * 64), dtype=np.uint8)
    for j in range(dim):
        for d in range(depth[j]):
            bits[first[j] + d, :n] = above[:, j] >> d & 1
    return low, first, np.packbits(bits, axis=1, bitorder="little").view("<u8")


def add_slices(slices: np.ndarray, first: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Slices (query, weight, word), least significant first, of each query's inner products with all rows, but for a constant a query."""
    columns: list[list[list[int]]] = []  # weight -> query -> rows of ``table``
    nothing = 2 * len(slices)  # of table: the slices, their complements, a row of zeros
    for q, values in enumerate(queries.tolist()):
        for j, value in enumerate(values):
            depth = int(first[j + 1] - first[j])
            for shift, sign in signed_digits(value) if depth else ():
                for d in range(depth):
                    while len(columns) <= shift + d:
                        columns.append([[] for _ in range(len(queries))])
                    columns[shift + d][q].append(int(first[j]) + d + (len(slices) if sign < 0 else 0))
    table = np.concatenate([slices, ~slices, np.zeros((1, slices.shape[1]), dtype=np.uint64)])
    out, carried, weight = [], [], 0
    while weight < len(columns) or carried:
        stack = carried
        if weight < len(columns):
            most = max(map(len, columns[weight]))
            rows = np.array([c + [nothing] * (most - len(c)) for c in columns[weight]], dtype=np.int64).reshape(len(queries), most)
            if most:
                stack = [*stack, table[rows.T]]  # (bitmap, query, word)
        carried = []
        stack = np.concatenate(stack) if stack else np.zeros((1, len(queries), slices.shape[1]), dtype=np.uint64)
        while len(stack) > 1:
            m = len(stack) // 3
            if m == 0:  # two are left
                carried.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
                break
            a, b, c = stack[:m], stack[m : 2 * m], stack[2 * m : 3 * m]
            half = a ^ b
            carry = a & b
            carry |= half & c
            half ^= c
            carried.append(carry)
            stack = np.concatenate([half, stack[3 * m :]]) if len(stack) > 3 * m else half
        out.append(stack[0])
        weight += 1
    return np.stack(out, axis=1) if out else np.zeros((len(queries), 0, slices.shape[1]), dtype=np.uint64)


def first_rows(score: np.ndarray, able: np.ndarray, k: int) -> list[np.ndarray]:
    """Rows of the k highest scores of each query; among equal scores at the end, those that come first. ``able`` (query, word): rows that take part."""
    sure, can = np.zeros_like(able), able.copy()
    for d in range(score.shape[1] - 1, -1, -1):
        having = can & score[:, d]
        n = np.bitwise_count(sure | having).sum(axis=1, dtype=np.int64)[:, None]
        sure = np.where(n <= k, sure | having, sure)
        can = np.where(n >= k, having, can & ~having)
        can[(n == k)[:, 0]] = 0
    out = []
    for s, c in zip(sure, can, strict=True):
        rows = np.flatnonzero(np.unpackbits(s.view(np.uint8), bitorder="little"))
        if len(rows) < k and c.any():
            rows = np.concatenate([rows, np.flatnonzero(np.unpackbits(c.view(np.uint8), bitorder="little"))[: k - len(rows)]])
        out.append(rows)
    return out


def quantised(table: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """rid (a number of its own), id, v (array of long) and dim of every row that takes part."""
    v = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    plain = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(F.lit(scale) * x.cast("double")) <= LIMIT))
    rows = table.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & plain)
    return rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_column).cast("long").alias("id"), v.alias("v"), F.size(vector).alias("dim"))


def build_index(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a block of some ``block`` rows of ``quantised``: their ids in ascending order, integers and slices. Rows are dealt to blocks by a hash, so blocks are of much the same size."""
    sizes = {r["dim"]: -(-r["n"] // block) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # one row a length of vectors
    blocks = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair)) if sizes else F.lit(None).cast("map<int,int>")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("rid", "id"), blocks[F.col("dim")]).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "rid"])
        dim = int(pdf["dim"].iloc[0])
        vectors = np.stack(pdf["v"].to_list()).astype(np.int64).reshape(len(pdf), dim)
        low, first, slices = slice_block(vectors)
        packed = [x.tobytes() for x in (pdf["id"].to_numpy(np.int64), pdf["rid"].to_numpy(np.int64), vectors.astype("<i4"), low, first, slices)]
        return pd.DataFrame([[dim, pdf["block"].iloc[0], *packed]], columns=["dim", "block", "ids", "rids", "vectors", "low", "first", "slices"])

    return dealt.groupBy("dim", "block").applyInPandas(pack, INDEX_SCHEMA)


def search(queries: DataFrame, index: DataFrame, k: int = K, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows in the index. ``queries`` as ``quantised`` gives them; a row of the index with a query's rid is the query itself."""
    n = queries.groupBy("dim").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    chunks = max(1, -(-n // chunk))
    blocks = index.select(F.col("dim").alias("_dim"), F.col("block").alias("_block")).distinct()  # one row a block
    asked = queries.withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(chunks)).cast("int")).join(blocks, F.col("dim") == F.col("_dim")).select("rid", "id", "v", "dim", F.col("_block").alias("block"), "chunk")
    tiles = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def tile(key: tuple, asked: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        found: list[pd.DataFrame] = []
        if len(index) and len(asked):
            row, dim = index.iloc[0], int(key[0])
            ids, rids, vectors, first = (np.frombuffer(row[c], t) for c, t in (("ids", np.int64), ("rids", np.int64), ("vectors", "<i4"), ("first", np.int64)))
            vectors, words = vectors.reshape(len(ids), dim), -(-len(ids) // 64)
            slices = np.frombuffer(row["slices"], "<u8").reshape(-1, words)
            all_rows = np.packbits(np.arange(64 * words) < len(ids), bitorder="little").view("<u8")
            by_rid = np.argsort(rids)
            values, names, own = np.stack(asked["v"].to_list()).astype(np.int64).reshape(len(asked), dim), asked["id"].to_numpy(np.int64), asked["rid"].to_numpy(np.int64)
            spot = by_rid[np.minimum(np.searchsorted(rids[by_rid], own), len(rids) - 1)]
            for at in range(0, len(asked), AT_ONCE):
                some = slice(at, at + AT_ONCE)
                able = np.repeat(all_rows[None], len(values[some]), axis=0)
                for q, r in enumerate(spot[some].tolist()):
                    if rids[r] == own[at + q]:
                        able[q, r // 64] &= ~np.uint64(1 << (r % 64))
                for q, rows in enumerate(first_rows(add_slices(slices, first, values[some]), able, k)):
                    score = vectors[rows].astype(np.int64) @ values[at + q]
                    found.append(pd.DataFrame({"rid": own[at + q], "query_id": names[at + q], "vec_id": ids[rows], "score": score}))
        return pd.concat(found) if found else pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("rid", "query_id", "vec_id", "score")})

    best = asked.groupBy("dim", "block", "chunk").cogroup(tiles.groupBy("dim", "block", "chunk")).applyInPandas(tile, "rid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE, every: int = EVERY, k: int = K, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id and score: the k best partners of every row whose id is divisible by ``every``."""
    rows = cut(quantised(table, id_column, vector, scale))
    return search(rows.where(F.col("id") % every == 0), cut(build_index(rows, block)), k, chunk)
