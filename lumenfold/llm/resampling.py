"""Target-distribution importance resampling on hashed n-gram features.

Distinct features of a group of texts are put into two-dimensional byte arrays,
one for each length; the CRCs of all rows of an array are updated column by
column, and scattered back to their features. A task adds up its features' buckets
before anything moves, so a bucket has one row a task however frequent its words.
The table of gains has one entry a bucket, a number that the caller fixes.

Draws are ranked in parts: documents are dealt by ranges of score, each range
counts its eligible documents, and a document's rank is the sum of the ranges
before its own plus its place there. Only as many sums as ranges meet in one task.

Defined results: null and empty texts have no features and weigh 0; rows with
equal doc_ids are documents of their own (equal scores and ids: in the order of
their content); a missing doc_id is hashed as an empty string and comes first
among equals; an empty corpus or target counts zero; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut
from .parts import groups

N_BUCKETS = 10_000
MAX_NGRAM = 1
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Rows aimed at per range of scores.
RANGE_ROWS = 1 << 17
#: Bytes of a matrix that is worked off at once; longer features are summed up one by one, as a column of few rows gains nothing.
MATRIX = 1 << 22
LONG = 512
#: Bytes of text whose words are held at once.
GROUP = 4 << 20

#: Word characters are digits, letters and all that is not ASCII; A-Z become lower case.
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def crc_table() -> np.ndarray:
    """CRC-32 of each byte value, reflected polynomial 0xEDB88320."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_TABLE = crc_table()


def crc32_all(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each stretch of ``data`` (bytes)."""
    out = np.empty(len(starts), dtype=np.uint32)
    if not len(out):
        return out
    order = np.argsort(sizes, kind="stable")
    lengths, first = np.unique(sizes[order], return_index=True)
    for size, bucket in zip(lengths.tolist(), np.split(order, first[1:]), strict=True):
        if size > LONG:
            for k in bucket.tolist():
                out[k] = zlib.crc32(data[starts[k] : starts[k] + size])
            continue
        step = max(1, MATRIX // max(size, 1))
        for at in range(0, len(bucket), step):
            rows = bucket[at : at + step]
            matrix = data[starts[rows][None, :] + np.arange(size)[:, None]]  # a row of it is a column of the features
            crc = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
            for column in matrix:
                crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
            out[rows] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def features(texts: pa.Array, max_ngram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts, in order: (CRC of every feature one after the other, offset of each text in them, words of each text)."""
    for lo, hi in groups(texts, GROUP):
        words = [t.translate(_FOLD).split() if t else [] for t in texts.slice(lo, hi - lo).to_pylist()]
        if max_ngram == 1:
            grams = words
        else:
            grams = [[g for n in range(1, max_ngram + 1) for g in (map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False)))] for w in words]
        coded = pa.array([g for w in grams for g in w], pa.large_binary()).dictionary_encode()
        at = np.concatenate([[0], np.cumsum([len(w) for w in grams], dtype=np.int64)])
        _, offsets, data = coded.dictionary.buffers()
        edges = np.frombuffer(offsets, dtype="<i8", count=len(coded.dictionary) + 1) if len(coded.dictionary) else np.zeros(1, np.int64)
        crc = crc32_all(np.frombuffer(data or b"", dtype=np.uint8), edges[:-1], np.diff(edges))
        yield crc[coded.indices.to_numpy()], at, np.array([len(w) for w in words], dtype=np.int64)


def bucket_counts(texts: DataFrame, n_buckets: int = N_BUCKETS, max_ngram: int = MAX_NGRAM) -> DataFrame:
    """bucket and n: features of all texts of a column ``text``, repeats included."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for crc, _, _ in features(batch.column(0).cast(pa.binary()), max_ngram):
                sums += np.bincount(crc % np.uint32(n_buckets), minlength=n_buckets)
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array(sums[full])], names=["bucket", "n"])

    return texts.select(F.col("text").cast("string").cast("binary")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS, max_ngram: int = MAX_NGRAM) -> np.ndarray:
    """Of each bucket, 1000 times the natural logarithm of its smoothed share in the target over that in the corpus, rounded down."""
    s, t = np.zeros(n_buckets), np.zeros(n_buckets)
    for texts, sums in ((corpus, s), (target, t)):
        for row in bucket_counts(texts, n_buckets, max_ngram).collect():  # n_buckets rows at most
            sums[row["bucket"]] = row["n"]
    ratio = (t + 1) * (s.sum() + n_buckets) / ((s + 1) * (t.sum() + n_buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], dtype=np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """1000 times a standard Gumbel draw that the seed and the doc_id fix, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, max_ngram: int = MAX_NGRAM, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    table = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = table.value
        for batch in batches:
            ids, done = batch.column(0), 0
            for crc, at, words in features(batch.column(1).cast(pa.binary()), max_ngram):
                upto = np.concatenate([[0], np.cumsum(gain[crc % np.uint32(len(gain))])])[at]
                own = ids.slice(done, len(words))
                weight = np.diff(upto)
                score = weight + np.array([noise(i, seed) for i in own.to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([own, *(pa.array(x, pa.int64()) for x in (words, np.diff(at), weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])
                done += len(words)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(weighed: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``weighed`` (a stored table) with rank: the place of the drawn documents, ``percent`` of those with ``min_words`` words or more; null for the others."""
    eligible = F.col("n_words") >= min_words
    count = weighed.agg(F.count("*").alias("rows"), F.count(F.when(eligible, True)).alias("n")).first()
    n_ranges, drawn = max(1, -(-count["rows"] // RANGE_ROWS)), percent * count["n"] // 100
    order = [F.col("eligible").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight"), F.col("n_features"), F.col("rid")]
    rows = weighed.withColumns({"eligible": eligible, "rid": F.monotonically_increasing_id()})
    dealt = cut(rows.repartitionByRange(n_ranges, *order).withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.count(F.when(F.col("eligible"), True)).alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a range
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    out = dealt.join(F.broadcast(before), "part").withColumn("place", place)
    return out.withColumn("rank", F.when(F.col("eligible") & (F.col("place") <= drawn), F.col("place")).cast("long")).drop("eligible", "rid", "part", "before", "place")


def resample(docs: DataFrame, target: DataFrame, n_buckets: int = N_BUCKETS, max_ngram: int = MAX_NGRAM, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document: a draw without replacement in proportion to the weights."""
    gain = gains(docs, target, n_buckets, max_ngram)
    return ranked(cut(weigh(docs, gain, max_ngram, seed)), min_words, percent)
