"""Language-model scores by deleted interpolation.

A text's probability mixes bigram maximum-likelihood estimates with add-one
unigrams: ``p(v|u) = L c(u,v)/c(u) + (1-L) (c(v)+1)/(N+V+1)``. The weight L
depends on how often the context was seen (a bucket per power of two) and is
learned by expectation-maximisation on counts held out of the training part.

Counting keeps Spark's shuffles small. Texts are packed into blocks of word
indices; a block asks for the corpus counts of its distinct words, and of its word
pairs of known words, with one request per hash bucket
(sorted 64-bit hashes and local counts). Buckets sum what all blocks sent and
answer in the order of the request. Workers keep numbers of tokens, words and pairs
in 32 bits and let go of what a step no longer needs. A word or pair that fills a third of the
corpus is one entry per block, so no bucket is hot; requests without entries
are not sent, so their number follows the data. Words and pairs are told apart
by 64-bit hashes. Blocks and answers are stored tables.

Every context of the corpus has its bigrams; one it does not hold falls back to
unigrams. A bucket without tuning data takes the weight of the nearest trained
one. Defined results: a null, empty or blank text is the end token alone;
repeated rows count as separate training texts and get equal scores; rows
without a doc_id train and are not held out; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .packing import bucket_ranges, entries, press, press_sorted, unpress, unpress_sorted

FOLDS = 7
#: Documents of this remainder are scored as unseen; of the next, their counts train the mixture weights.
HELD_OUT = 2
TUNING = 3
#: Characters per block, and characters of corpus per hash bucket.
BLOCK_CHARS = 8 << 20
BUCKET_CHARS = 24 << 20
#: Quantisation of the likelihood ratio that the mixture weights are learned from: steps per power of two.
STEPS, LIMIT = 16, 48
ROUNDS = 200
END = b""
_CHUNK = 1 << 16

REPLY = "block long, kind string, bucket int, blob binary, n1 long, n2 long, n3 long, n4 long"
REQUEST = "bucket int, block long, hashes binary, counts binary"


def tokenize(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end token."""
    return [*(text or "").encode("utf-8", "replace").lower().split(), END]


def fold(doc_id: int | None) -> int:
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


class Block:
    """Documents of one block: doc_ids, folds, lengths, word indices and the sorted word hashes."""

    def __init__(self, ids: list, lengths: np.ndarray, tokens: np.ndarray, hashes: np.ndarray) -> None:
        self.ids, self.lengths, self.tokens, self.hashes = ids, lengths, tokens, hashes

    @classmethod
    def pack(cls, docs: Iterable[tuple[int | None, list[bytes]]]) -> bytes:
        """The words of one document at a time are held; of the others, their numbers."""
        known: dict[bytes, int] = {}
        names, parts = [], []
        for doc, words in docs:
            names.append(doc)
            parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int32, count=len(words)))
        tokens = np.concatenate(parts)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), dtype=np.uint64, count=len(known))
        order = np.argsort(hashes)
        counts = np.bincount(tokens, minlength=len(known))
        by_count = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which compress well
        number = np.empty(len(known), dtype="<u4")
        number[by_count] = np.arange(len(known))
        spot = number[order]  # number of the k-th smallest hash
        nulls = np.array([d is None for d in names], dtype=np.uint8)
        ids = np.array([0 if d is None else d for d in names], dtype="<i8")
        fields = [press(ids.view("<u8")), nulls.tobytes(), press(np.array([len(p) for p in parts], dtype="<u4")), press(number[tokens]), press_sorted(hashes[order]), press(spot)]
        head = np.array([len(f) for f in fields], dtype="<u4").tobytes()
        return head + b"".join(fields)

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        sizes = np.frombuffer(data, "<u4", 6)
        ends = 24 + np.cumsum(sizes)
        f = [data[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
        ids = unpress(f[0], "<u8").view("<i8").tolist()
        ids = [None if n else d for d, n in zip(ids, f[1], strict=True)]
        hashes, spot = unpress_sorted(f[4]), unpress(f[5], "<u4")
        rank = np.empty(len(spot), dtype=np.int32)
        rank[spot] = np.arange(len(spot), dtype=np.int32)
        return cls(ids, unpress(f[2], "<u4").astype(np.int64), rank[unpress(f[3], "<u4")], hashes)

    def folds(self) -> np.ndarray:
        return np.repeat(np.array([fold(d) for d in self.ids], dtype=np.uint8), self.lengths)

    def local_counts(self, index: np.ndarray, size: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """How often each index occurs in training texts that do not, and that do, tune the weights. ``index`` stands for
        all tokens or for ``some``.
        """
        f = self.folds() if some is None else self.folds()[some]
        tuning = f == TUNING
        rest = ~tuning & (f != HELD_OUT)
        return np.bincount(index[rest], minlength=size), np.bincount(index[tuning], minlength=size)

    def contexts(self) -> np.ndarray:
        """Index of the word before each token; before the first, the end token."""
        end = np.searchsorted(self.hashes, np.uint64(xxhash.xxh64_intdigest(END)))
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[np.concatenate([[0], np.cumsum(self.lengths)[:-1]])] = end
        return before


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    x = u * np.uint64(0x9E3779B97F4A7C15)
    x += v
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each value among them in 32 bits."""
    order = np.argsort(values)
    values = values[order]
    new = np.ones(len(values), dtype=bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    values = values[new]
    number = np.cumsum(new, dtype=np.int32)
    number -= 1
    where = np.empty_like(number)
    where[order] = number
    return values, where


def blocks(docs: DataFrame) -> DataFrame:
    """The stored blocks of all documents."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(docs: Iterator) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([Block.pack(docs)], pa.binary())], names=["block", "blob"])

        rows = ((doc.as_py(), text.as_py()) for batch in batches for doc, text in zip(batch.column(0), batch.column(1), strict=True))

        def some(doc: int | None, text: str | None) -> Iterator[tuple[int | None, list[bytes]]]:
            """This document and those that follow, up to the size of a block."""
            size = len(text or "") + 1
            yield doc, tokenize(text)
            while size < BLOCK_CHARS and (following := next(rows, None)):
                size += len(following[1] or "") + 1
                yield following[0], tokenize(following[1])

        for first in rows:
            yield row(some(*first))

    return cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, "block long, blob binary"))


def _requests(block: int, hashes: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[tuple]:
    """One row per bucket with entries. ``hashes`` are sorted; ``counts`` has a column per kind of count."""
    for bucket, a, b in bucket_ranges(hashes, buckets):
        yield bucket, block, press_sorted(hashes[a:b]), press(np.ascontiguousarray(counts[a:b].T).ravel().astype("<u4"))


def word_requests(stored: DataFrame, buckets: int) -> DataFrame:
    def ask(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for block, blob in zip(pdf["block"], pdf["blob"], strict=True):
                b = Block.unpack(blob)
                counts = np.stack(b.local_counts(b.tokens, len(b.hashes)), axis=1)
                yield pd.DataFrame(_requests(block, b.hashes, counts, buckets), columns=["bucket", "block", "hashes", "counts"])

    return stored.mapInPandas(ask, REQUEST)


def _gather(pdf: pd.DataFrame, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all entries of a bucket: the number of their hash, their counts, and where each request begins."""
    at = np.cumsum([0, *(entries(h, "<u8") for h in pdf["hashes"])])
    hashes = np.empty(at[-1], dtype=np.uint64)
    for i, j, h in zip(at[:-1], at[1:], pdf["hashes"], strict=True):
        hashes[i:j] = unpress_sorted(h)
    where = distinct(hashes)[1]
    del hashes
    counts = np.empty((columns, at[-1]), dtype=np.uint32)
    for i, j, c in zip(at[:-1], at[1:], pdf["counts"], strict=True):
        counts[:, i:j] = unpress(c, "<u4").reshape(columns, -1)
    return where, counts, at


def _sums(where: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sums = np.zeros(int(where.max(initial=-1)) + 1, dtype=np.int64)
    for at in range(0, len(where), _CHUNK):
        np.add.at(sums, where[at : at + _CHUNK], counts[at : at + _CHUNK])
    return sums


def answer_words(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of a bucket's words for each asking block, and a row with the bucket's token and word counts."""
    where, counts, at = _gather(pdf, 2)
    rest, tuning = (_sums(where, c) for c in counts)
    rows = [(int(b), "w", int(k), press(np.concatenate([rest[w], tuning[w]]).astype("<u8")), 0, 0, 0, 0) for b, k, w in zip(pdf["block"], pdf["bucket"], (where[i:j] for i, j in zip(at[:-1], at[1:], strict=True)), strict=True)]
    both = rest + tuning
    rows.append((-1, "s", 0, b"", int(rest.sum()), int((rest > 0).sum()), int(both.sum()), int((both > 0).sum())))
    return pd.DataFrame(rows, columns=["block", "kind", "bucket", "blob", "n1", "n2", "n3", "n4"])


class Known:
    """A block with the corpus counts of its words."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.block = Block.unpack(rows.loc[rows["kind"] == "p", "blob"].iloc[0])
        words = rows[rows["kind"] == "w"].sort_values("bucket")["blob"]
        parts = [unpress(b, "<u8").astype(np.int64).reshape(2, -1) for b in words]
        self.rest, self.tuning = np.concatenate(parts, axis=1)
        self.total = self.rest + self.tuning
        b = self.block
        self.u, self.v = b.contexts(), b.tokens
        # only pairs of known words have a bigram estimate
        self.asked = (self.total[self.u] > 0) & (self.total[self.v] > 0)
        keys = self.u[self.asked] * np.int64(len(b.hashes))
        keys += self.v[self.asked]
        keys, self.pair = distinct(keys)
        self.pu, self.pv = (keys // len(b.hashes)).astype(np.int32), (keys % len(b.hashes)).astype(np.int32)
        del keys
        self.hashes = pair_hash(b.hashes[self.pu], b.hashes[self.pv])
        self.order = np.argsort(self.hashes).astype(np.int32)
        self.hashes = self.hashes[self.order]

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        return self.block.local_counts(self.pair, len(self.pu), self.asked)


def level(context_count: np.ndarray) -> np.ndarray:
    """Context-frequency bucket."""
    return np.floor(np.log2(np.maximum(context_count, 1))).astype(np.int64)


def pair_requests(n_rest: int, v_rest: int, buckets: int):
    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        k = Known(rows)
        rest, tuning = (c.astype("<u4") for c in k.pair_counts())
        # log2 of 1 / (c(u) p1(v)) over counts that leave the tuning texts out, and the context's bucket
        context = k.rest[k.pu]
        base = np.log2((n_rest + v_rest + 1) / (np.maximum(context, 1) * (k.rest[k.pv] + 1.0)))
        code = np.clip(np.round((base + LIMIT) * STEPS), 0, 2 * LIMIT * STEPS).astype("<u4") * np.uint32(64) + level(context).astype("<u4")
        code[(tuning == 0) | (context == 0)] = 0
        del base, context
        counts = np.stack([rest, tuning, code], axis=1)[k.order]
        return pd.DataFrame(_requests(int(rows["block"].iloc[0]), k.hashes, counts, buckets), columns=["bucket", "block", "hashes", "counts"])

    return ask


def answer_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals of a bucket's pairs for each asking block, and rows (context bucket, quantised ratio, tuning tokens)."""
    where, counts, at = _gather(pdf, 3)
    rest = _sums(where, counts[0])
    total = rest + _sums(where, counts[1])
    rows = [(int(b), "q", int(k), press(total[w].astype("<u8")), 0, 0, 0, 0) for b, k, w in zip(pdf["block"], pdf["bucket"], (where[i:j] for i, j in zip(at[:-1], at[1:], strict=True)), strict=True)]
    del total
    live = np.flatnonzero(counts[2])
    own, code = counts[1][live], counts[2][live].astype(np.int32)
    seen = rest[where[live]]
    ratio = np.where(seen > 0, code // 64 + np.round(np.log2(np.maximum(seen, 1)) * STEPS).astype(np.int32), -1)
    width = 2 * LIMIT * STEPS + 64 * STEPS + 2  # of a ratio, which is -1 or more
    keys, spot = distinct(code % 64 * width + ratio + 1)
    n = _sums(spot, own)
    rows += [(-1, "h", 0, b"", k // width, k % width - 1, c, 0) for k, c in zip(keys.tolist(), n.tolist(), strict=True)]
    return pd.DataFrame(rows, columns=["block", "kind", "bucket", "blob", "n1", "n2", "n3", "n4"])


def mixture_weights(histogram: list[tuple[int, int, int]]) -> dict[int, float]:
    """Bigram weight per context bucket by expectation-maximisation over (bucket, ratio, tokens)."""
    weights = {}
    for b in sorted({h[0] for h in histogram}):
        q, n = (np.array(x, dtype=float) for x in zip(*[(r, c) for k, r, c in histogram if k == b], strict=True))
        ratio = np.where(q < 0, 0.0, np.exp2(q / STEPS - LIMIT))
        w = 0.5
        for _ in range(ROUNDS):
            w = float((n * (w * ratio / (w * ratio + 1 - w))).sum() / n.sum())
            w = min(max(w, 1e-6), 1 - 1e-6)
        weights[b] = w
    return weights


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def weight_table(weights: dict[int, float]) -> np.ndarray:
    """Weight of each of 64 context buckets: its own, or that of the nearest trained one (the lower of two); without any, unigrams."""
    if not weights:
        return np.zeros(64)
    return np.array([weights[min(weights, key=lambda t: (abs(t - b), t))] for b in range(64)])


def scorer(n: int, v: int, weights: dict[int, float]):
    table = weight_table(weights)

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        k = Known(rows)
        b = k.block
        answers = [unpress(x, "<u8").astype(np.int64) for x in rows[rows["kind"] == "q"].sort_values("bucket")["blob"]]
        pairs = np.zeros(len(k.pu), dtype=np.int64)
        if answers:
            pairs[k.order] = np.concatenate(answers)
        del answers
        k.hashes = k.order = k.pu = k.pv = None
        p1 = ((k.total + 1.0) / (n + v + 1.0))[k.v]
        weight = np.where(k.total > 0, table[level(k.total)], 0.0)  # of each word as a context
        w = weight[k.u]
        p = np.zeros(len(k.v))
        p[k.asked] = pairs[k.pair]
        p *= w
        p /= np.maximum(k.total, 1)[k.u]
        np.subtract(1, w, out=w)
        w *= p1
        p += w
        del w, pairs
        starts = np.concatenate([[0], np.cumsum(b.lengths)[:-1]])
        out = {
            "doc_id": pd.array(b.ids, dtype="Int64"),
            "held_out": [fold(d) == HELD_OUT for d in b.ids],
            "n_tokens": b.lengths,
            "n_known": np.add.reduceat((k.total > 0)[k.v], starts, dtype=np.int64),
            "train_tokens": n,
            "base_score": np.add.reduceat(np.log10(p1), starts),
            "score": np.add.reduceat(np.log10(p), starts),
        }
        return pd.DataFrame(out)

    return score


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    chars = docs.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).alias("n")).first()["n"] or 0
    buckets = max(1, -(-int(chars) // BUCKET_CHARS))
    stored = blocks(docs)
    payload = stored.select("block", F.lit("p").alias("kind"), F.lit(-1).alias("bucket"), "blob", *[F.lit(0).cast("long").alias(f"n{i}") for i in (1, 2, 3, 4)])
    words = cut(word_requests(stored, buckets).groupBy("bucket").applyInPandas(answer_words, REPLY))
    sums = words.where("kind = 's'").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n_rest, v_rest, n, v = (int(x or 0) for x in sums)
    known = payload.unionByName(words.where("kind = 'w'"))
    asked = known.groupBy("block").applyInPandas(pair_requests(n_rest, v_rest, buckets), REQUEST)
    pairs = cut(asked.groupBy("bucket").applyInPandas(answer_pairs, REPLY))
    histogram = pairs.where("kind = 'h'").groupBy("n1", "n2").agg(F.sum("n3").alias("n3")).collect()  # at most 64 x (2 LIMIT + 64) x STEPS rows
    weights = mixture_weights([tuple(r) for r in histogram])
    return known.unionByName(pairs.where("kind = 'q'")).groupBy("block").applyInPandas(scorer(n, v, weights), SCORES)
