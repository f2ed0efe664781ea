"""Substring dedup with suffix order and longest-previous-factor arrays.

Removes each byte that lies in a ``LENGTH``-byte string which also starts in a
document with a smaller doc_id. The texts are packed into stored blocks, and
what blocks must know of each other goes through hash buckets, as requests and
answers that Spark shuffles:

1. Whole texts and lines of at least ``LENGTH`` bytes: a bucket answers with the
   smallest doc_id that holds each. Where that is smaller, all bytes go, and
   windows inside need no further look: the first document shows them.
2. Minimisers: every window of ``LENGTH`` bytes has a smallest hashed ``GRAM``
   among its parts, so equal windows share it. A bucket answers which minimisers
   occur in more than one document; only their windows can repeat.
3. Stretches of windows with one shared minimiser go to its bucket with their
   bytes. The bucket sorts their suffixes to the depth of a window, and in that
   order the previous and next suffix of a smaller document give the longest
   previous factor, found by pointers that jump; where it reaches ``LENGTH``,
   the later copy goes.

Equal stretches within a block are sent once, for their smallest document, so a
passage that a third of all documents share is one row per block.

Defined results: a null text is empty; matches never cross documents; documents
with equal doc_id never count as earlier than each other; rows without a doc_id
come before all others; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .packing import bucket_ranges, press, press_sorted, unpress, unpress_sorted

LENGTH = 50
GRAM = 20
#: Bytes of text per block and of corpus per hash bucket; a task holds some 100 bytes for each.
BLOCK_BYTES = 1_500_000
BUCKET_BYTES = 4 << 20
NO_ID = -(2**63)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

ROWS = "block long, kind string, bucket int, blob binary"


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(16, n.bit_length())
    if size not in _powers:
        _powers.clear()
        tables = []
        for b in (_BASE, _INVERSE):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[size] = tuple(tables)
    return tuple(t[: n + 1] for t in _powers[size])


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Mixed rolling hash of the ``gram`` bytes from each position."""
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(data * up[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1]
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def window_minimisers(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each window of ``length`` bytes the smallest hash among its grams, spread over all values again."""
    if len(data) < length:
        return np.zeros(0, dtype=np.uint64)
    m, width, wanted = gram_hashes(data, gram), 1, length - gram + 1
    while 2 * width <= wanted:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (wanted - width)], m[wanted - width :])
    m *= np.uint64(0x9FB21C651E98DF25)  # minima are small, and hash buckets go by the leading bits
    m ^= m >> np.uint64(32)
    return m * np.uint64(0x9FB21C651E98DF25)


class Block:
    """Some documents: ids, byte lengths, and their bytes put together."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, text: bytes) -> None:
        self.ids, self.lengths, self.text = ids, lengths, text
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.data = np.frombuffer(text, dtype=np.uint8)

    def pack(self) -> bytes:
        head = np.array([len(self.ids)], dtype="<i8").tobytes() + self.ids.astype("<i8").tobytes() + self.lengths.astype("<i8").tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + self.text)

    @classmethod
    def unpack(cls, blob: bytes) -> Block:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        return cls(np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n), raw[8 + 16 * n :])

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """begin, end, document number and 128-bit hash (two arrays) of whole texts and lines that hold a window."""
        breaks = np.flatnonzero(self.data == 10)
        doc_of_break = np.searchsorted(self.ends, breaks, side="right")
        begin = np.concatenate([self.starts, self.starts, breaks + 1])
        doc = np.concatenate([np.arange(len(self.ids)), np.arange(len(self.ids)), doc_of_break])
        edges = np.sort(np.concatenate([breaks, self.ends]))
        end = np.concatenate([self.ends, edges[np.searchsorted(edges, begin[len(self.ids) :])]])
        end = np.minimum(end, self.ends[doc])
        long = end - begin >= LENGTH
        begin, end, doc = begin[long], end[long], doc[long]
        view, digest = memoryview(self.text), xxhash.xxh3_128_digest
        h = np.frombuffer(b"".join([digest(view[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        return begin, end, doc, h[:, 0], h[:, 1]

    def distinct_segments(self) -> tuple[np.ndarray, ...]:
        """begin, end, doc_id and distinct number of each segment; hashes (two arrays) and smallest doc_id of each distinct one, in order of the hashes."""
        begin, end, doc, h1, h2 = self.segments()
        ids = self.ids[doc]
        order = np.lexsort((ids, h2, h1))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        first = order[new]
        return begin, end, ids, number, h1[first], h2[first], ids[first]

    def valid_starts(self) -> np.ndarray:
        """Which positions start a window inside their document."""
        n = max(0, len(self.data) - LENGTH + 1)
        delta = np.zeros(len(self.data) + 1, dtype=np.int32)
        long = self.lengths >= LENGTH
        np.add.at(delta, self.starts[long], 1)
        np.add.at(delta, self.ends[long] - LENGTH + 1, -1)
        return np.cumsum(delta)[:n] > 0

    def runs(self, mask: np.ndarray, minimisers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretches of marked windows with one minimiser in one document: minimiser, first start, length."""
        if not mask.any():
            none = np.zeros(0, dtype=np.int64)
            return none.astype(np.uint64), none, none
        new = np.ones(len(mask), dtype=bool)
        new[1:] = (minimisers[1:] != minimisers[:-1]) | (mask[1:] != mask[:-1])
        first = self.starts[self.starts < len(mask)]
        new[first] = True
        at = np.flatnonzero(new)
        size = np.diff(at, append=len(mask))
        live = mask[at]
        return minimisers[at[live]], at[live], size[live]


def blocks(docs: DataFrame) -> DataFrame:
    """The stored blocks of all documents."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(ids: list, texts: list) -> pa.RecordBatch:
            b = Block(np.array(ids, dtype=np.int64), np.array([len(t) for t in texts], dtype=np.int64), b"".join(texts))
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([b.pack()], pa.binary())], names=["block", "blob"])

        ids: list[int] = []
        texts: list[bytes] = []
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                d, t = doc.as_py(), (text.as_py() or "").encode("utf-8", "replace")
                ids.append(NO_ID if d is None else d)
                texts.append(t)
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield row(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield row(ids, texts)

    return cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, "block long, blob binary"))


def _join_fields(*fields: bytes) -> bytes:
    return np.array([len(f) for f in fields], dtype="<u4").tobytes() + b"".join(fields)


def _split_fields(blob: bytes, n: int) -> list[bytes]:
    sizes = np.frombuffer(blob, "<u4", n)
    ends = 4 * n + np.cumsum(sizes)
    return [blob[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a, dtype=np.int64).view("<u8")


def first_requests(stored: DataFrame, buckets: int) -> DataFrame:
    """Kind s: hashes of the distinct segments with their smallest doc_id. Kind m: distinct minimisers and whether several documents of the block have them."""

    def ask(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for block, blob in zip(pdf["block"], pdf["blob"], strict=True):
                b = Block.unpack(blob)
                *_, h1, h2, least = b.distinct_segments()
                for k, x, y in bucket_ranges(h1, buckets):
                    rows.append((block, "s", k, _join_fields(press_sorted(h1[x:y]), press(h2[x:y]), press(_signed(least[x:y])))))
                minimisers = window_minimisers(b.data)
                value, at, _ = b.runs(b.valid_starts(), minimisers)
                doc = b.ids[np.searchsorted(b.ends, at, side="right")]
                order = np.lexsort((doc, value))
                value, doc = value[order], doc[order]
                new = np.flatnonzero(np.diff(value, prepend=value[:1] + np.uint64(1)) != 0) if len(value) else np.zeros(0, np.int64)
                last = np.append(new[1:], len(value)) - 1 if len(new) else new
                several = (doc[new] != doc[last]).astype(np.uint8)
                first = doc[new]
                for k, x, y in bucket_ranges(value[new], buckets):
                    rows.append((block, "m", k, _join_fields(press_sorted(value[new][x:y]), press(several[x:y]), press(_signed(first[x:y])))))
            yield pd.DataFrame(rows, columns=["block", "kind", "bucket", "blob"])

    return stored.mapInPandas(ask, ROWS)


def answer_first(pdf: pd.DataFrame) -> pd.DataFrame:
    """Kind s: the smallest doc_id of each segment. Kind m: one byte per minimiser, 1 if several documents have it."""
    kind = pdf["kind"].iloc[0]
    fields = [_split_fields(b, 3) for b in pdf["blob"]]
    h = [unpress_sorted(f[0]) for f in fields]
    at = np.concatenate([[0], np.cumsum([len(x) for x in h])])
    h = np.concatenate(h)
    ids = np.concatenate([unpress(f[2], "<u8").view("<i8") for f in fields])
    if kind == "s":
        h2 = np.concatenate([unpress(f[1], "<u8") for f in fields])
        order = np.lexsort((ids, h2, h))
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1])
        least = np.empty(len(h), dtype=np.int64)
        least[order] = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        out = [press(_signed(least[x:y])) for x, y in zip(at[:-1], at[1:], strict=True)]
    else:
        several = np.concatenate([unpress(f[1], "|u1") for f in fields])
        order = np.lexsort((ids, h))
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[order][1:] != h[order][:-1]
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(h)) - 1
        shared = (ids[order][begin] != ids[order][last]) | (np.maximum.reduceat(several[order], begin) > 0)
        flag = np.empty(len(h), dtype=np.uint8)
        flag[order] = shared[group]
        out = [press(flag[x:y]) for x, y in zip(at[:-1], at[1:], strict=True)]
    return pd.DataFrame({"block": pdf["block"], "kind": kind, "bucket": pdf["bucket"], "blob": out})


class Judged:
    """A block with the first answers: what they remove, and the stretches still to be compared."""

    def __init__(self, rows: pd.DataFrame) -> None:
        take = lambda kind: rows[rows["kind"] == kind].sort_values("bucket")["blob"]
        b = self.block = Block.unpack(take("p").iloc[0])
        begin, end, ids, number, *_ = b.distinct_segments()
        least = [unpress(x, "<u8").view("<i8") for x in take("s")]
        earlier = np.concatenate(least)[number] < ids if least else np.zeros(len(begin), dtype=bool)
        self.gone = np.zeros(len(b.data) + 1, dtype=np.int32)  # difference array of removed bytes
        np.add.at(self.gone, begin[earlier], 1)
        np.add.at(self.gone, end[earlier], -1)
        settled = np.zeros(len(b.data) + 1, dtype=np.int32)
        np.add.at(settled, begin[earlier], 1)
        np.add.at(settled, end[earlier] - LENGTH + 1, -1)
        minimisers = window_minimisers(b.data)
        valid = b.valid_starts()
        value, at, size = b.runs(valid, minimisers)
        flags = [unpress(x, "|u1") for x in take("m")]
        names = np.unique(value)
        shared = np.concatenate(flags)[np.searchsorted(names, value)] > 0 if flags else np.zeros(0, dtype=bool)
        mask = np.zeros(len(valid) + 1, dtype=np.int32)
        np.add.at(mask, at[shared], 1)
        np.add.at(mask, at[shared] + size[shared], -1)
        mask = (np.cumsum(mask)[:-1] > 0) & ~(np.cumsum(settled)[: len(valid)] > 0)
        value, self.at, self.size = b.runs(mask, minimisers)
        self.doc = b.ids[np.searchsorted(b.ends, self.at, side="right")]
        # equal stretches are sent once, for their smallest document
        view, digest = memoryview(b.text), xxhash.xxh3_128_digest
        text = [digest(view[x : x + n + LENGTH - 1]) for x, n in zip(self.at.tolist(), self.size.tolist(), strict=True)]
        h = np.frombuffer(b"".join(text), dtype=">u8").astype(np.uint64).reshape(-1, 2)
        order = np.lexsort((self.at, self.doc, h[:, 1], h[:, 0], value))
        new = np.ones(len(order), dtype=bool)
        if len(order):
            new[1:] = (h[order][1:] != h[order][:-1]).any(axis=1) | (value[order][1:] != value[order][:-1])
        self.group = np.empty(len(order), dtype=np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.sent = order[new]  # by minimiser, as ``value`` is the first key
        self.value = value[self.sent]
        self.local = self.doc > self.doc[self.sent][self.group] if len(order) else np.zeros(0, dtype=bool)


def stretch_requests(buckets: int):
    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        j = Judged(rows)
        out = []
        text = j.block.text
        for k, x, y in bucket_ranges(j.value, buckets):
            s = j.sent[x:y]
            body = b"".join([text[a : a + n + LENGTH - 1] for a, n in zip(j.at[s].tolist(), j.size[s].tolist(), strict=True)])
            out.append((int(rows["block"].iloc[0]), "x", k, _join_fields(press(j.size[s].astype("<u4")), press(_signed(j.doc[s])), zstandard.ZstdCompressor(level=3).compress(body))))
        return pd.DataFrame(out, columns=["block", "kind", "bucket", "blob"])

    return ask


def suffix_order(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``at`` by their first ``length`` bytes, and each one's common prefix with the one before, up to ``length``.

    ``length`` bytes must follow every position.
    """
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    offsets = [*range(0, length - 7, 8)]
    if offsets[-1] + 8 < length:
        offsets.append(length - 8)
    keys = [np.ascontiguousarray(words[at + o]).view(">u8").ravel().astype(np.uint64) for o in offsets]
    order = np.lexsort(keys[::-1])
    common = np.zeros(len(at), dtype=np.int64)
    open_ = np.ones(max(0, len(at) - 1), dtype=bool)
    for o, k in zip(offsets, keys, strict=True):
        x = k[order][1:] ^ k[order][:-1]
        lead = sum((x < np.uint64(1 << (64 - 8 * b))).astype(np.int64) for b in range(1, 8))  # equal leading bytes
        differs = open_ & (x != 0)
        common[1:][differs] = np.minimum(o + lead[differs], length)
        open_ &= x == 0
    common[1:][open_] = length
    return order, common


def _smaller_before(rank: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix with the nearest one before it, in suffix order, whose document is smaller; 0 below ``length``.

    All pointers jump at once: what lies between a suffix and the one it points to is of no smaller document, so a
    pointer to such a one may take over that one's pointer, and the shorter of both prefixes.
    """
    n = len(rank)
    to = np.arange(n) - 1
    shared = common.copy()
    shared[:1] = 0
    live = np.flatnonzero((shared >= length) & (to >= 0))
    live = live[rank[to[live]] >= rank[live]]
    while len(live):
        via = to[live]
        shared[live] = np.minimum(shared[live], shared[via])
        to[live] = to[via]
        live = live[(shared[live] >= length) & (to[live] >= 0)]
        live = live[rank[to[live]] >= rank[live]]
    return np.where((shared >= length) & (to >= 0), shared, 0)


def longest_previous_factor(doc: np.ndarray, common: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The longest previous factor of each suffix, in suffix order: the longer of its common prefixes with the previous and
    the next suffix of a smaller document. ``common`` is that with the suffix before; lengths below ``length`` count as 0.
    """
    if not len(doc):
        return np.zeros(0, dtype=np.int64)
    _, rank = np.unique(doc, return_inverse=True)
    after = np.append(common[1:], 0)  # common prefix with the suffix behind
    return np.maximum(_smaller_before(rank, common, length), _smaller_before(rank[::-1], after[::-1], length)[::-1])


def answer_stretches(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each asking block the bits of its windows that start an earlier copy elsewhere."""
    fields = [_split_fields(b, 3) for b in pdf["blob"]]
    sizes = [unpress(f[0], "<u4").astype(np.int64) for f in fields]
    per = np.array([int(s.sum()) for s in sizes])
    size = np.concatenate(sizes)
    doc = np.concatenate([unpress(f[1], "<u8").view("<i8") for f in fields])
    data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(f[2]) for f in fields), dtype=np.uint8)
    begin = np.cumsum(size + LENGTH - 1) - (size + LENGTH - 1)
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
    owner = np.repeat(doc, size)
    order, common = suffix_order(data, at)
    again = np.empty(len(at), dtype=bool)
    again[order] = longest_previous_factor(owner[order], common) >= LENGTH
    ends = np.cumsum(per)
    bits = [np.packbits(again[e - n : e]).tobytes() for e, n in zip(ends, per, strict=True)]
    return pd.DataFrame({"block": pdf["block"], "kind": "y", "bucket": pdf["bucket"], "blob": [zstandard.compress(b) for b in bits]})


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def finish(keep_bytes: bool):
    def result(rows: pd.DataFrame) -> pd.DataFrame:
        j = Judged(rows)
        b = j.block
        answers = rows[rows["kind"] == "y"].sort_values("bucket")
        flags = np.zeros(0, dtype=bool)
        size = j.size[j.sent]
        bits, position = [], 0
        for (_, x, y), blob in zip(bucket_ranges(j.value, int(rows["buckets"].iloc[0])), answers["blob"], strict=True):
            n = int(size[x:y].sum())
            bits.append(np.unpackbits(np.frombuffer(zstandard.decompress(blob), dtype=np.uint8), count=n).astype(bool))
        flags = np.concatenate(bits) if bits else flags
        offset = np.cumsum(size) - size
        position = np.repeat(j.at - (np.cumsum(j.size) - j.size), j.size) + np.arange(j.size.sum())
        source = np.repeat(offset[j.group] - (np.cumsum(j.size) - j.size), j.size) + np.arange(j.size.sum())
        again = (flags[source] | np.repeat(j.local, j.size)) if len(position) else flags
        hits = position[again]
        np.add.at(j.gone, hits, 1)
        np.add.at(j.gone, hits + LENGTH, -1)
        gone = np.cumsum(j.gone)[:-1] > 0
        out = []
        for doc, x, y in zip(b.ids.tolist(), b.starts.tolist(), b.ends.tolist(), strict=True):
            own = gone[x:y]
            removed = int(own.sum())
            kept = b.data[x:y][~own].tobytes() if removed else b.text[x:y]
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if removed else 0
            out.append((None if doc == NO_ID else doc, y - x, removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]).astype({"doc_id": "Int64"})

    return result


def remove_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (if wanted) the kept bytes of every document."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).first()["n"] or 0
    buckets = max(1, -(-int(total) // BUCKET_BYTES))
    stored = blocks(docs)
    payload = stored.select("block", F.lit("p").alias("kind"), F.lit(-1).alias("bucket"), "blob")
    first = cut(first_requests(stored, buckets).groupBy("bucket", "kind").applyInPandas(answer_first, ROWS))
    known = payload.unionByName(first)
    asked = known.groupBy("block").applyInPandas(stretch_requests(buckets), ROWS)
    second = cut(asked.groupBy("bucket").applyInPandas(answer_stretches, ROWS))
    everything = known.unionByName(second).withColumn("buckets", F.lit(buckets))
    return everything.groupBy("block").applyInPandas(finish(keep_bytes), RESULT)
