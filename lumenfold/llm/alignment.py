"""Two tokenizers aligned on the bytes of the texts: common cuts, groups of ids between them, links of overlapping tokens.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model with byte
fallback that puts a space before a text; A gets that space from here. A's
character offsets and the spans in sentencepiece's result give coarse cuts: where
the next token starts no earlier than a token ends. Between two coarse cuts
(inside characters of several bytes, in runs of byte-fallback tokens) the decoded
bytes of the tokens give the ends. All ends together must spell the text.

Neither tokenizer joins characters across a space or line break that follows a
visible character, so a text's alignment is that of its parts. Distinct parts are
solved many at once, standing in one text; those met before are remembered.
Elsewhere (further white space, control characters) a part keeps what is around
and is solved by itself.

An id pair's count is the number of documents in which it is linked. Each
document keeps its distinct pairs and how often each is linked there; tasks sum
up documents before anything moves. The table of pairs, which the vocabularies
bound, is cut into slices of about ``SLICE`` pairs by A id, and each slice is
looked up by all documents in turn.

Defined results: null and empty texts, and texts that a tokenizer does not give
back byte for byte (U+2581 in B), have no tokens: zeros and an empty string.
Repeated rows count as documents of their own; an empty table gives no rows;
further columns are ignored. A text may be of any length; a run of visible
characters without any space is encoded in one piece, at some 200 bytes of memory
a character.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .packing import press, press_sorted, unpress, unpress_sorted
from .parts import Memory, Parts, groups
from .tokens import _DOUBT

#: Parts that a Python worker remembers, and that stand in one text when they are solved.
CACHE = 500_000
JOINED = 4000
#: Bytes of text that are aligned at once.
GROUP = 8 << 20
#: Pairs of one slice of the table; pairs that a task sums up before it passes them on.
SLICE = 4_000_000
SUMMED = 2_000_000

#: What may not stand on either side of a space at which a text is cut.
_BLANK = r"\x00-\x20\x7f-\xa0 ᠎ -‏ -  -⁯　﻿"
_CUT = re.compile(f"(?<=[^{_BLANK}]) (?=[^{_BLANK}])")
#: Marks a part that is solved by itself; no other part holds this character.
_ALONE = "\0"
#: Stands before the parts when they are solved, so that none is at the begin of the text.
_LEAD = "x"
_HEAD = struct.Struct("<IIIIII")


def byte_characters() -> dict[str, int]:
    """Byte of each character in entries of byte-level vocabularies: visible Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def token_ends(begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte offset where each token ends: its span's end if the span is not empty and the next token starts behind it, else by decoded sizes from the last such end."""
    coarse = (end > begin) & (np.append(begin[1:], end[-1:]) >= end)
    upto = np.cumsum(size)
    at = np.maximum.accumulate(np.where(coarse, np.arange(len(end)), -1))
    last = np.concatenate([[-1], at[:-1]]) if len(at) else at
    base = np.where(last >= 0, end[last] - upto[last], 0) if len(at) else upto
    return np.where(coarse, end, base + upto)


class Aligner:
    """Both tokenizers with their tables of decoded bytes and a memory of aligned parts."""

    _loaded: dict[tuple[str, str], Aligner] = {}

    def __init__(self, bpe_path: str, piece_path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(bpe_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        table, vocabulary = byte_characters(), self.a.get_vocab(with_added_tokens=True)
        entries = {i: bytes(table[c] for c in e) if all(c in table for c in e) else e.encode() for e, i in vocabulary.items()}
        self.a_bytes = [entries.get(i, b"") for i in range(max(vocabulary.values()) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError(f"{piece_path} has pieces that run across spaces or line breaks")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.na, self.nb = len(self.a_bytes), len(self.b_bytes)
        # an id with the mark behind it: A within a group, A last of its group, B within, B last
        self.marked = pa.array([f"{i}{m}" for n, marks in ((self.na, ",|"), (self.nb, ",;")) for m in marks for i in range(n)], pa.large_string())
        self.known = Memory(CACHE)

    @classmethod
    def load(cls, bpe_path: str, piece_path: str) -> Aligner:
        key = (bpe_path, piece_path)
        if key not in cls._loaded:
            cls._loaded[key] = cls(*key)
        return cls._loaded[key]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(A's ids, their ends in bytes, B's ids, their ends) of a text that begins with a space; None if a tokenizer does not give its bytes back."""
        raw = text.encode("utf-8")
        found = self.a.encode(text, add_special_tokens=False)
        a, span = np.array(found.ids, dtype=np.int64), np.array(found.offsets, dtype=np.int64).reshape(-1, 2)
        if len(raw) != len(text):
            starts = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
            span = np.append(starts, len(raw))[span]
        pieces = [(p.id, p.begin, p.end) for p in self.b.encode(text[1:], return_type="proto").pieces]
        b, begin, end = np.array(pieces, dtype=np.int64).reshape(-1, 3).T
        ends_a = token_ends(span[:, 0], span[:, 1], self.a_size[a])
        ends_b = token_ends(np.where(begin > 0, begin + 1, 0), end + 1, self.b_size[b])
        for ids, ends, table, size in ((a, ends_a, self.a_bytes, self.a_size), (b, ends_b, self.b_bytes, self.b_size)):
            if b"".join(map(table.__getitem__, ids.tolist())) != raw or not np.array_equal(np.diff(ends, prepend=0), size[ids]):
                return None
        return a, ends_a, b, ends_b

    def solve(self, parts: list[str]) -> list[bytes]:
        """A record of each part: sound or not, tokens of A and of B, groups, links, length of the groups' text; the links' id pairs; the text."""
        out: list[bytes] = [b""] * len(parts)
        alone = [k for k, p in enumerate(parts) if p[:1] == _ALONE or p.strip("\n") == ""]
        joined = [k for k in range(len(parts)) if k not in set(alone)] if alone else list(range(len(parts)))
        for some in [*(joined[i : i + JOINED] for i in range(0, len(joined), JOINED)), *([k] for k in alone)]:
            for k, record in zip(some, self._solve([parts[k] for k in some]), strict=True):
                out[k] = record
        return out

    def _solve(self, parts: list[str]) -> list[bytes]:
        # a part follows a space, unless a line break begins it
        whole = [" " + p.removeprefix(_ALONE) if p[:1] != "\n" else p for p in parts]
        found = self.tokens(" " + _LEAD + "".join(whole))
        if found is None:
            return [_HEAD.pack(0, 0, 0, 0, 0, 0)] if len(parts) == 1 else [r for p in parts for r in self._solve([p])]
        a, ea, b, eb = found
        lead = 1 + len(_LEAD)
        ends = lead + np.cumsum([len(w.encode("utf-8")) for w in whole])
        edges = np.append(lead, ends)
        in_a, in_b = np.searchsorted(ea, edges), np.searchsorted(eb, edges)
        if not (np.array_equal(ea[in_a], edges) and np.array_equal(eb[in_b], edges)):
            raise ValueError("a token runs across the edge of a part")
        a, ea, b, eb = a[in_a[0] + 1 :], ea[in_a[0] + 1 :], b[in_b[0] + 1 :], eb[in_b[0] + 1 :]
        both = np.intersect1d(ea, eb, assume_unique=True)
        each = np.union1d(ea, eb)  # every stretch between two ends is one link
        keys = (a[np.searchsorted(ea, each)] << 32 | b[np.searchsorted(eb, each)]).astype("<u8")
        ga, gb = np.searchsorted(both, ea), np.searchsorted(both, eb)
        spelt = np.concatenate([a + self.na * (both[ga] == ea), 2 * self.na + b + self.nb * (both[gb] == eb)])
        text = self.marked.take(pa.array(spelt[np.argsort(np.concatenate([2 * ga, 2 * gb + 1]), kind="stable")]))
        place = np.frombuffer(text.buffers()[1], dtype="<i8", count=len(text) + 1)
        data = memoryview(text.buffers()[2])
        n_a, n_b, n_both, n_each = (np.searchsorted(x, edges, side="right") for x in (ea, eb, both, each))
        upto, raw = place[n_a + n_b].tolist(), memoryview(keys.tobytes())
        counts = [np.diff(x).tolist() for x in (n_a, n_b, n_both, n_each)]
        out = []
        for k, (x, y, g, n) in enumerate(zip(*counts, strict=True)):
            t0, t1, l0 = upto[k], upto[k + 1], int(n_each[k])
            out.append(b"".join((_HEAD.pack(1, x, y, g, n, t1 - t0), raw[8 * l0 : 8 * (l0 + n)], data[t0:t1], b"\0" * (-(t1 - t0) % 8))))
        return out

    def align(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, list[str], list[bytes], list[bytes]]]:
        """Groups of texts, in order: (counts: a row a text of tokens of A and B, groups and links; hash of the groups; packed id pairs; packed number of links of each pair)."""
        doubt = pc.fill_null(pc.match_substring_regex(texts, _DOUBT), False)
        for lo, hi in groups(texts, GROUP):
            some, odd = texts.slice(lo, hi - lo), np.flatnonzero(doubt.slice(lo, hi - lo).to_numpy(zero_copy_only=False))
            cut_ = Parts(pc.if_else(doubt.slice(lo, hi - lo), "", some) if len(odd) else some)
            of, at, distinct = cut_.of.astype(np.int64), cut_.at, cut_.distinct
            if len(odd):  # these are cut by a pattern; a part with other blanks is solved by itself
                own = {int(k): [p if not re.search(f"[{_BLANK}]", p) and p else _ALONE + p for p in _CUT.split(t)] for k, t in zip(odd, some.take(pa.array(odd)).to_pylist(), strict=True)}
                number = {p: k for k, p in enumerate(distinct)}
                coded = {k: np.array([number.setdefault(p, len(number)) for p in ps]) for k, ps in own.items()}
                of = np.concatenate([coded.get(k, of[x:y]) for k, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True))])
                at = np.concatenate([[0], np.cumsum([len(coded[k]) if k in coded else y - x for k, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True))])])
                distinct = list(number)
            empty = pc.equal(pc.fill_null(pc.binary_length(some), 0), 0).to_numpy(zero_copy_only=False)
            yield self._gather(self.known.learn(distinct, self.solve), of, at, empty)

    def _gather(self, records: list[bytes], of: np.ndarray, at: np.ndarray, empty: np.ndarray):
        words = np.frombuffer(b"".join(records), dtype="<u8")
        starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, records), np.int64, len(records)))[:-1] // 8])
        head = words[starts[:, None] + np.arange(3)].view("<u4").astype(np.int64)
        n_links, n_text = head[:, 4], head[:, 5]

        def taken(begin: np.ndarray, size: np.ndarray, source: np.ndarray, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
            """What each part has at its place, for each text: (one after the other, offset of each text)."""
            offsets = np.concatenate([[0], np.cumsum(size)])
            values = source[np.repeat(begin - offsets[:-1], size) + np.arange(offsets[-1])]
            lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(values, kind)).take(pa.array(of))
            return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size[of])])[at]

        counts = np.stack([(c := np.concatenate([[0], np.cumsum(head[of, k])]))[at[1:]] - c[at[:-1]] for k in range(6)], axis=1)
        sound = (counts[:, 0] == np.diff(at)) & ~empty
        counts = np.where(sound[:, None], counts, 0)[:, 1:5]
        text, text_at = taken(8 * (starts + 3 + n_links), n_text, words.view(np.uint8), pa.uint8())
        raw = memoryview(text)
        digest = [hashlib.sha256(raw[x : y - 1]).hexdigest() if s else "" for s, x, y in zip(sound.tolist(), text_at[:-1].tolist(), text_at[1:].tolist(), strict=True)]
        # links of all parts, as numbers in their order, so that pairs of a text sort as small integers
        offsets = np.concatenate([[0], np.cumsum(n_links)])
        pairs, code = np.unique(words[np.repeat(starts + 3 - offsets[:-1], n_links) + np.arange(offsets[-1])], return_inverse=True)
        codes, code_at = taken(offsets[:-1], n_links, code.astype(np.int64), pa.int64())
        both = np.repeat(np.arange(len(at) - 1), np.diff(code_at)) << 32 | codes
        if not sound.all():
            both = both[sound[both >> 32]]
        both, times = np.unique(both, return_counts=True)
        edge = np.searchsorted(both >> 32, np.arange(len(at))).tolist()
        keys, times = pairs[both & 0xFFFFFFFF] if len(both) else np.zeros(0, np.uint64), times.astype("<u4")
        links = [press_sorted(keys[x:y]) if y > x else b"" for x, y in zip(edge[:-1], edge[1:], strict=True)]
        return counts, digest, links, [press(times[x:y]) if y > x else b"" for x, y in zip(edge[:-1], edge[1:], strict=True)]


def align_texts(docs: DataFrame, bpe_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and, packed, the distinct id pairs of every document and how often each is linked."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.load(bpe_path, piece_path)
        for batch in batches:
            done = 0
            for counts, digest, pairs, times in aligner.align(batch.column(1).cast(pa.string())):
                columns = [batch.column(0).slice(done, len(digest)), *(pa.array(c) for c in counts.T), pa.array(digest, pa.string()), pa.array(pairs, pa.binary()), pa.array(times, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                done += len(digest)

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b and n_docs: the documents in which an id pair is linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, new, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def add() -> None:
            nonlocal keys, sums, new, waiting
            keys, place = np.unique(np.concatenate([keys, *new]), return_inverse=True)
            sums = np.bincount(place, np.concatenate([sums, np.ones(waiting)]), len(keys)).astype(np.int64)
            new, waiting = [], 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(32)).astype(np.int32)), pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(sums)], names=["a", "b", "n"])

        for batch in batches:
            for packed in batch.column(0).to_pylist():
                if packed:
                    new.append(unpress_sorted(packed))
                    waiting += len(new[-1])
                    if waiting > SUMMED:
                        add()
                        if len(keys) > SUMMED:
                            yield emit()
                            keys, sums = keys[:0], sums[:0]
        add()
        if len(keys):
            yield emit()

    return aligned.select("pairs").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n_docs"))


def add_counts(aligned: DataFrame, counts: DataFrame, slice_pairs: int = SLICE) -> DataFrame:
    """``aligned`` with n_best and count_sum instead of its packed columns. The table of pairs is looked up slice by slice; all pairs of an A id are in one slice."""
    spark, schema = aligned.sparkSession, aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")}).schema
    n_slices = max(1, -(-counts.count() // slice_pairs))
    done = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})

    def with_slice(frame: DataFrame, k: int) -> DataFrame:
        part = counts.where(F.pmod(F.xxhash64("a"), F.lit(n_slices)) == k).toArrow()  # as many rows as a slice holds
        a, b, n = (part[c].to_numpy().astype(np.int64) for c in ("a", "b", "n_docs"))
        keys = (a << 32 | b).astype(np.uint64)
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        heads = np.flatnonzero(np.diff((keys >> np.uint64(32)).astype(np.int64), prepend=-1))
        best = n == np.repeat(np.maximum.reduceat(n, heads), np.diff(np.append(heads, len(n)))) if len(n) else np.zeros(0, bool)
        table = spark.sparkContext.broadcast((keys, n, best))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, docs, top = table.value
            for batch in batches:
                columns, sums = {f: batch.column(f) for f in batch.schema.names}, np.zeros((batch.num_rows, 2), dtype=np.int64)
                for row, (pairs, times) in enumerate(zip(columns["pairs"].to_pylist(), columns["times"].to_pylist(), strict=True)):
                    if pairs and len(known):
                        wanted, often = unpress_sorted(pairs), unpress(times, "<u4").astype(np.int64)
                        place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                        often = np.where(known[place] == wanted, often, 0)
                        sums[row] = often @ top[place], often @ docs[place]
                for k, name in enumerate(("n_best", "count_sum")):
                    columns[name] = pa.array(columns[name].to_numpy(zero_copy_only=False) + sums[:, k])
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        return frame.mapInArrow(run, schema)

    for k in range(n_slices):
        done = with_slice(done, k)
        if k + 1 < n_slices:
            done = cut(done)
    return done.drop("pairs", "times")


def alignment(docs: DataFrame, bpe_path: str, piece_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of every document."""
    aligned = cut(align_texts(docs, bpe_path, piece_path))
    return add_counts(aligned, cut(pair_counts(aligned)))
