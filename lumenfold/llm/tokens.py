"""Token ids in seekable zstandard shards.

A shard file holds one independent zstandard frame per document (its ids as
little-endian unsigned 32-bit integers), then a skippable frame with the
document ids, then the seek table of the zstandard seekable format: compressed
size, content size and checksum (low 32 bits of XXH64) per frame, and a footer.
A reader finds the table from the end of the file and decompresses only the
frames that it wants.

Texts are dealt by ranges of (doc_id, content hash), so that a repeated or
missing doc_id is split like any other range. A task encodes its range and
streams frames to files of about ``SHARD_BYTES`` of text, each under a private
name that is changed when the file is complete: a task that runs again after a
lost executor replaces its files.

Defined results: null and empty texts give a document that holds only the end
id; repeated doc_ids stay separate documents, ordered by their content; rows
without a doc_id come first; an empty table gives no shard and no rows; further
columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shared_dir
from .parts import Memory, Parts, groups, put_together

END_ID = 2
#: Bytes of text aimed at per file.
SHARD_BYTES = 32 << 20
#: Files that a reading task opens one after the other; shards that are summed up together.
FILES_PER_TASK = 4
SHARD_BLOCK = 1024
#: Parts whose ids a Python worker remembers.
CACHE = 1_000_000
#: Words that are encoded in one text.
JOINED = 1000

_INDEX_MAGIC = 0x184D2A50
_TABLE_MAGIC = 0x184D2A5E
_SEEKABLE_MAGIC = 0x8F92EAB1
_CHECKSUMS = 0x80

#: Where a cut before a space or line break could be in doubt: such places in a row or at the begin, and all other
#: white space and control characters.
_DOUBT = r"^[ \n]|  | \n|\n |\n\n|[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"
#: A space or none and Latin letters: a pre-token of its own.
_WORD = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Stands before the first part of a text, which follows no space; no other part holds this character.
_FIRST = "\0"

#: The character by which a byte-level BPE writes each byte: printable ones themselves, the others from U+0100 on.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = [b for b in range(256) if b not in _PLAIN]
_BYTES = "".join(chr(b if b in _PLAIN else 256 + _OTHERS.index(b)) for b in range(256))

MANIFEST_SCHEMA = "shard long, file int, path string, n_docs long, n_tokens long"


class Encoder:
    """A byte-level BPE tokenizer with a memory of the parts it has met.

    A text is cut where a space or line break follows a visible character; no
    pre-token of a byte-level BPE crosses such a place, so the ids of the parts
    put together are the ids of the text. Other texts are encoded whole. Words
    of Latin letters are single pre-tokens; the library's model takes them as
    they are, if nothing in the tokenizer but its byte level comes before it.
    """

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model if self._plain() else None
        self.known = Memory(CACHE)
        self.line = self._ids("\n")
        self.marks = {c: self._ids(c) for c in ".,!?;:"}

    @classmethod
    def load(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _plain(self) -> bool:
        """Whether a text is only cut by the usual byte-level rule before the model sees it, and no added token is a word or part of one."""
        state = json.loads(self.tokenizer.to_str())
        cut = state["pre_tokenizer"] or {}
        rule = (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True)
        return rule and not state["normalizer"] and not state["post_processor"] and not any(_WORD.fullmatch(t["content"]) for t in state["added_tokens"])

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters, by the model alone."""
        tokenize, out = self.model.tokenize, []
        for w in words:
            spelled = w.replace(" ", _BYTES[32]) if w.isascii() else w.encode().decode("latin-1").translate(_BYTES)
            out.append(array("I", [t.id for t in tokenize(spelled)]).tobytes())
        return out

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words without line breaks: many are encoded in one text, a line break between each two."""
        out: dict[int, bytes] = {}
        if self.model is not None:
            letters = [k for k, w in enumerate(words) if _WORD.fullmatch(w)]
            out.update(zip(letters, self._letters([words[k] for k in letters]), strict=True))
        plain = [k for k, w in enumerate(words) if k not in out and w and "<|" not in w]
        for at in range(0, len(plain), JOINED):
            some = plain[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words[k] for k in some)], add_special_tokens=False)[0].ids, dtype="<u4")
            breaks = np.flatnonzero(ids == np.frombuffer(self.line, dtype="<u4")[0]) if len(self.line) == 4 else np.zeros(0, np.int64)
            if len(breaks) == len(some) - 1:
                data = ids.tobytes()
                out.update((k, data[a:b]) for k, a, b in zip(some, [0, *(4 * breaks + 4).tolist()], [*(4 * breaks).tolist(), len(data)], strict=True))
        return [out[k] if k in out else self._ids(w) for k, w in enumerate(words)]

    def solve(self, parts: list[str]) -> list[bytes]:
        """Ids of parts. A line break at its begin, letters, and a mark after letters are pre-tokens of their own."""
        lead = [p[:1] == "\n" for p in parts]
        words = [p[1:] if p[:1] in ("\n", _FIRST) else " " + p for p in parts]
        marked = [w[-1:] in self.marks and w[:-1].removeprefix(" ").isalpha() for w in words]
        bare = [w[:-1] if m else w for w, m in zip(words, marked, strict=True)]
        distinct = list(set(bare))
        ids = dict(zip(distinct, self._words(distinct), strict=True))
        return [(self.line if n else b"") + ids[b] + (self.marks[w[-1]] if m else b"") for n, b, w, m in zip(lead, bare, words, marked, strict=True)]

    def encode_array(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Groups of the texts, in order: (their ids one after the other, offset of each text in them)."""
        doubt = pc.fill_null(pc.match_substring_regex(texts, _DOUBT), False)
        for a, b in groups(texts):
            some, odd = texts.slice(a, b - a), np.flatnonzero(doubt.slice(a, b - a).to_numpy(zero_copy_only=False))
            cut = Parts(pc.if_else(doubt.slice(a, b - a), "", some) if len(odd) else some)
            firsts, spot = np.unique(cut.of[cut.at[:-1]], return_inverse=True)
            ids = self.known.learn([*cut.distinct, *(_FIRST + cut.distinct[k] for k in firsts.tolist())], self.solve)
            of = cut.of.copy()
            of[cut.at[:-1]] = len(cut.distinct) + spot
            of[cut.at[odd]] = len(ids) + np.arange(len(odd))
            ids += [self._ids(t) for t in some.take(pa.array(odd)).to_pylist()]
            yield put_together(ids, of, cut.at)

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """For each text all its ids and the end id, little-endian unsigned 32-bit."""
        end = struct.pack("<I", END_ID)
        for ids, at in self.encode_array(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
            for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield ids[x:y].tobytes() + end


class ShardWriter:
    """Writes one shard file frame by frame."""

    def __init__(self, folder: str, shard: int, file: int) -> None:
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        name = f"shard-{shard:08d}-{file:04d}.zst"
        self.path, self.uri = f"{base}/{name}", f"{folder}/{name}"
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.part)
        self.docs: list[int] = []
        self.table: list[bytes] = []
        self.tokens = 0

    def add(self, doc: int | None, frame: bytes, n_bytes: int, checksum: int) -> None:
        self.out.write(frame)
        self.docs.append(-(2**63) if doc is None else doc)
        self.table.append(struct.pack("<III", len(frame), n_bytes, checksum))
        self.tokens += n_bytes // 4

    def close(self) -> None:
        ids = np.array(self.docs, dtype="<i8").tobytes()
        self.out.write(struct.pack("<II", _INDEX_MAGIC, len(ids)) + ids)
        table = self.table + [struct.pack("<III", len(ids) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        footer = struct.pack("<IBI", len(table), _CHECKSUMS, _SEEKABLE_MAGIC)
        body = b"".join(table) + footer
        self.out.write(struct.pack("<II", _TABLE_MAGIC, len(body)) + body)
        self.out.close()
        self.fs.move(self.part, self.path)


class ShardReader:
    """Random access to the documents of one shard file."""

    def __init__(self, uri: str) -> None:
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != _SEEKABLE_MAGIC or not flags & _CHECKSUMS:
            raise ValueError(f"{uri} has no seek table with checksums")
        table = np.frombuffer(self._at(size - 9 - 12 * count, 12 * count), dtype="<u4").reshape(count, 3).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.docs = np.frombuffer(self._at(int(starts[-2]) + 8, int(table[-1, 0]) - 8), dtype="<i8")
        self.starts, self.table = starts[: count - 1], table[: count - 1]
        self.unpress = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def ids(self, k: int) -> bytes:
        """The ids of the k-th document; only its frame is read and its checksum is verified."""
        size, n_bytes, checksum = (int(x) for x in self.table[k])
        data = self.unpress.decompress(self._at(int(self.starts[k]), size), max_output_size=n_bytes)
        if len(data) != n_bytes or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return data

    def find(self, doc_id: int) -> list[int]:
        """Positions of a doc_id."""
        return np.flatnonzero(self.docs == doc_id).tolist()


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str) -> DataFrame:
    """Writes all documents to files below ``folder`` and returns the manifest: shard, file, path, n_docs, n_tokens."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("b")).first()["b"] or 0

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = Encoder.load(tokenizer_path), zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        shard, made = TaskContext.get().partitionId(), []
        writer, room = None, 0

        def close() -> None:
            writer.close()
            made.append((shard, len(made), writer.uri, len(writer.docs), writer.tokens))

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).cast(pa.string())), strict=True):
                if writer is None:
                    writer, room = ShardWriter(folder, shard, len(made)), SHARD_BYTES
                writer.add(doc, press.compress(data), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF)
                room -= len(data)
                if room <= 0:
                    close()
                    writer = None
        if writer:
            close()
        if made:
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=["shard", "file", "path", "n_docs", "n_tokens"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    dealt = keyed.repartitionByRange(max(1, -(-int(size) // SHARD_BYTES)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return cut(dealt.select("doc_id", "text").mapInArrow(write, MANIFEST_SCHEMA))


def first_tokens(manifest: DataFrame) -> DataFrame:
    """(path, first) of every file: the ids of all files before it. Shards are summed up in blocks, so no task holds all files."""
    block = F.floor(F.col("shard") / SHARD_BLOCK)
    m = manifest.select(block.alias("block"), "shard", "file", "path", "n_tokens")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = m.groupBy("block").agg(F.sum("n_tokens").alias("n_tokens"))
    sums = sums.select("block", before(Window.orderBy("block")).alias("base"))
    return m.select("block", "path", before(Window.partitionBy("block").orderBy("shard", "file")).alias("n")).join(sums, "block").select("path", (F.col("base") + F.col("n")).alias("first"))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files. ``start`` counts all earlier ids."""

    def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, first in zip(pdf["path"], pdf["first"], strict=True):
                shard, at, rows = ShardReader(path), int(first), []
                for k, doc in enumerate(shard.docs.tolist()):
                    data = shard.ids(k)
                    rows.append((None if doc == -(2**63) else doc, at, len(data) // 4, zlib.crc32(data)))
                    at += len(data) // 4
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    files = max(1, -(-manifest.count() // FILES_PER_TASK))
    return first_tokens(manifest).repartition(files).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the asked documents; other frames are not decompressed."""
    wanted = sorted(set(doc_ids))

    def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path in pdf["path"]:
                shard = ShardReader(path)
                for doc in wanted:
                    for k in shard.find(doc):
                        yield pd.DataFrame({"doc_id": [doc], "ids": [np.frombuffer(shard.ids(k), dtype="<u4").astype(np.int64).tolist()]})

    return manifest.select("path").repartition(max(1, -(-manifest.count() // FILES_PER_TASK))).mapInPandas(read, "doc_id long, ids array<long>")


def token_index(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes all documents to a new folder in the shared one and returns their index as read back from the files."""
    return read_shards(write_shards(docs, tokenizer_path, shared_dir(docs.sparkSession)))
