"""SentencePiece encoding and decoding as shortest paths in a weighted transducer.

A model file is compiled to three machines. The normaliser is a sequential
transducer: a trie of rewrite rules, longest match first, and behind it the
white space machine with the states start, body and gap. The pieces are a table
of arcs (node, character) -> node whose final nodes emit a piece at the weight of
its negative score. Byte fallback gives every other character an arc that emits
its bytes.

A text's normal form is composed with the pieces into a lattice, whose
tropical-semiring shortest path gives the ids. No piece runs from a visible
character into a white space mark, so the lattice falls apart there. Distinct
parts are solved many at once, one array step per position and piece length.

For BPE models a lattice state also knows the piece it was reached by, and an arc
is there only if the merge order leaves the two neighbours apart. That is
compiled too: each piece has its last merge (left, right, rank), and each pair of
pieces the rank at which it would merge. Two neighbours stay apart if no pair on
the seam, while both exist, merges before one of them is used up. A
segmentation is what merging yields if and only if all its neighbours stay
apart, so one path is left.

Defined results: null and empty texts have no ids and decode to an empty text;
repeated rows get equal results; further columns are ignored by the query.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .parts import Memory, Parts, groups, put_together

MARK = "▁"
#: Lattice parts that a Python worker remembers; longer ones are solved by themselves and not remembered.
CACHE = 1_000_000
MAX_PART = 64
#: Parts that are solved at once.
SOLVE = 1 << 16

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_NEVER = np.int64(1 << 40)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def _rewrites(charsmap: bytes) -> dict[bytes, bytes]:
    """The normaliser's rules, read from its double-array trie."""
    if not charsmap:
        return {}
    size = struct.unpack_from("<I", charsmap)[0]
    units = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist()
    targets, rules = charsmap[4 + size :], {}

    def offset(u: int) -> int:
        return (u >> 10) << ((u & (1 << 9)) >> 6)

    stack = [(offset(units[0]), b"")]
    while stack:
        base, prefix = stack.pop()
        for c in range(1, 256):
            at = base ^ c
            if at >= len(units) or units[at] & 0x800000FF != c:
                continue
            unit, word = units[at], prefix + bytes([c])
            below = at ^ offset(unit)
            if unit >> 8 & 1:
                value = units[below] & 0x7FFFFFFF
                rules[word] = targets[value : targets.index(b"\0", value)]
            stack.append((below, word))
    return rules


class Normaliser:
    """Rewrite rules and white space rules as sequential transducers."""

    START, BODY, GAP = range(3)

    def __init__(self, rules: dict[bytes, bytes], dummy_prefix: bool, squeeze: bool, escape: bool) -> None:
        self.plain = not rules and not squeeze and dummy_prefix and escape
        self.arcs: list[dict[str, int]] = [{}]
        self.emits: list[str | None] = [None]
        for source, target in rules.items():
            node = 0
            for c in source.decode():
                if c not in self.arcs[node]:
                    self.arcs[node][c] = len(self.arcs)
                    self.arcs.append({})
                    self.emits.append(None)
                node = self.arcs[node][c]
            self.emits[node] = target.decode()
        mark = MARK if escape else " "
        first = mark if dummy_prefix else ""
        # white space: (state, is a space) -> (state, what it emits before the character, whether it emits the character)
        if squeeze:
            self.spaces = {(self.START, True): (self.START, "", False), (self.START, False): (self.BODY, first, True), (self.BODY, True): (self.GAP, "", False), (self.BODY, False): (self.BODY, "", True), (self.GAP, True): (self.GAP, "", False), (self.GAP, False): (self.BODY, mark, True)}
        else:
            self.spaces = {(self.START, True): (self.BODY, first + mark, False), (self.START, False): (self.BODY, first, True), (self.BODY, True): (self.BODY, mark, False), (self.BODY, False): (self.BODY, "", True)}

    def _rewritten(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            node, end, best, out = 0, at, at + 1, text[at]
            while end < len(text) and (node := self.arcs[node].get(text[end], 0)):
                end += 1
                if self.emits[node] is not None:
                    best, out = end, self.emits[node]
            yield from out
            at = best

    def __call__(self, text: str) -> str:
        if self.plain:  # the rewriting trie is empty, and white space has the one state body after the first arc
            return MARK + text.replace(" ", MARK) if text else ""
        state, out = self.START, []
        for c in self._rewritten(text):
            state, before, keep = self.spaces[state, c == " "]
            out.append(before + c if keep else before)
        return "".join(out)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of wanted values in sorted keys, and whether they are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


class Transducer:
    """A compiled model; ``load`` keeps one per path in a Python worker.

    Symbols are the pieces by id, then the characters that occur only inside pieces, then any other character as
    ``first_other`` plus its code point.
    """

    _loaded: dict[str, Transducer] = {}

    def __init__(self, model: bytes) -> None:
        pieces: list[tuple[str, float, int]] = []
        self.kind, norm = UNIGRAM, b""
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                norm = value
        if self.kind not in (UNIGRAM, BPE) or any(k in (USER_DEFINED, UNUSED) for _, _, k in pieces):
            raise ValueError("only unigram and BPE models without user-defined or unused pieces")
        flags = dict(_fields(norm))
        self.dummy_prefix, squeeze, escape = (bool(flags.get(k, 1)) for k in (3, 4, 5))
        self.normalise = Normaliser(_rewrites(flags.get(2, b"")), self.dummy_prefix, squeeze, escape)
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.score = {p: s for p, s, k in pieces if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.penalty = min(self.score.values(), default=0.0) - 10.0
        self.text = [p.replace(MARK, " ").encode() if k == NORMAL else bytes([int(p[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k == UNKNOWN else b"" for p, _, k in pieces]
        self.pieces_text = pa.array(self.text, pa.binary())
        crossing = any(MARK in p.lstrip(MARK) for p in self.ids)
        alone = "".join(c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in self.ids))
        self.parts = re.compile(rf"[{alone or MARK}]|{MARK}*[^{MARK}{alone}]+|{MARK}+") if not crossing else re.compile(r".+", re.S)
        #: Whether texts can be cut at spaces and line breaks before they are normalised.
        self.cuts = self.normalise.plain and not crossing and "\n" in alone
        self.known = Memory(CACHE)
        self._compile_arcs(len(pieces))
        if self.kind == BPE:
            self._compile_merges()

    @classmethod
    def load(cls, path: str) -> Transducer:
        if path not in cls._loaded:
            with open(path, "rb") as f:
                cls._loaded[path] = cls(f.read())
        return cls._loaded[path]

    def _compile_arcs(self, n: int) -> None:
        """The arc table of the pieces: sorted keys (node * characters + character) with their targets, and each node's piece."""
        chars = sorted({c for p in self.ids for c in p})
        self.char = np.zeros(max(map(ord, chars), default=0) + 2, dtype=np.int64)  # code point -> character number; 0: in no piece
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.chars = len(chars) + 1
        inner = [c for c in chars if c not in self.ids]
        self.symbol = dict(self.ids) | {c: n + k for k, c in enumerate(inner)}
        self.first_other = n + len(inner)
        self.names = {i: p for p, i in self.symbol.items()}
        self.single = np.full(self.chars, -1, dtype=np.int64)  # character number -> symbol
        self.single[1:] = [self.symbol[c] for c in chars]
        arcs: dict[int, int] = {}
        final = [-1]
        for p, i in self.ids.items():
            node = 0
            for c in p:
                key = node * self.chars + int(self.char[ord(c)])
                if key not in arcs:
                    arcs[key] = len(final)
                    final.append(-1)
                node = arcs[key]
            final[node] = i
        self.arc_keys = np.array(sorted(arcs) or [-1], dtype=np.int64)
        self.arc_to = np.array([arcs.get(int(k), 0) for k in self.arc_keys], dtype=np.int64)
        self.final = np.array(final, dtype=np.int64)
        self.longest = max(map(len, self.ids), default=1)
        self.weight = np.full(self.first_other, -self.penalty)
        self.weight[[self.ids[p] for p in self.score]] = [-s for s in self.score.values()]

    def _merge(self, symbols: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
        """Merging by rank, leftmost first, and the merges made: what the tables are compiled from."""
        symbols, made = list(symbols), []
        while True:
            best, where = None, -1
            for i in range(len(symbols) - 1):
                s = self.score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if best is None:
                return symbols, made
            made.append((symbols[where], symbols[where + 1]))
            symbols[where : where + 2] = [symbols[where] + symbols[where + 1]]

    def _compile_merges(self) -> None:
        """Rank, left and right part of each piece, and the ranks of all pairs that merge."""
        long = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.score[p])
        rank, often = {p: k for k, p in enumerate(long)}, Counter(self.score[p] for p in long)
        # between pieces of one score (runs of white space marks) places decide, not ranks: their seams are tried out
        self.tied = np.zeros(self.first_other, dtype=bool)
        self.rank = np.full(self.first_other, -1, dtype=np.int64)
        self.left, self.right = np.full(self.first_other, -1, dtype=np.int64), np.full(self.first_other, -1, dtype=np.int64)
        self.reached = np.ones(self.first_other, dtype=bool)  # some pieces are not what merging makes of their characters
        for p in long:
            i, (out, made) = self.ids[p], self._merge(list(p))
            self.rank[i] = rank[p]
            self.reached[i] = len(out) == 1
            if self.reached[i]:
                self.left[i], self.right[i] = (self.symbol[x] for x in made[-1])
                self.tied[i] = often[self.score[p]] > 1 or any(rank.get(x, -1) > rank[p] or self.tied[self.symbol[x]] for x in made[-1])
        pairs = {(self.symbol[p[:k]], self.symbol[p[k:]]): rank[p] for p in long for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol}
        keys = np.array([a * self.first_other + b for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = (keys[order], np.array(list(pairs.values()), dtype=np.int64)[order]) if len(keys) else (np.array([-1]), np.array([_NEVER]))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves neighbours a and b apart; a is -1 at the beginning.

        The last merges on both sides of the seam are undone one by one, the latest first. A pair that is there at
        some time must not merge before the next merge on either side, at equal rank not before that on its right.
        """
        out = np.zeros(len(a), dtype=bool)
        fine = (b >= self.first_other) | self.reached[np.minimum(b, self.first_other - 1)]
        known = fine & (a >= 0) & (a < self.first_other) & (b < self.first_other)
        out[fine & ~known] = True
        tied = known & (self.tied[np.where(known, a, 0)] | self.tied[np.where(known, b, 0)])
        for k in np.flatnonzero(tied).tolist():
            two = [self.names[int(a[k])], self.names[int(b[k])]]
            out[k] = self._merge(list("".join(two)))[0] == two
        at = np.flatnonzero(known & ~tied)
        x, y = a[at], b[at]
        until_x, until_y = np.full(len(at), _NEVER), np.full(len(at), _NEVER)
        while len(at):
            k, there = _lookup(self.pair_keys, x * self.first_other + y)
            r = np.where(there, self.pair_rank[k], _NEVER)
            joins = (r < until_x) & (r <= until_y)
            rx, ry = self.rank[x], self.rank[y]
            done = (rx < 0) & (ry < 0)
            out[at[done & ~joins]] = True
            go = ~joins & ~done
            at, x, y, rx, ry, until_x, until_y = (v[go] for v in (at, x, y, rx, ry, until_x, until_y))
            undo = rx > ry
            until_x, until_y = np.where(undo, rx, until_x), np.where(undo, until_y, ry)
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return out

    def _symbols(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character numbers of code points, and the symbol of each character by itself."""
        chars = self.char[np.minimum(points, len(self.char) - 1)]
        return chars, np.where(chars > 0, self.single[chars], self.first_other + points)

    def paths(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the shortest paths through the lattices of parts, one after the other, and how many each has."""
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        order = np.argsort(-lengths, kind="stable")  # the parts that are longer than a position come first
        points = np.frombuffer("\0".join([*(parts[k] for k in order), ""]).encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
        size = lengths[order]
        begin = np.cumsum(size + 1) - (size + 1)
        chars, single = self._symbols(points)
        chars[begin + size] = 0
        cost = np.full(len(points), np.inf)
        cost[begin] = 0.0
        symbol, back = np.full(len(points), -1, dtype=np.int64), np.zeros(len(points), dtype=np.int64)
        for at in range(int(size.max(initial=0))):
            here = begin[: int(np.searchsorted(-size, -at, side="left"))] + at
            source, target, made = [here], [here + 1], [single[here]]  # the arc of the character by itself, or byte fallback
            alive, node = here, np.zeros(len(here), dtype=np.int64)
            for k in range(self.longest):
                c = chars[alive + k]
                spot, there = _lookup(self.arc_keys, node * self.chars + c)
                there &= c > 0
                alive, node = alive[there], self.arc_to[spot[there]]
                if not len(alive):
                    break
                piece = self.final[node]
                if k:
                    full = piece >= 0
                    source.append(alive[full])
                    target.append(alive[full] + (k + 1))
                    made.append(piece[full])
            source, target, made = np.concatenate(source), np.concatenate(target), np.concatenate(made)
            if self.kind == BPE:
                before = symbol[source]
                keys, spot = np.unique((before + 1) * (self.first_other + 0x110000) + made, return_inverse=True)
                open_ = self.apart(keys // (self.first_other + 0x110000) - 1, keys % (self.first_other + 0x110000))[spot]
                source, target, made = source[open_], target[open_], made[open_]
            weight = cost[source] + np.where(made < self.first_other, self.weight[np.minimum(made, self.first_other - 1)], -self.penalty)
            less = weight < cost[target]
            target = target[less]
            cost[target], symbol[target], back[target] = weight[less], made[less], source[less]
        step, who, cursor = [], [], begin + size
        rows = np.arange(len(parts))
        while len(rows):
            live = cursor > begin[rows]
            rows, cursor = rows[live], cursor[live]
            step.append(symbol[cursor])
            who.append(order[rows])
            cursor = back[cursor]
        who, step = np.concatenate(who), np.concatenate(step)
        last_first = np.argsort(who, kind="stable")  # per part from its end to its begin
        counts = np.bincount(who, minlength=len(parts))
        ends = np.cumsum(counts)
        path = step[last_first]
        return path[np.repeat(ends - 1 + (ends - counts), counts) - np.arange(len(path))], counts

    def shortest_path(self, part: str) -> list[str]:
        """Pieces (or fallback characters) of the path of least weight through one lattice."""
        return [self.names[i] if i < self.first_other else chr(i - self.first_other) for i in self.paths([part])[0].tolist()]

    def _emit(self, symbols: list[int]) -> bytes:
        """Ids of a path that takes byte fallback; characters that have no bytes either give one unknown id a run."""
        ids: list[int] = []
        n = len(self.text)
        for i in symbols:
            if i < n:
                ids.append(i)
            elif self.bytes:
                ids.extend(self.bytes[b] for b in (self.names[i] if i < self.first_other else chr(i - self.first_other)).encode("utf-8", "replace"))
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return np.array(ids, dtype="<u4").tobytes()

    def solve(self, parts: list[str]) -> list[bytes]:
        """Ids of lattice parts as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for at in range(0, len(parts), SOLVE):
            some = parts[at : at + SOLVE]
            path, counts = self.paths(some)
            data, ends = path.astype("<u4").tobytes(), np.cumsum(counts) * 4
            falls = np.zeros(len(some), dtype=bool)
            falls[np.repeat(np.arange(len(some)), counts)[path >= len(self.text)]] = True
            out += [data[b:e] for b, e in zip((ends - 4 * counts).tolist(), ends.tolist(), strict=True)]
            for k in np.flatnonzero(falls).tolist():
                out[at + k] = self._emit(path[ends[k] // 4 - counts[k] : ends[k] // 4].tolist())
        return out

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, through its normal form."""
        cut = [self.parts.findall(self.normalise(t)) if t else [] for t in texts]
        distinct = list({p for parts in cut for p in parts})
        known = dict(zip(short := [p for p in distinct if len(p) <= MAX_PART], self.known.learn(short, self.solve), strict=True))
        known.update((p, self.solve([p])[0]) for p in distinct if len(p) > MAX_PART)
        return [b"".join(map(known.__getitem__, parts)) for parts in cut]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_texts([text])[0]

    def encode_array(self, texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Groups of the texts, in order: (texts, their ids one after the other, offset of each text in them)."""
        doubt = pc.fill_null(pc.match_substring_regex(texts, "^ |  | \n"), True) if self.cuts else pa.array([True] * len(texts))
        for a, b in groups(texts):
            some, odd = texts.slice(a, b - a), np.flatnonzero(doubt.slice(a, b - a).to_numpy(zero_copy_only=False))
            cut = Parts(pc.if_else(doubt.slice(a, b - a), "", some) if len(odd) else some)
            # a part follows a space, or the mark that begins a text, unless a line break begins it
            whole = [p if p[:1] == "\n" else MARK + p for p in cut.distinct]
            long = {k for k, p in enumerate(whole) if len(p) > MAX_PART}
            learnt = iter(self.known.learn([p for k, p in enumerate(whole) if k not in long], self.solve))
            ids = [self.solve([p])[0] if k in long else next(learnt) for k, p in enumerate(whole)]
            of, at = cut.of, cut.at
            empty = np.flatnonzero(pc.equal(pc.fill_null(pc.binary_length(some), 0), 0).to_numpy(zero_copy_only=False))
            if len(odd) or len(empty):  # these texts stand as one part of their own
                special = np.union1d(odd, empty)
                of = of.copy()
                of[at[special]] = len(ids) + np.arange(len(special))
                ids += self.encode_texts(some.take(pa.array(special)).to_pylist())
            yield (some, *put_together(ids, of, at))

    def decode_array(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all pieces one after the other, and the offset of each."""
        taken = self.pieces_text.take(pa.array(ids.view(np.int32)))
        _, offsets, data = taken.buffers()
        return memoryview(data or b""), np.frombuffer(offsets, dtype="<i4", count=len(ids) + 1)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that form no character become replacement characters."""
        text = b"".join(map(self.text.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def encode_column(model_path: str, text: str = "text"):
    """Column of ids (array of int)."""

    @pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        fst = Transducer.load(model_path)
        out = [ids[a:b].astype(np.int32) for _, ids, at in fst.encode_array(pa.array(texts, pa.string(), from_pandas=True)) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pd.Series(out, dtype=object)

    return encode(F.col(text))


def decode_column(model_path: str, ids: str = "ids"):
    """Column of texts; a null array decodes to an empty text."""

    @pandas_udf("string")
    def decode(arrays: pd.Series) -> pd.Series:
        fst = Transducer.load(model_path)
        return pd.Series([fst.decode(np.asarray([] if a is None else a, dtype="<u4").tobytes()) for a in arrays], dtype=object)

    return decode(F.col(ids))


def encode_report(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and round_trip (decoding gives the text back) of every document."""

    def report(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = Transducer.load(model_path)
        for batch in batches:
            done = 0
            for texts, ids, at in fst.encode_array(batch.column(1).cast(pa.string())):
                raw = memoryview(ids.tobytes())
                data, offsets = fst.decode_array(ids)
                begins, ends = at[:-1].tolist(), at[1:].tolist()
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins, ends, strict=True)]
                skip = int(fst.dummy_prefix)
                same = []
                for t, a, b in zip(texts.cast(pa.binary()).to_pylist(), offsets[at[:-1]].tolist(), offsets[at[1:]].tolist(), strict=True):
                    same.append(data[a + (skip and data[a : a + 1] == b" ") : b] == (t or b""))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(texts)), pa.array(at[1:] - at[:-1], pa.int64()), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "ids_crc32", "round_trip"])
                done += len(texts)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(report, f"doc_id {kind}, n_tokens long, ids_crc32 long, round_trip boolean")
