"""Texts cut at spaces and before line breaks, by Arrow kernels, and ids put together from the parts.

The tokenizers here never join characters across such a place, so a text's ids
are the ids of its parts. Distinct parts are found per group of texts; the ids
of those met before are remembered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters of text that are cut at a time.
GROUP_CHARS = 8 << 20


def groups(texts: pa.Array, most: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of texts with about ``most`` bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        yield at, max(upto, at + 1)
        at = max(upto, at + 1)


class Parts:
    """The parts of a group of texts: ``of`` numbers each one's distinct part, text k has those from ``at[k]`` to ``at[k + 1]``."""

    def __init__(self, texts: pa.Array) -> None:
        cut = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " \n"), " ")
        coded = cut.flatten().dictionary_encode()
        at = cut.offsets.to_numpy()
        self.at = (at - at[0]).astype(np.int64)
        self.of = coded.indices.to_numpy()
        self.distinct: list[str] = coded.dictionary.to_pylist()


class Memory:
    """Ids (little-endian unsigned 32-bit bytes) of some ``most`` parts, in two halves: when the younger one is full, the
    older one is forgotten, and what is met again moves to the younger one. So frequent parts stay.
    """

    def __init__(self, most: int) -> None:
        self.half = most // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, wanted: list[str], solve: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of the distinct parts ``wanted``; those that are not known are solved together."""
        out = list(map(self.young.get, wanted))
        missing = [k for k, ids in enumerate(out) if ids is None]
        if missing:
            parts = [wanted[k] for k in missing]
            found = list(map(self.old.get, parts))
            new = [p for p, ids in zip(parts, found, strict=True) if ids is None]
            solved = iter(solve(new) if new else ())
            ids = [x if x is not None else next(solved) for x in found]
            if len(self.young) + len(parts) > self.half:
                self.old, self.young = self.young, {}
            self.young.update(zip(parts, ids, strict=True))
            for k, x in zip(missing, ids, strict=True):
                out[k] = x
        return out


def put_together(ids: list[bytes], of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all ids one after the other, offset of each text in them) of texts whose parts have the given ids."""
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    values = pa.py_buffer(b"".join(ids))
    lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ids) + 1, [None, pa.py_buffer(offsets)]), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, values]))
    ends = np.zeros(len(of) + 1, dtype=np.int64)
    np.cumsum(sizes[of], out=ends[1:])
    return lists.take(pa.array(of)).flatten().to_numpy().view(np.uint32), ends[at]
