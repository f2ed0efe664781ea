"""Compressed arrays and hash-bucket requests that blocks of documents exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def press(a: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unpress(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def entries(data: bytes, kind: str) -> int:
    """Number of integers in what ``press`` gave."""
    return zstandard.frame_content_size(data) // np.dtype(kind).itemsize


def press_sorted(h: np.ndarray) -> bytes:
    return press(np.diff(h, prepend=np.uint64(0)).astype("<u8"))


def unpress_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpress(data, "<u8"), dtype=np.uint64)


def bucket_ranges(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) over sorted hashes, for each bucket with entries."""
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[a]), a, b
