"""What a Python worker of the language model holds per entry."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd

from lumenfold.llm import language_model


def test_answers_hold_few_bytes_an_entry():
    rng = np.random.default_rng(3)
    n, blocks = 40_000, 10
    pool = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
    rows = []
    for block in range(blocks):
        hashes = np.sort(rng.choice(pool, n, replace=False))
        counts = np.stack([rng.integers(0, 9, n), rng.integers(0, 3, n), rng.integers(0, 900, n) * 64 + 5], axis=1)
        rows += language_model._requests(block, hashes, counts, 1)
    pdf = pd.DataFrame(rows, columns=["bucket", "block", "hashes", "counts"])
    tracemalloc.start()
    out = language_model.answer_pairs(pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out[out["kind"] == "q"]) == blocks
    assert peak < 90 * n * blocks


def test_sums_and_distinct_are_exact():
    where = np.array([2, 0, 2, 2], dtype=np.int32)
    assert language_model._sums(where, np.array([2**32 - 1, 7, 2**32 - 1, 1], dtype=np.uint32)).tolist() == [7, 0, 2**33 - 1]
    assert language_model._sums(where[:0], where[:0]).tolist() == []
    values, spot = language_model.distinct(np.array([9, 4, 9, 5], dtype=np.uint64))
    assert values.tolist() == [4, 5, 9] and spot.tolist() == [2, 0, 2, 1]


def test_pack_holds_numbers_and_not_words():
    docs = lambda: ((d, [b"word%d" % (k % 50) for k in range(1000)]) for d in range(300))
    tracemalloc.start()
    blob = language_model.Block.pack(docs())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    block = language_model.Block.unpack(blob)
    assert block.ids == list(range(300)) and len(block.tokens) == 300_000 and len(block.hashes) == 50
    assert peak < 25 * len(block.tokens)
