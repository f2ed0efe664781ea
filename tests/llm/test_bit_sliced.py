"""Bit-sliced top-k against all inner products."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.llm import bit_sliced

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=20, k=20, scale=64):
    """rows: (id, vector) that take part."""
    out = []
    ints = [np.floor(scale * np.array(v, dtype=np.float32).astype(np.float64)).astype(np.int64) for _, v in rows]
    for q, (i, v) in enumerate(rows):
        if i % every == 0:
            best = sorted((-int(ints[q] @ ints[c]), rows[c][0]) for c in range(len(rows)) if c != q and len(rows[c][1]) == len(v))[:k]
            out += [(i, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


def found(frame):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


def test_equals_all_products(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=16) * rng.choice([0.1, 1, 3])).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # a large group of equal vectors
    rows += [(2000 + i, [0.0] * 16) for i in range(30)] + [(-20, [1.0] * 16), (-3, [1.0] * 16), (40, rows[7][1]), (5000, [1.0, -2.0]), (5001, [3.0, 4.0])]
    odd = [(3000, None), (3001, [None] + [1.0] * 15), (3002, [float("nan")] * 16), (3003, [float("inf")] + [0.0] * 15), (None, [1.0] * 16), (3004, [1e30] + [0.0] * 15), (3005, [])]
    frame = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], SCHEMA).repartition(3).withColumn("rank", F.lit("x")).withColumn("score", F.lit(1))
    got = found(bit_sliced.top_k(frame, block=200, chunk=10))
    assert got == plain([(i, np.array(v)) for i, v in rows])
    assert found(bit_sliced.top_k(frame, k=3, every=7)) == plain([(i, v) for i, v in rows if i % 1 == 0], every=7, k=3)


def test_empty(spark):
    assert bit_sliced.top_k(spark.createDataFrame([], SCHEMA)).count() == 0
    assert bit_sliced.top_k(spark.createDataFrame([(20, [1.0], 0)], SCHEMA)).count() == 0
    assert found(bit_sliced.top_k(spark.createDataFrame([(20, [], 0), (1, [], 0)], SCHEMA))) == [(20, 1, 1, 0)]


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_slices_add_up(data):
    n, dim = data.draw(st.integers(1, 150)), data.draw(st.integers(1, 6))
    seed, wide, k = data.draw(st.integers(0, 10**6)), data.draw(st.sampled_from([1, 2, 40, 10**6])), data.draw(st.integers(1, 30))
    rng = np.random.default_rng(seed)
    vectors, queries = rng.integers(-wide, wide + 1, (n, dim)), rng.integers(-wide, wide + 1, (3, dim))
    low, first, slices = bit_sliced.slice_block(vectors)
    score = bit_sliced.add_slices(slices, first, queries)
    able = np.packbits(np.arange(slices.shape[1] * 64) < n, bitorder="little").view("<u8")
    bits = np.unpackbits(score.view(np.uint8), axis=2, bitorder="little")[:, :, :n].astype(object)
    value = sum((bits[:, w] << w for w in range(bits.shape[1])), np.zeros((3, n), dtype=object))
    want = queries @ vectors.T
    for q in range(3):
        assert len({int(v) - int(w) for v, w in zip(value[q], want[q], strict=True)}) == 1  # equal but for a constant
        rows = bit_sliced.first_rows(score[q : q + 1], able[None], k)[0]
        order = sorted(range(n), key=lambda r: (-want[q, r], r))[:k]
        assert sorted(rows.tolist()) == sorted(order)


@pytest.mark.parametrize("value", [0, 1, -1, 3, 7, -45, 1 << 20, 12345])
def test_digits(value):
    digits = bit_sliced.signed_digits(value)
    assert sum(s << k for k, s in digits) == value
    assert all(b[0] - a[0] > 1 for a, b in zip(digits, digits[1:], strict=False))
