"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import resampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def grams(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain(docs, target, buckets, n, min_words, percent, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in texts for g in grams(x, n)) for texts in ([d[1] for d in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for d in docs:
        g = grams(d[1], n)
        h = int(hashlib.sha256(f"{seed}:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in g)
        out.append([d[0], len(words(d[1])), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[3], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)] + ["Ünder", "日本", "naïve", "A1", "zZ"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    odd = [None, "", " \n", "!!", "\x00a\x7fb", "x" * 2000 + " y", "É" * 700, "one\ttwo\x1cthree", "A-Z a_z 0/9"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([*texts, *odd])]
    return [*rows, *rows[:3], (None, texts[0], None, None, None)]


@pytest.mark.parametrize(("buckets", "n", "min_words", "percent"), [(10_000, 1, 20, 10), (97, 2, 5, 50), (7, 3, 0, 100)])
def test_equals_plain_version(spark, docs, monkeypatch, buckets, n, min_words, percent):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 50)  # several ranges
    target = ["w1 w2 w3 日本", "W1 w199", None, ""]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(4).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1))
    got = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), buckets, n, min_words=min_words, percent=percent)
    rows = [(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    assert sorted(rows, key=repr) == plain(docs, target, buckets, n, min_words, percent)


def test_crcs_of_all_lengths():
    rng = np.random.default_rng(1)
    sizes = np.concatenate([np.arange(0, 40), rng.integers(0, 30, 500), [511, 512, 513, 5000]])
    data = rng.integers(0, 256, int(sizes.sum()), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    want = [zlib.crc32(data[a : a + n]) for a, n in zip(starts, sizes, strict=True)]
    assert resampling.crc32_all(data, starts, sizes).tolist() == want


def test_empty_tables(spark, docs):
    none, texts = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert resampling.resample(none, texts).count() == 0
    got = resampling.resample(spark.createDataFrame(docs, SCHEMA), texts)
    rows = [(r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    assert sorted(rows, key=repr) == plain(docs, [], 10_000, 1, 20, 10)
