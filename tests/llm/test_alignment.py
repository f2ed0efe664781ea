"""Tokenizer alignment against a plain version: whole texts, token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import alignment

P = pytest.importorskip("public_tokenizers")
BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    None, "", " ", "\n", "a", " a", "a ", "a\n", "\na", "  a", "a  b", "a \n b", "a\nb", "a\n\nb", "a\tb c", "x y", "​", "ab▁cd", "▁", "日本語 テキスト", "naïve café — “quoted”", "😀 👩‍👩‍👧 é",
    "<|endoftext|> <s> </s> <0x41> <unk>", "it's we'll they're 's 've", "12 345 6789 3.14", "a\r\nb\rc", "\x00 \x01", "word " * 50, "x" * 3000, "語" * 500, "a\x85b c　d e", "end.\nNext line\nthird", "foo ﬁ ﷺ ½",
]


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    words = ["the", "thereof", "wh", "zqxj", "Ünder", "日本", "it's", "ab,", "x.y", "😀!"]
    prose = ["".join(rng.choice(words) + rng.choice([" "] * 8 + ["\n", "  ", " \n", "\n\n", "\t", " "]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return [(i, t, "en", "s", 1) for i, t in enumerate([*TEXTS, *prose, *prose[:5]])]


def plain(docs):
    """One text at a time, bytes of every token, all pairs by their ranges."""
    both = alignment.Aligner(BPE, PIECES)
    links, out = {}, {}
    for i, text, *_ in docs:
        raw = (" " + text).encode() if text else b""
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        ab, bb = [both.a_bytes[x] for x in a], [both.b_bytes[x] for x in b]
        if not text or b"".join(ab) != raw or b"".join(bb) != raw:
            links[i], out[i] = [], (0, 0, 0, 0, "")
            continue
        ea, eb = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        cuts = sorted(set(ea) & set(eb))
        groups = []
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append(",".join(str(x) for x, e in zip(a, ea) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(b, eb) if lo < e <= hi))
        ra, rb = list(zip([0, *ea], ea)), list(zip([0, *eb], eb))
        links[i] = [(x, y) for x, (p, q) in zip(a, ra) for y, (r, s) in zip(b, rb) if p < s and r < q]
        out[i] = (len(a), len(b), len(groups), len(links[i]), hashlib.sha256(";".join(groups).encode()).hexdigest())
    count = Counter(p for ls in links.values() for p in set(ls))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return {i: (*out[i], sum(count[p] == best[p[0]] for p in links[i]), sum(count[p] for p in links[i])) for i in out}


def found(frame):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in frame.collect()}


def test_equals_plain_version(spark, docs):
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3).withColumn("n_a", F.lit("clash")).withColumn("pairs", F.lit(1))
    want = plain(docs)
    assert sum(v[0] > 0 for v in want.values()) > 80 and want[17][0] == 0
    assert found(alignment.alignment(frame, BPE, PIECES)) == want


def test_slices_of_the_table(spark, docs):
    aligned = alignment.align_texts(spark.createDataFrame(docs, SCHEMA), BPE, PIECES)
    counts = alignment.pair_counts(aligned)
    got = found(alignment.add_counts(aligned, counts, slice_pairs=-(-counts.count() // 3)))
    assert got == plain(docs)


def test_long_text_and_long_word(docs):
    both = alignment.Aligner(BPE, PIECES)
    import pyarrow as pa

    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(300_000))
    counts, digests, pairs, times = zip(*both.align(pa.array([long, "z" * 100_000, "short one"])), strict=True)
    counts = np.concatenate(counts)
    whole = both.tokens(" " + long)
    assert counts[0].tolist()[:2] == [len(whole[0]), len(whole[2])]
    assert counts[0, 3] == len(np.union1d(whole[1], whole[3])) and counts[0, 2] == len(np.intersect1d(whole[1], whole[3]))
    assert (counts[1:, 0] > 0).all()


def test_token_ends_inside_characters():
    # two tokens of one three-byte character, an empty span, then a plain one
    ends = alignment.token_ends(np.array([0, 1, 1, 4]), np.array([1, 4, 4, 5]), np.array([1, 1, 2, 1]))
    assert ends.tolist() == [1, 2, 4, 5]
    assert alignment.token_ends(np.array([0, 0, 0, 3]), np.array([0, 0, 3, 4]), np.array([1, 1, 1, 1])).tolist() == [1, 2, 3, 4]


def test_empty_table(spark):
    assert alignment.alignment(spark.createDataFrame([], SCHEMA), BPE, PIECES).count() == 0
    got = alignment.alignment(spark.createDataFrame([(None, None, None, None, None)], SCHEMA), BPE, PIECES).collect()
    assert [tuple(r) for r in got] == [(None, 0, 0, 0, 0, "", 0, 0)]
