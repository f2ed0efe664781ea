"""Near copies against brute force over all pairs."""

import random

import pandas as pd
import pytest
from test_operators import DOCS, ODD, frame

from lumenfold.llm import near_copies

pipeline = pytest.importorskip("corpus_pipeline")


def brute_firsts(rows):
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for d, t, *_ in rows}
    root = {d: d for d in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in ids if find(d) == d}


@pytest.mark.parametrize("most", [16, 2, 1])
def test_near_copies(spark, monkeypatch, most):
    monkeypatch.setattr(near_copies, "MAX_BUCKET", most)
    rng = random.Random(21)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows = []
    for i in range(240):
        if i % 4:  # up to 6 changed words of a text of 40 to 200 words: similarities on both sides of 0.8
            words = (rows[0] if i % 3 else rng.choice(rows))[1].split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randint(40, 200))]
        rows.append((i, " ".join(words), "en", "s", 0))
    rows += [(500, "", "en", "s", 0), (501, None, "en", "s", 0), (502, "One two", "en", "s", 0), (503, "one  two", "en", "s", 0), (504, "one two three", "en", "s", 0)]
    want = brute_firsts(rows)
    assert 40 < len(want) < 200
    assert {r.doc_id for r in pipeline.near_dedup(spark, frame(spark, rows), "").collect()} == want


def test_odd_documents(spark):
    kept = near_copies.keep_first(frame(spark, ODD))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, d) for d in (1, 4, 5, 6, 7, 9, 10)] + [(True, 0)]
    assert near_copies.keep_first(frame(spark, [])).count() == 0


def test_variants_of_one_text_do_not_meet_in_pairs(spark, monkeypatch):
    """Of 300 variants that are mostly too far from each other few pairs are verified, and no link is lost."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for k in rng.sample(range(150), rng.randint(1, 8)):
            words[k] = f"n{i}x{k}"
        rows.append((i, " ".join(words), "en", "s", 0))
    pairs, verified = [], near_copies._verified

    def counted(found, sets):
        pairs.append(found.select("u", "v").distinct().count())
        return verified(found, sets)

    monkeypatch.setattr(near_copies, "_verified", counted)
    kept = {r.doc_id for r in near_copies.keep_first(frame(spark, rows)).collect()}
    assert kept == brute_firsts(rows) and 40 < len(kept) < 280
    assert sum(pairs) < 300 * near_copies.BANDS and pairs[-1] < 300


def test_fingerprints_link_first(spark, monkeypatch):
    """Links within two fingerprint bits come from the vantage-point tree, verified; with the bands silent they are all there is."""
    from lumenfold.llm import simhash

    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(5000)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(300)]
        rows += [(2 * i, " ".join(words), "en", "s", 0)]
        words[rng.choice([0, 299])] = "other"  # one shingle of 296 is another
        rows += [(2 * i + 1, " ".join(words), "en", "s", 0)]
    prints = {d: simhash.majority(near_copies.shingles(t)) for d, t, *_ in rows}
    linked = {2 * i for i in range(60) if (prints[2 * i] ^ prints[2 * i + 1]).bit_count() <= simhash.RADIUS}
    assert len(linked) > 40
    called, tree = [], near_copies.fingerprint_links
    monkeypatch.setattr(near_copies, "fingerprint_links", lambda nodes, radius: called.append(radius) or tree(nodes, radius))
    assert {r.doc_id for r in pipeline.near_dedup(spark, frame(spark, rows), "").collect()} == {2 * i for i in range(60)}
    assert called == [simhash.RADIUS]
    monkeypatch.setattr(near_copies, "_described", _silent(near_copies._described))
    kept = {r.doc_id for r in pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    assert kept == {2 * i for i in range(60)} | {2 * i + 1 for i in range(60) if 2 * i not in linked}


def _silent(described):
    def silent(texts: pd.Series) -> pd.DataFrame:
        out = described(texts)
        out["keys"] = [k[:0] for k in out["keys"]]
        return out

    return silent
