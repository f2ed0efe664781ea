"""Bigram weights of every context: rare ones and those without tuning data."""

import collections

import numpy as np
import pytest
from test_operators import corpus, frame  # noqa: F401

from lumenfold.llm import language_model


def test_buckets_without_tuning_data_take_the_nearest_weight():
    table = language_model.weight_table({2: 0.3, 5: 0.6})
    assert table[:8].tolist() == [0.3, 0.3, 0.3, 0.3, 0.6, 0.6, 0.6, 0.6]
    assert not language_model.weight_table({}).any()


def test_rare_contexts_have_bigrams(spark):
    # words of two or three occurrences that always stand before the same word
    ids = {f: [d for d in range(4000) if language_model.fold(d) == f][:60] for f in (0, language_model.HELD_OUT, language_model.TUNING)}
    rows = [(d, f"a{i} b{i}", "en", "s", 0) for found in ids.values() for i, d in enumerate(found)]
    got = {r.doc_id: r for r in language_model.score_documents(frame(spark, rows)).collect()}
    held = [got[d] for d in ids[language_model.HELD_OUT]]
    assert all(r.held_out for r in held)
    assert np.mean([r.score - r.base_score for r in held]) > 1
    assert held[0].train_tokens == pytest.approx(3 * 120)


def brute_scores(rows):
    """Scores by the definition: plain dictionaries, expectation-maximisation over single tokens, exact ratios."""
    docs = [(d, language_model.fold(d), language_model.tokenize(t)) for d, t, *_ in rows]
    rest, total = collections.Counter(), collections.Counter()
    for _, f, w in docs:
        if f != language_model.HELD_OUT:
            total.update(w)
            if f != language_model.TUNING:
                rest.update(w)
    pairs = lambda w: zip([language_model.END, *w[:-1]], w)
    known = lambda u, v: total[u] > 0 and total[v] > 0
    both, both_rest = collections.Counter(), collections.Counter()
    for _, f, w in docs:
        if f != language_model.HELD_OUT:
            seen = [p for p in pairs(w) if known(*p)]
            both.update(seen)
            if f != language_model.TUNING:
                both_rest.update(seen)
    bucket = lambda c: int(np.floor(np.log2(max(c, 1))))
    n, v, n_rest, v_rest = sum(total.values()), len(total), sum(rest.values()), len(rest)
    ratios = collections.defaultdict(list)
    for _, f, w in docs:
        if f == language_model.TUNING:
            for a, b in pairs(w):
                if known(a, b) and rest[a] > 0:
                    ratios[bucket(rest[a])].append(both_rest[a, b] / rest[a] / ((rest[b] + 1) / (n_rest + v_rest + 1)))
    weights = {}
    for k, r in ratios.items():
        r, x = np.array(r), 0.5
        for _ in range(language_model.ROUNDS):
            x = min(max(float((x * r / (x * r + 1 - x)).mean()), 1e-6), 1 - 1e-6)
        weights[k] = x
    table = language_model.weight_table(weights)
    out = {}
    for d, _, w in docs:
        score = 0.0
        for a, b in pairs(w):
            p1, x = (total[b] + 1) / (n + v + 1), table[bucket(total[a])] if total[a] else 0.0
            score += np.log10(x * (both[a, b] if known(a, b) else 0) / max(total[a], 1) + (1 - x) * p1)
        out[d] = score
    return out, weights


def test_scores_and_weights_equal_brute_force(spark, corpus):  # noqa: F811
    rows = [r for r in corpus if r[0] is not None]
    want, weights = brute_scores(rows)
    assert len(weights) > 3 and any(0.01 < x < 0.99 for x in weights.values())
    got = {r.doc_id: r.score for r in language_model.score_documents(frame(spark, rows)).collect()}
    assert got.keys() == want.keys()
    for d, score in want.items():
        assert got[d] == pytest.approx(score, rel=0.01, abs=0.01)


def test_counts_above_32_bits_pass():
    counts = np.array([1, 2**33 + 5], dtype="<u8")
    assert language_model.unpress(language_model.press(counts), "<u8").tolist() == counts.tolist()
