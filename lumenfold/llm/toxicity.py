"""Toxicity from confirmed toxic examples and unlabelled text.

Non-negative positive-unlabelled learning (Kiryo et al., 2017): a linear model
over hashed words and word beginnings minimises the class-prior-corrected risk
``p R+(P) + max(0, R-(U) - p R-(P))``; where the second part falls below zero
its gradient is reversed. Non-toxic labels serve only to estimate the prior
``p``. Training is numpy on a bounded sample; scoring covers every text.

A text is the set of its features, so one insult counts the same in a short and
in a long text, and only features that toxic examples show significantly more often than the
unlabelled texts carry weight.

Defined results: null, empty and wordless texts score the model's intercept;
repeated rows get equal scores; repeated labels of a document count once and
toxic wins; without any toxic training label the score is 0 for all; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

FOLDS = 4
HELD_OUT = 2
CUTOFF = 0.3
DIMENSIONS = 1 << 20
#: Bounds of the training sample: confirmed toxic documents and unlabelled ones.
MAX_POSITIVE = 3000
MAX_UNLABELLED = 9000
#: Features of a sampled document that training looks at, and documents of a doc_id: one.
MAX_FEATURES = 8192
#: A feature is used if its rate among confirmed toxic documents exceeds twice
#: that among unlabelled ones by so many standard errors, in so many documents.
MIN_Z = 4.0
MIN_DOCS = 4
STEPS = 2500
BATCH = 512
RATE = 0.02
PRIOR_BOUNDS = (0.001, 0.5)
CACHE = 500_000

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word: itself and its first 4, 5 and 6 letters."""
    keys = {f"={word}", *(word[:k] for k in (4, 5, 6) if len(word) >= k)}
    return [zlib.crc32(k.encode()) % DIMENSIONS for k in keys]


def features(text: str | None) -> np.ndarray:
    """Sorted distinct features of a text."""
    found: set[int] = set()
    for w in set(_WORD.findall(text.lower())) if text else ():
        found.update(word_features(w))
    return np.array(sorted(found), dtype=np.int32)


def packed_features(text: str = "text"):
    """The first ``MAX_FEATURES`` features of a text column, which are in no order of their own, as bytes of 32-bit integers."""

    @pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t)[:MAX_FEATURES].tobytes())

    return packed(F.col(text))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], list[np.ndarray], float]:
    """Features of confirmed toxic and of unlabelled documents, and the share of toxic labels; no held-out rows."""
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = usable.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"] or 0.0
    first = lambda df, n: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    positive = first(usable.where("toxic = 1"), MAX_POSITIVE).select("doc_id", F.lit(True).alias("positive"))
    unlabelled = first(docs.where(~held_out()), MAX_UNLABELLED).select("doc_id", F.lit(False).alias("positive"))
    chosen = positive.unionByName(unlabelled)  # at most MAX_POSITIVE + MAX_UNLABELLED ids
    each = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "positive", packed_features().alias("f"))
    rows = each.groupBy("doc_id", "positive").agg(F.min("f").alias("f")).collect()  # at most so many rows of 4 MAX_FEATURES bytes
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["f"])))
    unpack = lambda kind: [np.frombuffer(r["f"], dtype=np.int32) for r in rows if r["positive"] is kind]
    return unpack(True), unpack(False), prior


def _matrix(rows: list[np.ndarray], column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and kept column numbers."""
    kept = [c[c >= 0] for c in (column[r] for r in rows)]
    return np.concatenate([[0], np.cumsum([len(k) for k in kept])]), np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _take(matrix: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the given rows and which of them each belongs to."""
    at, cols = matrix
    n = at[rows + 1] - at[rows]
    where = np.repeat(at[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return cols[where], np.repeat(np.arange(len(rows)), n)


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Features that confirmed toxic documents have significantly more often than unlabelled ones."""
    n1, n0 = len(positive), len(unlabelled)
    c1, c0 = (np.bincount(np.concatenate(x), minlength=DIMENSIONS) for x in (positive, unlabelled))
    p1, p0, pool = c1 / n1, c0 / n0, (c1 + c0) / (n1 + n0)
    error = np.sqrt(np.maximum(pool * (1 - pool), 1e-12) * (1 / n1 + 1 / n0))
    return np.flatnonzero((c1 >= MIN_DOCS) & (p1 - 2 * p0 > 0) & (p1 - p0 > MIN_Z * error))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int = 0) -> tuple[dict[int, float], float]:
    """(weights of the features that matter, intercept) by minibatch Adam on the non-negative risk."""
    if not positive or not unlabelled:
        return {}, -float("inf")
    prior = float(np.clip(prior, *PRIOR_BOUNDS))
    names = telling(positive, unlabelled)
    column = np.full(DIMENSIONS, -1, dtype=np.int64)
    column[names] = np.arange(len(names))
    p, u = _matrix(positive, column), _matrix(unlabelled, column)
    w = np.zeros(len(names) + 1)  # the last is the intercept
    w[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    rng = np.random.default_rng(seed)
    for step in range(1, STEPS + 1):
        ru, rp = rng.integers(0, len(unlabelled), BATCH), rng.integers(0, len(positive), BATCH)
        (cu, iu), (cp, ip) = _take(u, ru), _take(p, rp)
        zu = w[-1] + np.bincount(iu, w[cu], BATCH)
        zp = w[-1] + np.bincount(ip, w[cp], BATCH)
        su, sp = 1 / (1 + np.exp(-np.clip(zu, -30, 30))), 1 / (1 + np.exp(-np.clip(zp, -30, 30)))
        # logistic losses: log(1+e^-z) as positive, log(1+e^z) as negative
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        du, dp = su / BATCH, -prior * sp / BATCH
        if rest >= 0:
            dp = dp - prior * (1 - sp) / BATCH
        else:
            du, dp = -du, -dp
        g = np.append(np.bincount(cu, du[iu], len(names)) + np.bincount(cp, dp[ip], len(names)), du.sum() + dp.sum())
        mean += 0.1 * (g - mean)
        square += 0.001 * (g * g - square)
        rate = RATE * (1 - step / (STEPS + 1))
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    w, b = w[:-1], float(w[-1])
    live = np.flatnonzero(np.abs(w) > 1e-3)
    return dict(zip(names[live].tolist(), w[live].tolist(), strict=True)), b


def scorer(weights: dict[int, float], intercept: float):
    """Column function: probability of toxicity of a text."""
    state: dict = {}

    @pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        known = state.setdefault("known", {})
        out = np.empty(len(texts))
        for i, t in enumerate(texts):
            live: set[int] = set()
            for w in set(_WORD.findall(t.lower())) if t else ():
                f = known.get(w)
                if f is None:
                    if len(known) >= CACHE:
                        known.clear()
                    f = known[w] = tuple(k for k in word_features(w) if k in weights)
                if f:
                    live.update(f)
            out[i] = intercept + sum(weights[k] for k in sorted(live))
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -700, 700))))

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    positive, unlabelled, prior = training_sample(docs, labels)
    score = scorer(*train(positive, unlabelled, prior))
    scored = docs.select("doc_id", held_out().alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
