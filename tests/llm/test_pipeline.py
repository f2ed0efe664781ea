"""The corpus pipeline, stage by stage, against brute force."""

import random
import zlib

import duckdb
import pytest
from test_operators import DOCS, WORDS, prose, within_one

from lumenfold.llm import lines, oracles

pipeline = pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    rng = random.Random(12)
    bench = [(i, prose(rng, 24)) for i in range(3)]
    rows = []
    for i in range(160):
        text = "\n".join(prose(rng, rng.randint(8, 25)) + f" u{i}x{k}" for k in range(rng.randint(2, 4)))
        kind = i % 12
        if kind == 2:
            text = rows[-1][1]  # exact copy
        elif kind == 4:
            text += "\n" + bench[i % 3][1]
        elif kind == 6:
            text = "too short"
        elif kind == 8:
            text += "\n" + "a line that many documents of this corpus share"
        elif kind == 10:
            text += "\n" + "a line that many documents of this corpus sharq"
        rows.append((i, text, "en", "s", len(text)))
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, bench


def brute_lines(docs):
    first, seen = {}, []
    for d, t in sorted(docs.items()):
        for no, raw in enumerate(t.split("\n")):
            if x := raw.strip(lines.BLANKS):
                first.setdefault(x, (d, no))
                seen.append((d, no, x))
    long = [x for x in first if len(x) >= lines.MIN_CHARS]
    near = {max(a, b, key=first.get) for i, a in enumerate(long) for b in long[i + 1 :] if within_one(a, b)}
    gone = {(d, no) for d, no, x in seen if (d, no) != first[x] or x in near}
    return {d: "\n".join(r for i, r in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in docs.items()}


def kept_by_sql(folder):
    """The verdicts of the quality rules as DuckDB finds them."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = con.execute(oracles.QUALITY)
    at = [c[0] for c in found.description].index("kept")
    return {r[0]: r[at] for r in found.fetchall()}


def brute_first_copies(docs):
    """The first document of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for d, t in docs.items()}
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in docs:
        for b in docs:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: t for d, t in docs.items() if find(d) == d}


def test_stages(spark, data):
    folder, rows, bench = data
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=P.path(pipeline.MODEL))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = {r[0]: r[1] for r in rows if kept_by_sql(folder)[r[0]]}
    assert len(want) < len(rows)
    for name, stage in pipeline.STAGES:
        docs = pipeline.cut(stage(spark, docs, folder))
        if name == "line_dedup":
            want = brute_lines(want)
        elif name == "near_dedup":
            want = brute_first_copies(want)
        elif name == "decontamination":
            win = {tuple(w[j : j + 10]) for _, t in bench if (w := t.split()) for j in range(len(w) - 9)}
            clean = lambda t: not any(tuple(w[j : j + 10]) in win for w in [t.lower().split()] for j in range(len(w) - 9))
            want = {d: t for d, t in want.items() if clean(t)}
        if name == "encoding":
            import numpy as np

            got = {r.doc_id: (r.n_tokens, r.ids_crc32, r.round_trip) for r in docs.collect()}
            ids = {d: np.array(sp.encode(t), dtype="<u4") for d, t in want.items()}
            assert got == {d: (len(i), zlib.crc32(i.tobytes()), True) for d, i in ids.items()}
        else:
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
            assert {r.doc_id: r.text for r in docs.collect()} == want, name
    assert 60 < len(want) < len(rows)
    assert pipeline.run(spark, folder).count() == len(want)


def test_odd_documents_pass(spark, tmp_path):
    text = " ".join(f"{w}{i}" for i, w in enumerate(WORDS))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, text, None, None, None), (4, text, "en", "s", 1), (None, text + " more", "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()} >= {3}
