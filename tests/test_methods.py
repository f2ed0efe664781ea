"""Registry, settings, peak policies, and the table function."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import sql
from lumenfold.operators import grids, kernels, methods, peaks

SCHEMA = "object_id string, band string, t double, y double, dy double, rid long"


@pytest.fixture(scope="module")
def obs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for key, p in (("a", 0.7365), ("b", 3.21)):
        t = np.sort(rng.uniform(0, 60, 150))
        rows += [(key, "g", float(x), float(np.sin(2 * np.pi * x / p) + rng.normal(0, 0.1)), 0.1, i) for i, x in enumerate(t)]
    return spark.createDataFrame([*rows, ("few", "g", 0.0, 1.0, 0.1, 0), ("few", "g", 1.0, 1.0, 0.1, 1)], SCHEMA)


def make_scatter():
    """A kernel that travels by value, as those of a notebook do."""

    def scatter(t, y, dy, f, bins=8):
        """Mean variance within phase bins."""
        out = np.empty(len(f))
        for i, x in enumerate(f):
            b = np.floor(np.mod(t * x, 1) * bins).astype(int)
            n, s, q = (np.bincount(b, w, bins) for w in (np.ones(len(t)), y, y * y))
            out[i] = np.sum(q - s * s / np.maximum(n, 1)) / len(t)
        return out

    return scatter


scatter = make_scatter()


def test_built_in_methods():
    assert set(kernels.METHODS) <= set(methods.names())
    assert methods.get("Lomb-Scargle").name == "gls" and methods.get("STRING_length").name == "sl" and methods.get("PDM").smallest
    assert methods.alias_diverse_for("bls") and methods.alias_diverse_for("TLS") and not methods.alias_diverse_for("gls")
    with pytest.raises(ValueError, match="unknown method"):
        methods.get("fourier")


def test_registered_method_runs_on_executors_and_in_sql(spark, obs):
    mine = methods.register(methods.Method("My Scatter", scatter, smallest=True, settings=frozenset({"bins"}), grid=lambda o: grids.fold_grid(o, floor=3.0)))
    try:
        assert methods.get("my-scatter") is mine
        got = {r.object_id: r.period for r in methods.best_periods(obs, "myscatter", bins=12).where("object_id <> 'few'").collect()}
        assert got["a"] == pytest.approx(0.7365, rel=0.02) and any(got["b"] == pytest.approx(3.21 * k, rel=0.02) for k in (1, 2, 3))
        sql.register_table_function(spark)
        obs.createOrReplaceTempView("points")
        r = spark.sql("SELECT * FROM periodogram(TABLE(SELECT object_id, t, y, dy FROM points WHERE object_id = 'a') PARTITION BY (object_id), 'My Scatter', 'best', 1)").collect()
        assert len(r) == 1 and any(r[0].period == pytest.approx(0.7365 * k, rel=0.02) for k in (1, 2, 3))
    finally:
        methods._REGISTRY.pop("myscatter")


def test_table_function_is_polymorphic(spark, obs):
    sql.register_table_function(spark)
    obs.createOrReplaceTempView("points")
    best = spark.sql("SELECT * FROM periodogram(TABLE(SELECT t, y, dy FROM points WHERE object_id = 'b') WITH SINGLE PARTITION, 'gls', 'best', 2)")
    assert best.columns == ["rank", "k", "period", "f", "power"] and best.where("rank = 1").first().period == pytest.approx(3.21, rel=0.02)
    each = spark.sql("SELECT * FROM periodogram(TABLE(SELECT * FROM points) PARTITION BY (object_id), 'gls', 'best', 1)").collect()
    assert {r.object_id for r in each} == {"a", "b"}
    whole = spark.sql("SELECT * FROM periodogram(TABLE(SELECT * FROM points) PARTITION BY (object_id) ORDER BY (t), 'gls', 'spectrum')")
    assert whole.columns == ["object_id", "k", "f", "power"] and whole.count() == 2 * (12 * 150 + 75 - 4)
    for bad in ("'fourier'", "'gls', 'all'"):
        with pytest.raises(Exception, match="(unknown method|'best' or 'spectrum')"):
            spark.sql(f"SELECT * FROM periodogram(TABLE(SELECT * FROM points) PARTITION BY (object_id), {bad})").collect()


def test_spectra_of_the_table_function_equal_the_kernels(spark, obs):
    sql.register_table_function(spark)
    obs.where("object_id = 'a'").createOrReplaceTempView("one")
    got = np.array([r.power for r in spark.sql("SELECT * FROM periodogram(TABLE(SELECT * FROM one) PARTITION BY (object_id), 'pdm', 'spectrum') ORDER BY k").collect()])
    p = obs.where("object_id = 'a'").orderBy("t").toPandas()
    t = p.t.to_numpy()
    np.testing.assert_allclose(got, kernels.pdm(t - t[0], p.y.to_numpy(), p.dy.to_numpy(), methods.local_trials(t)))


def test_several_methods_with_their_settings(spark, obs):
    got = methods.search(obs, ["GLS", "pdm", "conditional entropy", "gls"], n=2, nf=500, settings={"PDM": {"n_bins": 8}, "mhaov": {"harmonics": 2}})
    rows = {(r.object_id, r.method, r["rank"]): r for r in got.collect()}
    assert {k[1] for k in rows} == {"gls", "pdm", "ce"} and rows["a", "gls", 1].period == pytest.approx(0.7365, rel=0.02)
    want = kernels.best_periods(obs, "pdm", 500, n=2, n_bins=8).where("object_id = 'b'").orderBy("rank").collect()
    assert [rows["b", "pdm", i + 1].k for i in range(2)] == [r.k for r in want]
    for settings, text in (({"gls": {"n_bins": 3}}, "no setting"), ({"GLS": {}, "lomb-scargle": {}}, "two keys"), ({"nothing": {}}, "unknown")):
        with pytest.raises(ValueError, match=text):
            methods.select_settings(["gls"], settings)


def test_peak_policies():
    f = np.linspace(0.1, 4, 1000)
    power = sum(a * np.exp(-(((f - x) / 0.01) ** 2)) for a, x in ((1.0, 0.4), (0.9, 0.8), (0.8, 1.4), (0.7, 2.9), (0.6, 3.77)))
    plain, diverse = methods.Method("x", scatter), methods.Method("x", scatter).with_peak_defaults(diverse=True)
    assert f[plain.peaks(f, power, 3)] == pytest.approx([0.4, 0.8, 1.4], abs=0.005)
    assert f[diverse.peaks(f, power, 3)] == pytest.approx([0.4, 2.9, 3.77], abs=0.005)  # twice, and a day apart, go
    assert len(methods.Method("x", scatter, separation=1).peaks(f, power, 5)) == 5
    assert methods.Method("x", scatter).peaks(f, np.full(1000, np.nan), 2) == []
    with pytest.raises(ValueError):
        methods.Method("--", scatter)


def test_related_equals_the_column(spark):
    rng = np.random.default_rng(1)
    pairs = [(float(a), float(b)) for a, b in rng.uniform(0.05, 4, (400, 2))] + [(1.0, 2.003), (0.4, 1.4027), (0.5, 0.5027), (3.2, 0.4)]
    df = spark.createDataFrame(pairs, "f double, g double").select("f", "g", peaks.alias_related(F.col("f"), F.col("g"), F.lit(0.01)).alias("r"))
    for r in df.collect():
        assert methods.related(r.f, r.g) == r.r
