"""What is shuffled and how work is dealt must follow the input, not its trials."""

import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import boxes, readouts, spectra, spread, variation
from lumenfold.plans import catalogue

SCHEMA = "object_id string, band string, t double, y double, dy double, rid long"


def points(spark, n=40, objects=("a", "b")):
    rng = np.random.default_rng(3)
    rows = [(o, "gr"[i % 2], float(t), float(rng.normal(10, 1)), float(rng.uniform(0.5, 1)), i) for o in objects for i, t in enumerate(np.sort(rng.uniform(0, 30, n)))]
    return spark.createDataFrame(rows, SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("search", [boxes.bls, boxes.tls])
def test_box_bins_are_not_shuffled(spark, search):
    p = plan(search(points(spark), 5))
    assert "Join" not in p and p.count("Exchange") == 1


def test_box_search_against_every_box(spark):
    o = points(spark)
    pdf = o.where("object_id = 'a'").toPandas()
    t, y, iv = pdf.t.to_numpy(), pdf.y.to_numpy(), 1 / pdf.dy.to_numpy() ** 2
    yc, tau = y - np.sum(iv * y) / iv.sum(), t - t.min()
    for r in boxes.bls(o, 4, 20, (1, 3)).where("object_id = 'a'").collect():
        p = 1 / (1 / tau.max() + r.k / (5 * tau.max()))
        b = np.minimum(np.floor((tau / p - np.floor(tau / p)) * 20), 19).astype(int)
        found = []
        for w in (1, 3):
            for s in range(20):
                m = np.isin(b, (s + np.arange(w)) % 20)
                if m.any() and not m.all():
                    depth = np.sum((iv * yc)[~m]) / iv[~m].sum() - np.sum((iv * yc)[m]) / iv[m].sum()
                    if depth >= 0:
                        found.append((-round(depth / np.sqrt(1 / iv[m].sum() + 1 / iv[~m].sum()), 6), w, s))
        score, w, s = min(found)
        assert (r.width, r.start) == (w, s) and r.power == pytest.approx(-score, abs=1e-5) and r.p == pytest.approx(p)


def test_box_search_without_points_or_errors(spark):
    none = points(spark).where("false")
    assert boxes.bls(none).count() == 0 and boxes.tls(none).count() == 0
    bare = points(spark).withColumn("dy", F.lit(None).cast("double"))
    ones = points(spark).withColumn("dy", F.lit(1.0))
    assert sorted(boxes.tls(bare, 4).collect()) == sorted(boxes.tls(ones, 4).collect())


def test_nothing_orbits_where_the_mass_function_is_zero(spark):
    rows = spark.createDataFrame([(0.0,), (0.5,)], "f double").select(readouts.minimum_third_mass(F.col("f"), F.lit(1.2)).alias("m")).collect()
    assert rows[0].m == 0 and rows[1].m**3 / (rows[1].m + 1.2) ** 2 == pytest.approx(0.5)


@pytest.fixture(scope="module")
def odd_events(tmp_path_factory):
    """Zero values, a band of two points, values that are all their mean, and one object of one point."""
    rows, rng = [], np.random.default_rng(5)
    for user in range(4):
        for i in range(24 if user < 3 else 1):
            value = 0.0 if i == 5 else 0.1 if user == 2 else round(float(rng.uniform(1, 50)), 2)
            rows.append((len(rows), pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=int(rng.integers(0, 2_500_000))), user, "rare" if i < 2 else "abc"[i % 3], value))
    folder = tmp_path_factory.mktemp("odd")
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"])
    duckdb.sql("COPY (SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM events) TO '" + str(folder / "events.parquet") + "' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["unit_conversions", "third_masses", "magnitudes", "mixed_domains", "kernel_shared_offsets"])
def test_odd_values_give_what_the_sql_gives(spark, odd_events, name):
    found = catalogue.queries()[name](spark, odd_events).toPandas()
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{odd_events}/events.parquet'")
        wanted = c.execute(catalogue.oracle_sql()[name]).df()[list(found.columns)]
    keys = [c for c in found.columns if found[c].dtype != float]
    found, wanted = (x.sort_values(keys).reset_index(drop=True) for x in (found, wanted))
    assert len(found) and found[keys].equals(wanted[keys])
    for c in set(found.columns) - set(keys):
        np.testing.assert_allclose(found[c], wanted[c], atol=2e-6, err_msg=c)


def test_tasks_follow_the_rows_and_objects(spark, monkeypatch):
    """Adaptive execution would join them by bytes, which say nothing about points times trials."""
    o = points(spark)
    monkeypatch.setattr(spread, "ROWS", 100)
    for df in (spectra.pdm(o, 50), spectra.conditional_entropy(o, 50), spectra.string_length(o, 50), spectra.pdm(o, 50, by=("object_id", "band"))):
        assert "hashpartitioning(object_id#" in (p := plan(df)) and p.count("Exchange") == 1 and "40), REPARTITION_BY_NUM" in p


def test_tasks_of_grouped_calls_follow_the_objects(spark, monkeypatch):
    o = points(spark, 12, [f"o{i}" for i in range(30)])
    monkeypatch.setattr(spread, "OBJECTS", 2)
    held = o.select("object_id").distinct().select("object_id", F.lit(0).alias("component"), F.lit(0.5).alias("f"))
    found = variation.subset_variation(o, held)
    assert int(re.search(r"(\d+)\), REPARTITION_BY_NUM", plan(found))[1]) >= 14
