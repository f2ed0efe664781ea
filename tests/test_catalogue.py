"""Sources, sinks, streaming, SQL functions, and the registered queries against DuckDB."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lumenfold.functions import sql
from lumenfold.operators import kernels, spectra
from lumenfold.plans import batch, catalogue
from lumenfold.sources import observations
from lumenfold.streaming import spectra as streaming

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@needs_data
def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["gls_weighted", "pdm", "string_length", "top_peaks", "bls_box_search", "gls_shared_offsets", "running_median", "wavelet_z", "quadratic_drift", "kernel_ce", "resumed_rows"])
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DATA}/{t}'")
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = lambda rs: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rs)
    assert rows(tuple(r) for r in catalogue.queries()[name](spark, DATA).select(*columns).collect()) == rows(want.fetchall())


def points(spark, n=60, name="a"):
    return spark.createDataFrame([(name, "g", i * 0.37, float(i * 7 % 11), 0.1, i) for i in range(n)], "object_id string, band string, t double, y double, dy double, rid long")


def test_resumable_sink(spark, tmp_path):
    sink = f"{tmp_path}/sink"
    o = points(spark).unionByName(points(spark, 2, "few"))
    assert batch.run(o, ["gls"], sink, nf=30, n_best=2).count() == 2
    more = o.unionByName(points(spark, 50, "b"))
    got = batch.run(more, ["gls", "pdm"], sink, nf=30, n_best=2)
    assert {(r.object_id, r.method): r["count"] for r in got.groupBy("object_id", "method").count().collect()} == {(x, m): 2 for x in "ab" for m in ("gls", "pdm")}
    assert [tuple(r) for r in spark.read.parquet(f"{sink}/failures").collect()] == [("few", "too few points")]
    with pytest.raises(ValueError):
        batch.run(o, ["gls"], sink, nf=31, n_best=2)


def test_readers(spark, tmp_path):
    for folder, name, body in (("x", "s1.csv", "time,mag,mag_err\n1,2,0.1\n2,3,0.1\n"), ("y", "s1.csv", "time,mag,mag_err\n5,6,0.1\n"), ("y", "s2.csv", "time,mag,mag_err\n7,8,0.1\n")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(body)
    got = observations.read_files(spark, f"{tmp_path}/*/*.csv")
    assert {(r.object_id, r.t) for r in got.collect()} == {("x/s1", 1.0), ("x/s1", 2.0), ("y/s1", 5.0), ("s2", 7.0)}
    nested = observations.to_nested(points(spark))
    back = observations.from_nested(nested, "object_id", "points")
    assert back.count() == 60 and back.agg(F.sum("y")).first()[0] == points(spark).agg(F.sum("y")).first()[0]


def test_stream_equals_batch(spark, tmp_path):
    o = points(spark).select("object_id", "t", "y")
    o.where("t < 10").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    o.where("t >= 10").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = streaming.running_sums(stream, [0.2, 0.9]).writeStream.outputMode("complete").format("memory").queryName("sums").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    a = {r.k: r.power for r in streaming.power(spark.table("sums")).collect()}
    tau = [r.t for r in o.orderBy("t").collect()]
    import numpy as np

    y = np.array([r.y for r in o.orderBy("t").collect()])
    b = kernels.gls(np.array(tau), y, None, np.array([0.2, 0.9]))
    assert a[0] == pytest.approx(b[0]) and a[1] == pytest.approx(b[1])


def test_sql_functions(spark):
    sql.register(spark)
    o = points(spark)
    packed = observations.to_nested(o).selectExpr("object_id", "points.t as t", "points.y as y")
    packed.createOrReplaceTempView("curves")
    r = spark.sql("SELECT ls_power(t, y, 0.1D, 0.05D, 4) AS p, best_period(t, y, 100, 'gls') AS best, best_period(array(1D), array(1D), 10, 'gls') AS none FROM curves").first()
    assert len(r.p) == 4 and r.best > 0 and r.none is None
    want = spectra.gls(o, 100, weighted=False).orderBy(F.desc("power")).first()
    assert r.best == pytest.approx(1 / want.f)


def test_keys(spark):
    df = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("x", 4)], "key string, n int")
    assert [r.key for r in observations.unique_keys(df, "key", "n").orderBy("n").collect()] == ["x", "x#2", "y", "x#3"]
    assert df.select(observations.csv_safe(F.lit("=1+1")).alias("a"), observations.csv_safe(F.lit("ok")).alias("b")).first() == ("'=1+1", "ok")


def test_rest_imports_without_llm():
    for root, _, names in os.walk(os.path.dirname(catalogue.__file__) + "/.."):
        if os.path.basename(root) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "llm" not in open(os.path.join(root, n)).read()
