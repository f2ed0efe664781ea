"""Segmented box search against a plain box search, and gridded spectra of large objects."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import box_search, boxes, gridded, grids, kernels, nufft, spread, transit_search

SCHEMA = "object_id string, t double, y double, dy double, rid long"


def plain_box(t, y, iv, period, lengths, oversample, objective):
    """One period, every start and length, one by one."""
    width = lengths.min() / oversample
    tau, mean = t - t.min(), np.sum(iv * y) / iv.sum()
    nb = int(np.ceil(period / width))
    b = np.floor(np.mod(tau, period) / width).astype(int) + 1
    a, v = (np.bincount(b, x, nb + oversample + 2)[: nb + oversample + 2] for x in ((y - mean) * iv, iv))
    for h in (a, v):
        h[nb : nb + oversample] = h[1 : oversample + 1]
    best = None
    for kd in sorted({int(np.floor(x / width + 0.5)) for x in lengths}):
        for i in range(nb + oversample - kd + 1):
            ina, inv = a[i + 1 : i + kd + 1].sum(), v[i + 1 : i + kd + 1].sum()
            out = iv.sum() - inv
            if inv < 1e-12 * iv.sum() or out < 1e-12 * iv.sum() or ina > 0:
                continue
            depth = -ina / out - ina / inv
            snr, like = depth / np.sqrt(1 / inv + 1 / out), 0.5 * inv * depth**2
            value = snr if objective == "snr" else like
            if best is None or value > best[0] * (1 + 1e-9):
                best = value, depth, kd * width, (i * width + kd * width / 2) % period
    return best


def transit(n=300, seed=2, depth=0.03):
    rng = np.random.default_rng(seed)
    t = 2458000.0 + np.sort(rng.uniform(0, 40, n))
    y = 1 + rng.normal(0, 0.002, n)
    y[np.mod(t - 2458001.3, 3.7) / 3.7 < 0.05] -= depth
    return t, y, np.full(n, 0.002) * rng.uniform(0.5, 2, n)


@pytest.mark.parametrize("objective", ["snr", "likelihood"])
def test_boxes_equal_plain_ones(objective):
    t, y, dy = transit(60)
    lengths, periods = box_search.durations(2.0), np.linspace(2, 4, 9)
    got = box_search.boxes(t - t[0], y, dy, periods, lengths, 4, objective)
    for i, p in enumerate(periods):
        want = plain_box(t, y, 1 / dy**2, p, lengths, 4, objective)
        assert [got[c][i] for c in ("power", "depth", "duration", "t0")] == pytest.approx(want, rel=1e-9)


def test_kernel_equals_segments():
    t, y, dy = transit(150)
    periods = np.concatenate([np.linspace(1.0, 1.99, 40), np.linspace(2.0, 3.9, 40)])
    got = kernels.bls(t - t[0], y, dy, 1 / periods)
    for lo, part in ((1.0, slice(0, 40)), (2.0, slice(40, 80))):
        want = box_search.boxes(t - t[0], y, dy, periods[part], box_search.durations(lo, least=0.0))["power"]
        np.testing.assert_allclose(got[part], want, rtol=1e-9)


def test_no_dip_and_flat():
    periods, lengths = np.array([2.0, 3.0]), np.array([0.2])
    flat = box_search.boxes(np.arange(20.0), np.ones(20), None, periods, lengths)
    assert (flat["power"] == 0).all() or (flat["power"] == -np.inf).all()
    one = box_search.boxes(np.array([0.0, 0.01]), np.array([1.0, 1.0]), None, np.array([5.0]), np.array([0.5]))
    assert one["power"][0] == -np.inf and one["depth"][0] == 0
    with pytest.raises(ValueError):
        box_search.boxes(np.arange(3.0), np.arange(3.0), None, periods, lengths, objective="depth")


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = []
    for key, n, seed in (("a", 300, 2), ("b", 90, 5)):
        t, y, dy = transit(n, seed)
        rows += [(key, float(a), float(b), float(c), i) for i, (a, b, c) in enumerate(zip(t, y, dy))]
    rows += [("few", 1.0, 1.0, 0.1, 0), ("few", 90.0, 1.0, 0.1, 1), ("short", 1.0, 1.0, None, 0)] + [("short", 1.0 + 0.01 * i, 1.0, None, i) for i in range(1, 9)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("objective", ["snr", "likelihood"])
def test_segments_and_pieces_change_nothing(spark, catalogue, objective):
    segments = grids.box_segments(catalogue, shortest=2.0)
    whole = box_search.spectrum(catalogue, segments, objective).orderBy("object_id", "segment", "k").toPandas()
    cut = box_search.spectrum(catalogue, segments, objective, work=20_000).orderBy("object_id", "segment", "k").toPandas()
    pd.testing.assert_frame_equal(whole, cut)
    # each segment with its own durations equals a call for that segment alone
    a = catalogue.where("object_id = 'a'").orderBy("t").toPandas()
    for s in segments.where("object_id = 'a'").collect():
        part = whole[(whole.object_id == "a") & (whole.segment == s.segment)]
        got = box_search.boxes(a.t.to_numpy() - a.t.min(), a.y.to_numpy(), a.dy.to_numpy(), part.period.to_numpy(), box_search.durations(s.p_lo), objective=objective)
        np.testing.assert_allclose(part.power, got["power"], rtol=1e-12)
        assert part.period.between(s.p_lo, s.p_hi * (1 + 1e-12)).all()
    best = box_search.search(catalogue, segments, objective, work=20_000).toPandas().set_index("object_id")
    for key in "ab":
        mine = whole[whole.object_id == key].fillna({"power": 0.0}).round({"power": 9})
        top = mine.sort_values(["power", "period"], ascending=[False, True]).iloc[0]
        assert best.loc[key, "power"] == pytest.approx(top.power) and best.loc[key, "trials"] == len(mine)
        assert best.loc[key, "sde"] == pytest.approx((top.power - mine.power.mean()) / mine.power.std(ddof=0))
        assert best.loc[key, "period"] == pytest.approx(top.period) and best.loc[key, "t0"] == pytest.approx(top.t0)
    if objective == "snr":
        assert best.loc["a", "period"] == pytest.approx(3.7, rel=2e-3) and best.loc["a", "depth"] == pytest.approx(0.03, rel=0.2)
        assert abs((best.loc["a", "t0"] - 2458001.3 - 0.0925 + 1.85) % 3.7 - 1.85) < 0.15
    assert {(r.object_id, r.reason) for r in box_search.not_searched(catalogue, segments).collect()} == {("few", "too few points"), ("short", "no trial period within the baseline")}


def plain_transit(t, y, w, period, n_bins, lengths):
    """One period: every shape at every start, weighted least squares of level and shape."""
    phase = (t - t.min()) / period
    b = np.minimum(((phase - np.floor(phase)) * n_bins).astype(int), n_bins - 1)
    best = (0.0, 0.0, 0.0, 0.0)
    for k in lengths:
        for i in range(n_bins):
            g = np.zeros(n_bins)
            g[(i + np.arange(k)) % n_bins] = boxes.limb_darkened(k)
            x = np.column_stack([np.ones(len(t)), -g[b]]) * np.sqrt(w)[:, None]
            if np.linalg.matrix_rank(x) < 2:
                continue
            beta = np.linalg.lstsq(x, y * np.sqrt(w), rcond=None)[0]
            gain = np.sum(w * (y - np.average(y, weights=w)) ** 2) - np.sum((y * np.sqrt(w) - x @ beta) ** 2)
            if beta[1] > 0 and gain > best[0] * (1 + 1e-9):
                best = gain, beta[1], k / n_bins * period, ((i + k / 2) / n_bins % 1) * period
    return best


def test_transits_equal_plain_least_squares():
    t, y, dy = transit(50, depth=0.02)
    periods = np.array([2.1, 3.7, 5.3])
    got = transit_search.transits(t - t[0], y, dy, periods, 32, [2, 4])
    for i, p in enumerate(periods):
        assert [got[c][i] for c in transit_search.FIELDS] == pytest.approx(plain_transit(t, y, 1 / dy**2, p, 32, [2, 4]), rel=1e-6)
    flat = transit_search.transits(t - t[0], np.ones(50), dy, periods)
    assert (flat["power"] == 0).all()


def test_transit_search_of_a_catalogue(spark, catalogue):
    best = {r.object_id: r for r in transit_search.search(catalogue, work=50_000).collect()}
    assert set(best) == {"a", "b"} and best["a"].period == pytest.approx(3.7, rel=2e-3) and best["a"].depth == pytest.approx(0.03, rel=0.25)
    assert abs((best["a"].t0 - 2458001.3 - 0.0925 + 1.85) % 3.7 - 1.85) < 0.12 and best["a"].sde > 6
    whole = transit_search.spectrum(catalogue).where("object_id = 'a'").toPandas()
    assert len(whole) == best["a"].trials and best["a"].power == pytest.approx(whole.power.max())
    assert best["a"].sde == pytest.approx((whole.power.max() - whole.power.mean()) / whole.power.std(ddof=0))
    a = catalogue.where("object_id = 'a'").orderBy("t").toPandas()
    tau = a.t.to_numpy() - a.t.min()
    some = whole.sort_values("k").iloc[::50]
    kernel = kernels.tls(tau, a.y.to_numpy(), a.dy.to_numpy(), 1 / some.period.to_numpy())
    np.testing.assert_allclose(np.corrcoef(kernel, some.power)[0, 1], 1, atol=1e-9)


def test_one_object_in_many_tasks(spark, catalogue):
    segments = grids.box_segments(catalogue, shortest=0.5)
    dealt = box_search.spectrum(catalogue.where("object_id = 'a'"), segments.where("object_id = 'a'"), work=50_000).withColumn("task", F.spark_partition_id())
    assert dealt.select("task").distinct().count() > 3


def test_log_segments(spark):
    periods = spark.createDataFrame([("a", p) for p in (1.0, 1.5, 1.999, 2.0, 3.9, 4.0, 70.0)], "object_id string, period double")
    got = {r.period: (r.segment, r.p_lo) for r in box_search.log_segments(periods).collect()}
    assert got == {1.0: (0, 1.0), 1.5: (0, 1.0), 1.999: (0, 1.0), 2.0: (1, 2.0), 3.9: (1, 2.0), 4.0: (2, 4.0), 70.0: (6, 64.0)}


def test_kernels_are_dealt_by_work(spark):
    o = spark.createDataFrame([(f"o{i}", float(j) * 0.37, float(j * i % 7), None, j) for i in range(40) for j in range(30)], SCHEMA)
    tasks = kernels.spectrum(o, "pdm", grid=grids.fold_grid(o)).withColumn("task", F.spark_partition_id()).select("task").distinct().count()
    assert tasks > 1  # a few kB in all: adaptive execution would join them to one
    assert spread.tasks(1e12, 8) == 10_000 and spread.tasks(0, 8) == 16
    assert spread.estimated_work(o, 10) == 40 * 30 * 10


def test_objects_without_a_grid_are_no_error(spark):
    o = spark.createDataFrame([("x", float(j), float(j % 3), None, j) for j in range(12)] + [("y", 0.0, 1.0, None, 0), ("y", 0.1, 1.0, None, 1)], SCHEMA)
    got = kernels.best_periods(o, "bls", grid=grids.box_grid(o, shortest=2.0))
    assert {r.object_id for r in got.collect()} == {"x"}


def direct(t, y, w, f):
    w = w / w.sum()
    return kernels.LombScargle(t - t.min(), None if np.ptp(w) == 0 else 1 / np.sqrt(w), f).power(y)


def test_grids_of_parts_add_up():
    rng = np.random.default_rng(0)
    t, v = np.sort(rng.uniform(0, 50, 400)), rng.normal(size=(2, 400))
    parts = sum(nufft.spread(t[i::3], v[:, i::3], 0.02, 0.004, 500) for i in range(3))
    want = np.stack([[np.sum(r * np.exp(2j * np.pi * (0.02 + 0.004 * k) * t)) for k in range(500)] for r in v])
    np.testing.assert_allclose(nufft.transform(parts, 500), want, atol=1e-9 * np.abs(v).sum())


def test_object_larger_than_a_task(spark):
    n = 300_000
    o = spark.range(n, numPartitions=6).select(
        F.when(F.col("id") % 1000 == 0, "small").otherwise("large").alias("object_id"), (F.rand(1) * 100 + 2458000).alias("t"), F.col("id").alias("rid"), (F.lit(0.05) + 0.1 * F.rand(3)).alias("dy"),
    ).withColumn("y", 14 + 0.3 * F.sin(2 * 3.141592653589793 * F.col("t") / 0.7365) + 0.1 * F.randn(5))
    o = spark.createDataFrame(o.toPandas())  # random columns once
    grid = spark.createDataFrame([("large", 0.01, 0.002, 3000), ("small", 0.5, 0.002, 700)], "object_id string, f0 double, df double, nf long")
    got = gridded.spectrum(o, grid, part=30_000, slab=1024).toPandas().sort_values(["object_id", "k"])
    pdf = o.toPandas()
    for key, f0, nf in (("large", 0.01, 3000), ("small", 0.5, 700)):
        mine, spectrum = pdf[pdf.object_id == key], got[got.object_id == key]
        some = np.unique(np.r_[np.arange(0, nf, 97), 1023, 1024, spectrum.power.argmax()] % nf)
        f = f0 + 0.002 * some
        want = direct(mine.t.to_numpy(), mine.y.to_numpy(), 1 / mine.dy.to_numpy() ** 2, f)
        np.testing.assert_allclose(spectrum.power.to_numpy()[some], want, atol=1e-9)
        assert len(spectrum) == nf
    best = {(r.object_id, r.rank): r.period for r in gridded.best_periods(o, grid, n=3, part=30_000, slab=256).collect()}
    assert best["large", 1] == pytest.approx(0.7365, rel=2e-3) and len(best) == 6


def test_ranked_slabs_equal_the_whole_spectrum(spark):
    o = spark.createDataFrame([("a", float(j) * 0.61 + (j % 5) * 0.1, float((j * j) % 17), None, j) for j in range(80)], SCHEMA)
    grid = spark.createDataFrame([("a", 0.02, 0.004, 400)], "object_id string, f0 double, df double, nf long")
    got = [(r.k, round(r.power, 9)) for r in gridded.best_periods(o, grid, n=6, part=17, slab=32).orderBy("rank").collect()]
    want = [(r.k, round(r.power, 9)) for r in kernels.best_periods(o, "gls", n=6, grid=grid).orderBy("rank").collect()]
    assert got == want


def test_relational_boxes_are_still_there(spark):
    assert boxes.limb_darkened(5)[2] == 1.0
