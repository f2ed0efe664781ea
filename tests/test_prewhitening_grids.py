"""Noise curves, bounded and cyclic refinement, grids per object, resumable pre-whitening, and failures of grids."""

import numpy as np
import pytest

from lumenfold.operators import grids, peaks, prewhitening
from lumenfold.plans import batch

SCHEMA = "object_id string, band string, t double, y double, dy double, rid long"


def plain_noise(f, a, window, estimator, least):
    out = []
    for x in f:
        lo, hi = np.searchsorted(f, x - window, "left"), np.searchsorted(f, x + window, "right")
        if hi - lo < min(least, len(f)):
            need = min(least, len(f))
            lo = max(0, min(int(np.searchsorted(f, x)) - max(1, need // 2), len(f) - need))
            hi = lo + need
        box = a[lo:hi][np.isfinite(a[lo:hi])]
        out.append((np.mean if estimator == "mean" else np.median)(box) if len(box) else None)
    return out


@pytest.mark.parametrize("estimator", ["mean", "median"])
@pytest.mark.parametrize(("n", "window", "least"), [(200, 0.33, 9), (200, 0.021, 25), (30, 0.05, 40), (60, 0.05, 4)])
def test_noise_curve(spark, estimator, n, window, least):
    rng = np.random.default_rng(n)
    f, a = 0.1 + 0.0137 * np.arange(n), rng.exponential(size=n)
    a[[3, 17]] = np.nan
    s = spark.createDataFrame([("x", int(k), float(x), float(v)) for k, (x, v) in enumerate(zip(f, a))], "object_id string, k long, f double, amplitude double")
    got = [r.noise for r in peaks.noise_curve(s, window, estimator, least).orderBy("k").collect()]
    assert got == pytest.approx(plain_noise(f, a, window, estimator, least), nan_ok=True)


def test_noise_curve_names_its_estimators(spark):
    with pytest.raises(ValueError):
        peaks.noise_curve(spark.createDataFrame([], "object_id string, k long, f double, amplitude double"), 1.0, "mode")


def modes(k, seed=0, n=1500, span=60.0, noise=0.02):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, span, n))
    f = 2.0 + 0.37 * np.arange(k) + rng.uniform(-0.05, 0.05, k)
    y = sum(np.sin(2 * np.pi * x * t + p) * (1 + i % 3) for i, (x, p) in enumerate(zip(f, rng.uniform(0, 6, k)))) + rng.normal(0, noise, n)
    return t - t.mean(), y, f


def test_cyclic_refinement_of_many_modes():
    t, y, f = modes(60)
    start = f + np.random.default_rng(1).uniform(-0.3, 0.3, 60) / 60
    w = np.ones(len(t))
    got, beta, cov, rss = prewhitening.multi_sine(t, y, w, start, bound=1 / 60)
    np.testing.assert_allclose(got, f, atol=3e-4)
    assert rss / len(t) < 2 * 0.02**2 and (np.abs(got - start) <= 1 / 60 + 1e-12).all()
    moved = prewhitening.cyclic_refine(t, y, w, start, 1 / 60, sweeps=1, only=[59])
    assert (moved[:59] == start[:59]).all() and moved[59] != start[59]


def test_cyclic_and_joint_steps_agree():
    t, y, f = modes(5, n=400)
    w = np.random.default_rng(2).uniform(0.5, 2, 400)
    start = f + 0.002
    joint, *_ = prewhitening.multi_sine(t, y, w, start)
    np.testing.assert_allclose(prewhitening.cyclic_refine(t, y, w, start, sweeps=12), joint, atol=1e-7)


def test_bounds_hold():
    t, y, f = modes(2, n=300)
    start = f + 0.01
    got, *_ = prewhitening.multi_sine(t, y, np.ones(300), start, bound=0.002)
    np.testing.assert_allclose(np.abs(got - start), 0.002)


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = []
    rng = np.random.default_rng(3)
    for key, f, span in (("slow", 0.31, 60.0), ("fast", 9.7, 20.0)):
        t = np.sort(rng.uniform(0, span, 300))
        rows += [(key, "g", float(a), float(b), 0.1, i) for i, (a, b) in enumerate(zip(t, np.sin(2 * np.pi * f * t) + rng.normal(0, 0.1, 300)))]
    lattice = [("lattice", "g", float(i) * 0.5, float(np.sin(2 * np.pi * 0.3 * i * 0.5) + 0.01 * (i % 7)), 0.1, i) for i in range(120)]
    return spark.createDataFrame([*rows, *lattice, ("flat", "g", 0.0, 1.0, 0.1, 0), ("flat", "g", 1.0, 1.0, 0.1, 1), ("one", "g", 0.0, 1.0, 0.1, 0)], SCHEMA)


def test_grid_of_each_object(spark, catalogue):
    g = {r.object_id: r for r in prewhitening.default_grid(catalogue).collect()}
    assert g["slow"].fmax >= 50 and g["lattice"].fmax == pytest.approx(1.0) and "one" not in g
    assert g["lattice"].df == pytest.approx(1 / (10 * 59.5))
    assert {r.object_id: r.fmax for r in prewhitening.default_grid(catalogue, fmax=4.0).collect()}["slow"] == 4.0


def test_components_on_own_grids_and_resume(spark, catalogue, tmp_path):
    found = {(r.object_id, r["rank"]): r for r in prewhitening.prewhiten(catalogue, limit=2).collect()}
    assert found["slow", 1].frequency == pytest.approx(0.31, abs=1e-3) and found["fast", 1].frequency == pytest.approx(9.7, abs=1e-3) and found["lattice", 1].frequency == pytest.approx(0.3, abs=1e-2)
    assert found["one", 0].status == "no component" and found["flat", 0].status == "no component"
    rows = lambda df: sorted((r.object_id, r["rank"], round(r.frequency or 0, 9)) for r in df.collect())
    whole = rows(batch.prewhiten_run(catalogue, f"{tmp_path}/a", limit=2))
    batch.prewhiten_run(catalogue, f"{tmp_path}/b", chunks=3, only=[1], limit=2)
    assert rows(batch.prewhiten_run(catalogue, f"{tmp_path}/b", chunks=3, limit=2)) == whole
    with pytest.raises(ValueError):
        batch.prewhiten_run(catalogue, f"{tmp_path}/b", limit=3)


def test_objects_without_trials_are_failures(spark, catalogue, tmp_path, monkeypatch):
    short = spark.createDataFrame([("short", "g", 0.01 * i, float(i % 3), 0.1, i) for i in range(9)], SCHEMA)
    sink = f"{tmp_path}/s"
    batch.run(short.unionByName(catalogue.where("object_id = 'slow'")), ["bls"], sink)
    assert {(r.object_id, r.reason) for r in spark.read.parquet(f"{sink}/failures").collect()} == {("short", "bls: no trial period within the baseline")}
    big = grids.checked(grids.gls_grid(catalogue), 300, refuse=False)
    assert {r.object_id: r.reason for r in grids.without_trials(catalogue, big).collect()} == {"one": "no trial period within the baseline", "slow": "its grid exceeds the largest size", "fast": "its grid exceeds the largest size"}
