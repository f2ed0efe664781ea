"""Automatic grids, partitions and fast sums against plain NumPy."""

import numpy as np
import pytest

from lumenfold.operators import grids, kernels, nufft, windows

OBS = "object_id string, band string, t double, y double, dy double, rid long"


def points(spark, curves):
    rows = [(o, "b", float(t), float(np.sin(t)), 1.0, i) for o, ts in curves.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, OBS)


def test_sums_by_fft_equal_direct_sums():
    rng = np.random.default_rng(0)
    t, c = rng.uniform(-3, 50, 300), rng.normal(size=(2, 300))
    f0, df, nf = 0.37, 0.0123, 4001
    want = c @ np.exp(2j * np.pi * np.outer(t, f0 + df * np.arange(nf)))
    got = nufft.sums(t, c, f0, df, nf)
    assert np.abs(got - want).max() < 1e-9 * np.abs(c).sum(axis=1).max()
    assert nufft.uniform(f0 + df * np.arange(nf)) == pytest.approx((f0, df)) and nufft.uniform(np.array([1.0, 2.0, 4.0])) is None


@pytest.mark.parametrize("method", ["gls", "mhaov"])
def test_long_grids_equal_short_ones(method, monkeypatch):
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 90, 250))
    t -= t[0]
    y, dy = np.cos(2 * np.pi * t / 1.9) + rng.normal(0, 0.2, 250), rng.uniform(0.1, 0.4, 250)
    f = 0.02 + 0.002 * np.arange(1500)
    fast = kernels.METHODS[method](t, y, dy, f)
    monkeypatch.setattr(kernels, "FFT_FROM", 10**12)
    slow = kernels.METHODS[method](t, y, dy, f)
    assert np.allclose(fast, slow, rtol=1e-7, atol=1e-9)


def test_lattice_is_found_and_irregular_times_are_none(spark):
    rng = np.random.default_rng(2)
    lattice = 0.25 * np.sort(rng.choice(400, 90, replace=False))
    nightly = np.concatenate([k + rng.uniform(0, 0.3) + 0.02 * np.arange(10) for k in range(12)])
    got = {r.object_id: r for r in grids.lattice_nyquist(points(spark, {"lattice": lattice + 7.0, "random": rng.uniform(0, 30, 80), "few": [1.0, 2.0, 3.0], "nightly": np.sort(nightly)})).collect()}
    assert set(got) == {"lattice"}
    assert got["lattice"].nyquist == pytest.approx(2.0) and got["lattice"].coherence == pytest.approx(1.0)
    g = {r.object_id: r for r in grids.gls_grid(points(spark, {"lattice": lattice})).collect()}["lattice"]
    assert g.fmax == pytest.approx(2.0) and g.f0 == pytest.approx(1 / (lattice[-1] - lattice[0]))


def test_visits_of_exposures_lower_the_ceiling(spark):
    rng = np.random.default_rng(3)
    nights = np.sort(rng.choice(3000, 300, replace=False)).astype(float)
    triplets = np.sort(np.concatenate([nights + k * 5e-4 for k in range(3)]))
    got = {r.object_id: r.fmax for r in grids.pseudo_nyquist(points(spark, {"triplets": triplets, "single": nights, "one": [4.0], "same": [4.0, 4.0]})).collect()}
    gap = np.median(np.diff(nights))
    assert got["single"] == pytest.approx(2.5 / gap)
    assert got["triplets"] == pytest.approx(max(1e5 / np.ptp(triplets), 2.5 / gap))
    assert got["one"] == got["same"] == 5.0


def test_too_large_grids_are_refused(spark):
    o = points(spark, {"a": np.linspace(0, 100, 50)})
    with pytest.raises(Exception, match="exceeds"):
        grids.checked(grids.gls_grid(o), limit=3).collect()
    assert not grids.gls_grid(o).first()["large"]
    with pytest.raises(ValueError):
        grids.default_grid(o, "nothing")


def test_box_segments_cover_the_periods(spark):
    rows = grids.box_segments(points(spark, {"a": np.linspace(0, 30, 40), "short": [0.0, 0.3]})).orderBy("segment").collect()
    assert [r.object_id for r in rows] == ["a"] * len(rows)
    assert rows[0].p_lo == 0.2 and rows[-1].p_hi == pytest.approx(15.0)
    assert all(a.p_hi == pytest.approx(b.p_lo) for a, b in zip(rows, rows[1:]))
    for r in rows:
        f = np.arange(1 / r.p_hi, 1 / r.p_lo, r.df)
        assert abs(r.nf - len(f[f < 1 / r.p_lo])) <= 1


def test_search_on_the_automatic_grid_finds_a_short_period(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 29, 70))
    rows = [("a", "b", float(x), float(np.sin(2 * np.pi * x / 0.31)), 0.1, i) for i, x in enumerate(t)]
    for method in ("gls", "Lomb-Scargle"):
        best = kernels.periodogram(spark.createDataFrame(rows, OBS), method).first()
        assert best.period == pytest.approx(0.31, rel=0.01)
    with pytest.raises(ValueError):
        kernels.get_method("gls", bins=3)
    with pytest.raises(ValueError):
        kernels.get_method("fourier")


def test_windows_reach_the_end(spark):
    t = np.arange(0, 24.01, 0.5)
    o = points(spark, {"a": t, "short": [0.0, 1.0], "tiled": np.arange(0, 20.1, 1.0)})
    w = [(r.object_id, r.w_idx, r.w_start, r.is_last) for r in windows.window_starts(o, 10.0, 5.0).orderBy("object_id", "w_idx").collect()]
    assert w == [("a", 0, 0.0, False), ("a", 1, 5.0, False), ("a", 2, 10.0, False), ("a", 3, 14.0, True), ("tiled", 0, 0.0, False), ("tiled", 1, 5.0, False), ("tiled", 2, 10.0, True)]
    copies = windows.in_windows(o, 10.0, 5.0).where("object_id = 'a'").groupBy("w_idx").count().collect()
    assert {r.w_idx: r["count"] for r in copies} == {0: 20, 1: 20, 2: 20, 3: 21}


def test_small_subsets_go_to_the_nearer_neighbour(spark):
    t = [0, 0.1, 0.2, 5.0, 6.0, 6.1, 6.2, 20.0]
    o = windows.gap_partition(points(spark, {"a": t}), 0.5)
    got = {r.t: r.subset for r in windows.merged_small(o, 3).collect()}
    assert [got[x] for x in t] == [0, 0, 0, 1, 1, 1, 1, 1]
    got = {r.t: r.subset for r in windows.joined_runs(o, 6.0).collect()}
    assert [got[x] for x in t] == [0, 0, 0, 0, 1, 1, 1, 2]


def test_partitions_are_suggested(spark):
    rng = np.random.default_rng(5)
    nights = np.concatenate([k + rng.uniform(0, 0.3, 20) for k in range(8)])
    seasons = np.concatenate([400 * k + np.sort(rng.uniform(0, 200, 400)) for k in range(3)])
    sectors = np.concatenate([28 * k + np.arange(0, 26, 0.1) for k in range(4)])
    got = {r.object_id: r.kind for r in windows.suggest_partition(points(spark, {"n": nights, "s": seasons, "x": sectors, "one": np.arange(0, 9, 0.1)})).collect()}
    assert got == {"n": "night", "s": "season", "x": "sector", "one": None}
