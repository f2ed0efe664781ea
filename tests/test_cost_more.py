"""What an object costs, continued: kernels that score, evaluate or fit less at a time, with the results of the plain form."""

import numpy as np
import pandas as pd
import pytest

from lumenfold.operators import box_search, folds, kernels, light_time, period_laws, spread, tracking, transit_search
from lumenfold.operators.boxes import limb_darkened
from lumenfold.plans import period_changes


def _curve(n: int = 67, seed: int = 3, span: float = 30.0):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, span, n))
    return t, 10 + np.sin(2 * np.pi * t / 0.7) + rng.normal(0, 0.3, n), rng.uniform(0.1, 1.0, n)


def test_remainders_are_exact():
    """box_search_default, F1: folding took a fifth of the time of its boxes."""
    rng = np.random.default_rng(0)
    tau, p = np.r_[0, np.sort(rng.uniform(0, 30, 200)), 15.0, 30.0], np.r_[rng.uniform(0.2, 16, 500), 0.25, 15.0, 30 / 7]
    assert np.array_equal(folds.remainders(tau, p), np.mod(tau[None, :], p[:, None]))
    assert np.array_equal(folds.remainders(1e9 * tau, p), np.mod(1e9 * tau[None, :], p[:, None]))


@pytest.mark.parametrize("likelihood", [False, True])
@pytest.mark.parametrize("n", [2, 13, 70])
def test_bounds_lose_no_box(n, likelihood):
    """box_search_default, F1: all runs of all starts were scored."""
    rng = np.random.default_rng(n)
    slots = rng.integers(210, 400, 60)
    b = np.stack([rng.integers(1, s - 9, n) for s in slots])
    b[:5] = np.sort(rng.integers(1, 40, (5, n)), axis=1)  # many points in a box, and in a bin
    v = 10.0 ** rng.uniform(-3, 1, n)
    y = np.round(rng.normal(0, 1, n), 1)
    a = v * (y - v @ y / v.sum())
    args = b, a, v, slots, 10, np.array([10, 11, 13, 15, 24]), 1e-12, likelihood
    want = folds._all_runs(*args)
    got = folds.box_runs(*args)
    assert np.array_equal(got[1], want[1]) and np.array_equal(got[2], want[2])
    assert all(np.allclose(x, y, rtol=1e-9, atol=1e-12) for x, y in zip(got, want, strict=True))


def test_values_of_one_level_keep_their_boxes():
    t, _, dy = _curve()
    found = box_search.boxes(t, np.full(len(t), 3.0), dy, np.array([2.0, 3.0]), box_search.durations(2.0))
    assert np.all(np.abs(found["depth"]) < 1e-9)


@pytest.mark.parametrize("n", [3, 20, 67, 120])
def test_bounds_lose_no_shape(n):
    """transit_search_default, F3: all shapes at all starts were summed up at every trial."""
    t, y, dy = _curve(n, n)
    if n == 20:
        t = np.r_[t[:19] / 100, 30.0]  # nearly all points in one window
    p = 1 / (0.07 + np.arange(600) / 3000)
    shapes = tuple(tuple(limb_darkened(k)) for k in transit_search.widths())
    w = 1 / dy**2
    assert folds.few_points(w, 256, shapes)
    got = folds.shape_powers(t - t[0], p, w * (y - w @ y / w.sum()), w, 256, shapes)
    assert np.allclose(got, transit_search.transits(t - t[0], y, dy, p)["power"], rtol=1e-6, atol=1e-9)
    assert np.allclose(got, transit_search.powers(t - t[0], y, dy, p), rtol=1e-9)
    assert not folds.few_points(np.r_[w, 1e-12], 256, shapes) and not folds.few_points(np.ones(200), 256, shapes)


def test_few_points_need_no_transforms(monkeypatch):
    """long_period_transits, F6: fifteen transforms a trial."""
    t, y, dy = _curve()
    f, sums, plain = 0.07 + np.arange(600) / 3000, [], np.fft.irfft
    want = transit_search.transits(t - t[0], y, dy, 1 / f)["power"]
    monkeypatch.setattr(np.fft, "irfft", lambda *a, **k: (sums.append(1), plain(*a, **k))[1])
    assert np.allclose(kernels.tls(t - t[0], y, dy, f), (want - want.mean()) / want.std(), rtol=1e-9, atol=1e-9) and not sums


def _oc_tables(n: int):
    rng = np.random.default_rng(8)
    t = [np.sort(rng.uniform(0, 100, 14 - i % 3)) for i in range(n)]
    return [(x, np.sin(x / 9) + rng.normal(0, 0.1, len(x)), None, 0.25) for x in t]


@pytest.mark.parametrize("eccentric", [False, True])
def test_orbits_of_many_tables_at_once(monkeypatch, eccentric):
    """eccentric_orbits, F2: the steps of each object were calls of their own."""
    tables = [*_oc_tables(12), (np.zeros(3), np.zeros(3), None, 0.25)]
    want = [light_time.search(*x, degree=1, eccentric=eccentric) for x in tables]
    calls, plain = [], light_time._left
    monkeypatch.setattr(light_time, "_left", lambda *a: (calls.append(1), plain(*a))[1])
    got = light_time.search_tables(tables, 1, eccentric)
    assert len(calls) < 500
    assert [r["reason"] for r in got] == [r["reason"] for r in want]
    for a, b in zip(got[:-1], want[:-1], strict=True):
        assert a["chi2"] == pytest.approx(b["chi2"], rel=1e-5) and a["outer_period"] == pytest.approx(b["outer_period"], rel=1e-4)
    by_degree = light_time.search_tables(tables[:2], None, eccentric)
    assert [r["degree"] for r in by_degree] == [light_time.search(*x, degree=None, eccentric=eccentric)["degree"] for x in tables[:2]]


def test_kepler_rows_are_kepler():
    rng = np.random.default_rng(0)
    m, e = np.r_[rng.uniform(-10, 10, 500), rng.normal(0, 1e-3, 500), 0.0, np.pi], np.r_[rng.uniform(0, 0.95, 500), np.full(502, 0.95)]
    assert np.abs(light_time.kepler_rows(m[:, None], e)[:, 0] - [light_time.kepler(np.array([x]), y)[0] for x, y in zip(m, e, strict=True)]).max() < 1e-12


def test_blocks_hold_whole_objects(spark):
    """eccentric_orbits, F2: also where an object's points come in several batches, and without a name."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"o{i % 9}" if i % 9 else None, float(i)) for i in range(200)]
        dealt = spread.deal_objects(spark.createDataFrame(rows, "object_id string, t double"))
        count = lambda objects: pd.DataFrame({"object_id": [o["object_id"].iloc[0] for o in objects], "n": [len(o) for o in objects], "s": [o["t"].sum() for o in objects], "block": len(objects)})
        got = {r.object_id: r for r in spread.in_blocks(dealt, count, "object_id string, n long, s double, block long", 2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: (r.n, r.s) for k, r in got.items()} == {k: (len(x), sum(x)) for k in [None, *(f"o{i}" for i in range(1, 9))] for x in [[v for n, v in rows if n == k]]}
    assert max(r.block for r in got.values()) <= 2


def test_laws_of_many_tracks_at_once(monkeypatch):
    """period_law_ladder, F5, and period_changes, F4: the steps of each track and law were calls of their own."""
    rng, laws = np.random.default_rng(4), (*period_laws.AUTO, "power")
    tables = [(np.sort(rng.uniform(0, 30, n)), 0.25 + 0.003 * rng.normal(size=n), rng.uniform(0.001, 0.01, n) if n % 2 else None) for n in (1, 2, 4, 9, 10, 14, 15)]
    one = [period_laws.compare(*x, laws) for x in tables]
    calls, plain = [], period_laws._Tracks.model
    monkeypatch.setattr(period_laws._Tracks, "model", lambda *a: (calls.append(1), plain(*a))[1])
    many = period_laws.compare_tables(tables, laws)
    assert len(calls) < 1300
    assert [sorted(r["law"] for r in x) for x in many] == [sorted(r["law"] for r in x) for x in one]
    for a, b in zip(many, one, strict=True):
        b = {r["law"]: r for r in b}
        assert all(r["chi2"] == pytest.approx(b[r["law"]]["chi2"], rel=1e-6, abs=1e-18) and r["pinned"] == b[r["law"]]["pinned"] for r in a)


def test_intervals_of_a_profile_at_once(monkeypatch):
    """period_law_ladder, F5: each trial of each interval was a decomposition of its own."""
    t, y, _ = _curve()
    monkeypatch.setattr(np.linalg, "qr", lambda *a: (_ for _ in ()).throw(AssertionError("decomposed")))
    for harmonics in (1, 2):
        got = tracking.period_profile(t, y, 0.7, 9, harmonics)
        assert len(got) == 7
        for (s, n, mid, p, _), a, b in zip(got, np.linspace(0, 67, 8).astype(int)[:-1], np.linspace(0, 67, 8).astype(int)[1:], strict=True):
            tau = t[a:b] - t[a]
            grid = 1 / 0.7 + np.linspace(-1, 1, 201) / tau[-1]
            columns = lambda f: np.column_stack([np.ones(len(tau)), *(fn(2 * np.pi * h * f * tau) for h in range(1, harmonics + 1) for fn in (np.cos, np.sin))])
            chi = [np.sum((y[a:b] - columns(f) @ np.linalg.lstsq(columns(f), y[a:b], rcond=None)[0]) ** 2) for f in grid]
            assert (n, mid) == (b - a, t[a:b].mean()) and abs(1 / p - grid[np.clip(np.argmin(chi), 1, 199)]) < grid[1] - grid[0]


def test_changes_of_many_objects_at_once(monkeypatch):
    """period_changes, F4: orbits and laws of each object were calls of their own; an object that fails ends no other."""
    curves = [_curve(n, n) for n in (5, 60, 80, 90)]
    settings = {"n_rates": 3, "segments": 10, "per_interval": 8}
    want = [period_changes.analyse(*x, None, settings) for x in curves]
    orbits, plain = [], period_changes.light_time.search_tables
    monkeypatch.setattr(period_changes.light_time, "search_tables", lambda *a: (orbits.append(len(a[0])), plain(*a))[1])
    got = period_changes.analyse_many([(*x, None) for x in curves], settings)
    assert orbits == [3] and [len(x) for x in got] == [len(x) for x in want]
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x.keys() == y.keys()
            assert all(v == y[k] or v == pytest.approx(y[k], rel=1e-6, nan_ok=True) for k, v in x.items() if not isinstance(v, str))
    mid = next(r["mid"] for r in want[2] if r["kind"] == "oc")

    def failing(tables):
        if any(mid in x[0] for x in tables):
            raise ValueError("no orbit")
        return plain(tables)

    monkeypatch.setattr(period_changes.light_time, "search_tables", failing)
    again = period_changes.analyse_many([(*x, None) for x in curves], settings)
    assert [x[0]["status"] for x in again] == ["under 8 points", "ok", "failed: no orbit", "ok"]


def test_best_periods_come_in_blocks(spark):
    """long_period_transits, F6: each object was a frame, a call and an answer of its own."""
    t, y, dy = _curve(20)
    obs = spark.createDataFrame([(o, float(a), float(b), float(c), i) for o in ("a", "b") for i, (a, b, c) in enumerate(zip(t, y, dy, strict=True))], "object_id string, t double, y double, dy double, rid long")
    found = kernels.best_periods(obs, "tls", 30)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    assert [r.object_id for r in found.orderBy("object_id").collect()] == ["a", "b"] and found.select("k", "power").distinct().count() == 1
