"""Drift searches with any statistic, and the resumable catalogue of period changes."""

import math

import numpy as np
import pytest

from lumenfold.operators import drift, kernels
from lumenfold.plans import period_changes

SCHEMA = "object_id string, band string, t double, y double, dy double, rid long"


def drifting(seed=0, n=500, span=400.0, period=0.8, rate=2e-5, noise=0.05, shape=lambda p: np.sin(2 * np.pi * p)):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, span, n))
    tau = t - t.mean()
    return t, shape(np.log1p(rate * tau) / rate / period if rate else tau / period) + rng.normal(0, noise, n)


@pytest.mark.parametrize("method", sorted(drift.SHARPNESS))
def test_planted_rate_with_every_statistic(method):
    t, y = drifting(n=260, span=150.0, rate=3e-4, shape=lambda p: np.where(np.mod(p, 1) < 0.4, 1.0, 0.0) + 0.3 * np.sin(2 * np.pi * p))
    r = drift.search(t, y, None, 1 / 0.8, method, n_rates=14 if method == "gls" else 36 if method == "mhaov" else 60, reach=6.0)
    assert r["reason"] is None and abs(r["rate"] - 3e-4) < 3e-5 and r["period"] == pytest.approx(0.8, rel=1e-3)
    better = r["power"] < r["steady_power"] if method in kernels.MINIMISED else r["power"] > r["steady_power"]
    assert better


def test_steps_follow_the_statistic():
    t, y = drifting(n=60, span=100.0)
    step = {m: drift.search(t, y, None, 1.25, m, n_rates=1, reach=3.0)["rate_step"] for m in ("gls", "mhaov", "pdm")}
    assert step["gls"] == pytest.approx(3 * step["mhaov"]) and step["gls"] == pytest.approx(5 * step["pdm"])
    assert drift.search(t, y, None, 1.25, "mhaov", n_rates=1, reach=3.0, harmonics=2)["rate_step"] == pytest.approx(step["gls"] / 2)
    with pytest.raises(ValueError):
        drift.search(t, y, None, 1.25, "bls")
    with pytest.raises(ValueError):
        drift.search(t, y, None, 1.25, model="cubic")


def test_rows_equal_single_spectra():
    t, y = drifting(n=80, span=60.0)
    tau, f = t - t.mean(), np.linspace(1.0, 1.5, 40)
    rates = np.array([-1e-4, 0.0, 1e-4])
    for method in ("gls", "pdm"):
        rows = drift.power_rows(tau, y, None, f, rates, method)
        for row, a in zip(rows, rates):
            copy = tau if a == 0 else np.log1p(a * tau) / a
            np.testing.assert_allclose(row, kernels.METHODS[method](copy - copy[0], y, None, f))
    e = drift.bent(tau, 1e-4, "exponential")
    np.testing.assert_allclose(e, (1 - np.exp(-1e-4 * tau)) / 1e-4)


def test_odd_objects_have_a_reason(spark):
    rows = [("ok", "g", float(a), float(b), None, i) for i, (a, b) in enumerate(zip(*drifting(n=60, span=50.0)))]
    rows += [("few", "g", float(i), 1.0, None, i) for i in range(3)] + [("still", "g", 1.0, float(i), None, i) for i in range(9)] + [("lost", "g", float(i), float(i % 2), None, i) for i in range(20)]
    o = spark.createDataFrame(rows, SCHEMA)
    seeds = spark.createDataFrame([("ok", 1.25), ("few", 1.0), ("still", 1.0)], "object_id string, f double")
    got = {r.object_id: r for r in drift.rate_search(o, seeds, n_rates=2).collect()}
    assert {k: r.reason for k, r in got.items()} == {"ok": None, "few": "under 8 points", "still": "no time baseline", "lost": "no seed period"}
    assert got["lost"].f is None and got["ok"].rates == 5
    s = drift.surface(o, seeds, n_rates=2).where("object_id = 'ok'")
    assert s.count() == 5 * s.select("k").distinct().count() and s.agg({"power": "max"}).first()[0] == pytest.approx(got["ok"].power)


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = []
    for key, rate in (("still", 0.0), ("drifts", 2e-5), ("other", 1e-5)):
        t, y = drifting(seed=len(key), rate=rate, n=400, span=300.0)
        rows += [(key, "g", float(a), float(b), 0.05, i) for i, (a, b) in enumerate(zip(t, y))]
    rows += [("few", "g", 1.0, 1.0, 0.1, 0), ("flat", "g", 1.0, 1.0, 0.1, 0)] + [("flat", "g", 1.0, 1.0, 0.1, i) for i in range(1, 12)]
    return spark.createDataFrame(rows, SCHEMA)


SETTINGS = {"period": 0.8, "segments": 12, "per_interval": 40}


def collected(tables):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return {k: sorted((tuple(clean(v) for v in r) for r in df.collect()), key=repr) for k, df in tables.items()}


def test_chain_and_resume(spark, catalogue, tmp_path):
    whole = collected(period_changes.run(catalogue, f"{tmp_path}/a", **SETTINGS))
    s = {r[0]: dict(zip(["object_id", *period_changes.TABLES["summary"]], r)) for r in whole["summary"]}
    assert {k: r["status"] for k, r in s.items()} == {"still": "ok", "drifts": "ok", "other": "ok", "few": "under 8 points", "flat": "no time baseline"}
    for key, rate in (("still", 0.0), ("drifts", 2e-5)):
        assert abs(s[key]["track_pdot"] - rate * 0.8) < 5 * s[key]["track_pdot_error"] and s[key]["seed_source"] == "given"
        assert s[key]["n_segments"] == 12 and s[key]["n_intervals"] == 10
    assert s["drifts"]["track_f_tail"] < 1e-6 and s["still"]["track_f_tail"] > 1e-4
    assert s["drifts"]["law"] in ("linear", "exponential", "singular") and s["drifts"]["profile_change"] > 1e-3
    assert len(whole["oc"]) == 36 and len(whole["profile"]) == 30
    # killed between chunks, then resumed; then run once more with nothing to do
    period_changes.run(catalogue, f"{tmp_path}/b", chunks=3, only=[0], **SETTINGS)
    assert collected(period_changes.run(catalogue, f"{tmp_path}/b", chunks=3, **SETTINGS)) == whole
    assert collected(period_changes.run(catalogue, f"{tmp_path}/b", chunks=2, **SETTINGS)) == whole
    # a lost file: the objects in it are done again and replace their rows
    lost = next((tmp_path / "b/rows").glob("attempt=0/kind=oc/*.parquet"), None) or next((tmp_path / "b/rows").glob("attempt=*/kind=oc/*.parquet"))
    lost.unlink()
    assert collected(period_changes.run(catalogue, f"{tmp_path}/b", **SETTINGS)) == whole
    with pytest.raises(ValueError, match="other settings"):
        period_changes.run(catalogue, f"{tmp_path}/b", period=0.9)


def test_seeds_by_object_and_stages_switched_off(spark, catalogue):
    seeds = spark.createDataFrame([("still", 0.8), ("drifts", float("nan"))], "object_id string, period double")
    rows = period_changes.tagged_rows(catalogue, seeds, profile=False, orbit=False, segments=8)
    got = {r.object_id: r for r in period_changes.table(rows, "summary").collect()}
    assert got["still"].seed_source == "given" and got["drifts"].seed_source == "search" and got["other"].seed_source == "search"
    assert got["other"].search_period == pytest.approx(0.8, rel=2e-3)
    assert got["still"].law is None and got["still"].orbit_period is None and got["still"].n_intervals == 0
    with pytest.raises(ValueError):
        period_changes.tagged_rows(catalogue, color="red")
    with pytest.raises(ValueError):
        period_changes.tagged_rows(catalogue, method="tls")


def test_detrending_keeps_the_signal():
    t, y = drifting(rate=0.0, n=600, span=100.0)
    flat = period_changes.detrended(t, y + 0.05 * t, 10.0)
    assert abs(np.polyfit(t, flat, 1)[0]) < 2e-3 and np.std(flat) == pytest.approx(np.std(y), rel=0.1)
