"""Measured windows and alias reports, trends between bins, wavelets on own frequencies, floors of amplitudes, chances of any multi-band model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import ephemeris, kernels, multiband, readouts, spectra, windows

SCHEMA = "object_id string, band string, t double, y double, dy double, rid long"


@pytest.fixture(scope="module")
def nightly(spark):
    """Eight hours a night: the window has its peaks at one and two cycles a day."""
    rng = np.random.default_rng(0)
    t = np.sort(np.repeat(np.arange(30.0), 6) + rng.uniform(0, 0.33, 180))
    y = np.sin(2 * np.pi * 0.37 * t) + rng.normal(0, 0.05, 180)
    rows = [("n", "gr"[i % 2], float(a), float(b), 0.1, i) for i, (a, b) in enumerate(zip(t, y))] + [("one", "g", 1.0, 1.0, None, 0), ("short", "g", 0.0, 1.0, None, 0), ("short", "g", 0.1, 2.0, None, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_window_of_a_sampling(spark, nightly):
    r = readouts.measured_window_peaks(nightly).orderBy("rank").collect()
    assert {x.object_id for x in r} == {"n"} and r[0].f == pytest.approx(1.0, abs=0.01) and r[1].f == pytest.approx(2.0, abs=0.02)
    assert r[0].ratio == 1.0 and 0 < r[1].ratio < 1
    p = nightly.where("object_id = 'n'").orderBy("t").toPandas()
    assert r[0].amplitude == pytest.approx(abs(np.mean(np.exp(2j * np.pi * r[0].f * p.t.to_numpy()))), abs=1e-9)


def test_alias_report_follows_the_sampling(spark, nightly):
    s = spectra.gls(nightly.where("object_id = 'n'"), 600)
    got = {r.kind: r for r in readouts.alias_report(nightly, s).collect()}
    assert got["window 1 +1"].f_peak == pytest.approx(1.37, abs=0.02) and got["window 1 -1"].f_peak == pytest.approx(0.63, abs=0.02)
    assert 0.2 < got["window 1 +1"].relative <= 1 and got["window 1 +1"].predicted == pytest.approx(1.37, abs=0.02)
    assert "harmonic 2" in got and got["harmonic 2"].relative < 0.3


def test_trend_between_bins(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 50, 200))
    t = t[(t < 20) | (t > 30)]  # a gap that the line bridges
    y = np.cos(t / 9) + rng.normal(0, 0.01, len(t))
    o = spark.createDataFrame([("a", "g", float(p), float(q), None, i) for i, (p, q) in enumerate(zip(t, y))] + [("b", "g", 0.0, 3.0, None, 0), ("b", "g", 0.1, 5.0, None, 1)], SCHEMA)
    nodes = windows.binned_trend(o.where("object_id = 'a'"), 4.0).where("n >= 3").orderBy("t").collect()
    want = np.interp(t, [r.t for r in nodes], [r.y for r in nodes])
    got = windows.interpolated_trend(o, 4.0, 3).orderBy("object_id", "t").collect()
    np.testing.assert_allclose([r.trend for r in got if r.object_id == "a"], want, atol=1e-9)
    assert [r.trend for r in got if r.object_id == "b"] == [4.0, 4.0]


def test_wavelets_on_own_frequencies(spark):
    o = spark.createDataFrame([(k, "g", float(i) * s, float(np.sin(i * s)), None, i) for k, s in (("a", 0.5), ("b", 0.9)) for i in range(60)], SCHEMA)
    got = windows.wwz(o, 4, fmax=0.4)
    for key, step in (("a", 0.5), ("b", 0.9)):
        f = readouts.wavelet_frequencies(59 * step, 0.4)
        mine = {(r.i, r.k): (round(r.f, 9), round(r.power, 6)) for r in got.where(F.col("object_id") == key).collect()}
        want = {(r.i, r.k): (round(r.f, 9), round(r.power, 6)) for r in windows.wwz(o.where(F.col("object_id") == key), 4, f).collect()}
        assert mine == want and len({k for _, k in mine}) == len(f)
    assert windows.wwz(o, 3).count() > 0


def test_floor_of_an_amplitude(spark):
    rng = np.random.default_rng(2)
    t, sigma = np.sort(rng.uniform(0, 4000, 60)), 0.002
    o = spark.createDataFrame([("a", float(x), sigma) for x in t] + [("yearly", 365.0 * i, sigma) for i in range(12)], "object_id string, t double, sigma double")
    got = {(r.object_id, r.outer_period): r.sigma for r in ephemeris.amplitude_floor(o, [900.0, 365.0, 4000.0]).collect()}
    x = (t - t.mean()) / (np.ptp(t) / 2)
    for period in (900.0, 4000.0):
        th = 2 * np.pi * (t - t.mean()) / period
        a = np.column_stack([np.ones(60), x, x * x, np.cos(th), np.sin(th)]) / sigma
        v = np.diag(np.linalg.inv(a.T @ a))
        assert got["a", period] == pytest.approx(np.sqrt((v[3] + v[4]) / 2), rel=1e-6)
    assert got["yearly", 365.0] == float("inf") and got["a", 4000.0] > got["a", 900.0]
    assert spark.range(1).select(ephemeris.threshold(F.lit(2e-9), 4.0).alias("x")).first().x == pytest.approx(8e-9)


@pytest.mark.parametrize("model", ["offsets", "flexible", "mhaov", "bls"])
def test_chance_of_any_model(spark, nightly, model):
    grid = spark.createDataFrame([("n", 0.3, 0.002, 60)], "object_id string, f0 double, df double, nf long")
    r = multiband.bootstrap_fap(nightly, resamples=19, model=model, grid=grid, levels=(0.1, 0.5)).collect()
    assert [x.object_id for x in r] == ["n"] and r[0].level_10 >= r[0].level_50 > 0
    if model != "bls":
        assert r[0].fap == pytest.approx(0.05) and r[0].power > r[0].level_10
    again = multiband.bootstrap_fap(nightly, resamples=19, model=model, grid=grid, levels=(0.1, 0.5)).collect()
    assert again == r
    with pytest.raises(ValueError):
        multiband.bootstrap_fap(nightly, 10, model="tls")


def test_bass_smooths():
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 40, 150))
    y = np.sin(2 * np.pi * t / 1.7) + rng.normal(0, 0.6, 150)
    f = np.array([1 / 1.7])
    plain, none, much = (kernels.supersmoother(t, y, None, f, **k)[0] for k in ({}, {"bass": 0.0}, {"bass": 9.5}))
    assert plain == none and much < plain  # a longer span follows noise less
