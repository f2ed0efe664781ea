"""Light-time orbits: planted ones, the scan against plain least squares, predictions, and the chain from a phase track."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import physics
from lumenfold.operators import light_time, tracking

SCHEMA = "object_id string, t double, y double, dy double"


def delay(t, period, amplitude, omega, e, periastron):
    """The formula with the true anomaly, Kepler's equation by halving."""
    m = np.mod(2 * np.pi * (t - periastron) / period, 2 * np.pi)
    lo, hi = np.zeros(len(t)), np.full(len(t), 2 * np.pi)
    for _ in range(80):
        x = (lo + hi) / 2
        lo, hi = np.where(x - e * np.sin(x) < m, x, lo), np.where(x - e * np.sin(x) < m, hi, x)
    nu = 2 * np.arctan2(np.sqrt(1 + e) * np.sin(x / 2), np.sqrt(1 - e) * np.cos(x / 2))
    return amplitude * ((1 - e * e) / (1 + e * np.cos(nu)) * np.sin(nu + omega) + e * np.sin(omega))


def planted(seed=1, n=120, e=0.4, noise=2e-4, c2=1e-9):
    rng = np.random.default_rng(seed)
    t = 2455000 + np.sort(rng.uniform(0, 5000, n))
    dt = t - t.mean()
    return t, 0.002 + 1e-6 * dt + c2 * dt**2 + delay(t, 1500.0, 0.01, 0.8, e, 2455300.0) + rng.normal(0, noise, n), np.full(n, noise)


@pytest.mark.parametrize("e", [0.0, 0.1, 0.5, 0.9, 0.995])
def test_kepler(e):
    m = np.linspace(-10, 20, 500)
    x = light_time.kepler(m, e)
    np.testing.assert_allclose(x - e * np.sin(x), np.mod(m, 2 * np.pi), atol=1e-12)
    if e < 1:
        np.testing.assert_allclose(light_time.orbit_columns(m, 7.0, e, 1.0) @ [math.cos(0.7), math.sin(0.7)], delay(m, 7.0, 1.0, 0.7, e, 1.0), atol=1e-9)


def test_eccentric_orbit_is_recovered():
    t, oc, error = planted()
    r = light_time.search(t, oc, error, 0.5, 2, True)
    assert r["reason"] is None and r["parameters"] == 8
    for key, want, floor in (("outer_period", 1500.0, 0), ("amplitude", 0.01, 0), ("eccentricity", 0.4, 0), ("omega", 0.8, 0)):
        assert abs(r[key] - want) < 4 * r[f"{key}_error"] + floor, key
    assert abs((r["periastron"] - 2455300 + 750) % 1500 - 750) < 4 * r["periastron_error"]
    assert r["pdot"] == pytest.approx(2 * 0.5 * 1e-9, abs=4 * r["pdot_error"]) and 0.6 < r["chi2"] / (120 - 8) < 1.5
    assert r["delta_bic"] > 100 and r["f_tail"] < 1e-10
    circular = light_time.search(t, oc, error, 0.5, 2, False)
    assert circular["chi2"] > r["chi2"] and circular["eccentricity"] == 0
    assert light_time.search(t, oc, error, 0.5, None, True)["degree"] == 2
    held = light_time.search(t, oc, error, 0.5, 2, True, outer_period=1500.0)
    assert held["outer_period"] == 1500 and math.isnan(held["outer_period_error"]) and held["parameters"] == 7


def test_errors_are_those_of_repeated_noise():
    found = [light_time.search(*planted(seed, noise=5e-4)[:2], np.full(120, 5e-4), 0.5, 2, True) for seed in range(12)]
    for key in ("outer_period", "amplitude", "eccentricity", "omega"):
        spread, stated = np.std([r[key] for r in found], ddof=1), np.median([r[f"{key}_error"] for r in found])
        assert 0.4 < spread / stated < 2.5, key


def test_estimated_errors_have_unit_scatter():
    t, oc, _ = planted()
    r = light_time.search(t, oc, None, 0.5, 2, True)
    assert r["chi2"] == pytest.approx(120 - 8) and r["delta_bic"] > 100
    rng = np.random.default_rng(3)
    noise = light_time.search(t, rng.normal(0, 1e-3, 120), None, 0.5, 2, False)
    assert noise["delta_bic"] < 10


def test_scan_equals_plain_least_squares():
    t, oc, error = planted(n=40)
    error = error * np.random.default_rng(2).uniform(0.5, 2, 40)
    r = light_time.search(t, oc, error, 0.5)
    f, gain = r["scan"]
    x = (t - t.mean()) / 2500
    chi = lambda cols: np.sum(((oc - np.column_stack(cols) @ np.linalg.lstsq(np.column_stack(cols) / error[:, None], oc / error, rcond=None)[0]) / error) ** 2)
    poly = [np.ones(40), x, x * x]
    for i in range(0, len(f), 7):
        th = 2 * np.pi * f[i] * (t - t.mean())
        assert gain[i] == pytest.approx(chi(poly) - chi([*poly, np.cos(th), np.sin(th)]), rel=1e-6, abs=1e-6)


def test_repeated_timings_are_one_epoch():
    t = np.repeat(np.arange(7) * 100.0, 3) + np.tile([0, 0.01, 0.02], 7)
    assert len(light_time.distinct_epochs(t, 0.5)) == 7
    assert light_time.search(t, np.zeros(21), None, 0.5)["reason"] == "under 8 distinct epochs"
    assert light_time.search(np.arange(8.0), np.arange(8.0), None, 0.5)["reason"] == "no outer period can be resolved"


def test_tables_and_predictions(spark):
    t, oc, error = planted()
    rows = [("orbit", float(a), float(b), float(c)) for a, b, c in zip(t, oc, error)] + [("few", float(i), 0.0, None) for i in range(3)] + [("orbit", None, 1.0, 1.0), ("orbit", 1.0, float("nan"), 1.0), ("flat", 5.0, 0.0, None)]
    o = spark.createDataFrame(rows, SCHEMA)
    fits = light_time.orbits(o, 0.5, eccentric=True)
    got = {r.object_id: r for r in fits.collect()}
    assert got["few"].reason and got["flat"].reason and got["few"].outer_period is None and got["orbit"].reason is None
    assert got["orbit"].eccentricity == pytest.approx(0.4, abs=0.03)
    times = spark.createDataFrame([("orbit", float(x)) for x in t[::10]], "object_id string, t double")
    at = {r.t: r for r in light_time.predict(fits, times, 0.5).collect()}
    r = got["orbit"]
    want = delay(t, r.outer_period, r.amplitude, r.omega, r.eccentricity, r.periastron)
    model = lambda x: sum(getattr(r, f"c{k}") * (x - r.t_ref) ** k for k in range(3)) + delay(x, r.outer_period, r.amplitude, r.omega, r.eccentricity, r.periastron)
    for i in range(0, len(t), 10):
        p = at[float(t[i])]
        assert p.cyclic == pytest.approx(want[i], abs=1e-9) and p.secular + p.cyclic == pytest.approx(oc[i], abs=1e-3)
        x = np.array([t[i] - 0.5, t[i] + 0.5])
        assert p.apparent_period == pytest.approx(0.5 * (1 + np.diff(model(x))[0]), rel=1e-7)
    assert light_time.scan(o.where("object_id = 'orbit'"), 0.5).orderBy(F.desc("delta_chi2")).first().outer_period == pytest.approx(1500, rel=0.05)


def test_column_delay(spark):
    df = spark.range(200).select((F.col("id") * 1.7 - 100).alias("t"))
    for e in (0.0, 0.4, 0.9):
        got = [(r.t, r.d) for r in df.select("t", physics.ltte_delay(F.col("t"), 50.0, 0.01, 0.3, e, 2.0).alias("d")).collect()]
        np.testing.assert_allclose([d for _, d in got], delay(np.array([x for x, _ in got]), 50.0, 0.01, 0.3, e, 2.0), atol=1e-10)


def test_chain_from_a_phase_track(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.uniform(0, 3000, 9000))
    late = delay(t, 900.0, 0.02, 0.5, 0.3, 100.0)
    y = np.sin(2 * np.pi * (t - late) / 0.61) + 0.3 * np.cos(4 * np.pi * (t - late) / 0.61) + rng.normal(0, 0.1, len(t))
    o = spark.createDataFrame([("s", "g", float(a), float(b), 0.1, i) for i, (a, b) in enumerate(zip(t, y))], "object_id string, band string, t double, y double, dy double, rid long")
    r = light_time.orbits(light_time.from_track(tracking.track(o, 0.61, 40)), 0.61, degree=1, eccentric=True).first()
    assert r.outer_period == pytest.approx(900, rel=0.03) and r.amplitude == pytest.approx(0.02, rel=0.1) and r.eccentricity == pytest.approx(0.3, abs=0.15)
