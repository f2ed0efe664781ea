"""Fits with fixed, tied and bounded parameters: against linear solutions, repeated noise and their limits."""

import math

import numpy as np
import pytest

from lumenfold.operators import constrained, natural_fit
from lumenfold.operators.constrained import Constraints
from lumenfold.operators.natural_fit import Held

F0 = np.array([0.731, 1.9])


def curve(seed=0, n=300, noise=0.1, group=False):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(-45, 45, n))
    g = rng.integers(0, 2, n)
    return t, 3 + 5 * g * group + 1.2 * np.sin(2 * np.pi * F0[0] * t + 0.4) + 0.5 * np.sin(2 * np.pi * F0[1] * t - 1) + rng.normal(0, noise, n), np.ones(n), g


def test_free_fit_equals_variable_projection():
    t, y, w, g = curve(group=True)
    c = Constraints(offsets=True)
    r = natural_fit.fit(t, y, w, F0 + 0.001, c, group=g)
    now, beta, where, rss, m = constrained.fit(t, y, w, F0 + 0.001, c, g)
    np.testing.assert_allclose(r["frequency"], now, atol=1e-8)
    assert r["rss"] == pytest.approx(rss) and r["parameters"] == m == 8 and r["offsets"] == pytest.approx(beta[:2], abs=1e-6)
    np.testing.assert_allclose(r["amplitude"], [math.hypot(beta[j], beta[j + 1]) for j, in where], rtol=1e-6)


def test_held_values_stay_and_cost_nothing():
    t, y, w, _ = curve()
    r = natural_fit.fit(t, y, w, F0, held=Held(amplitude={1: 0.5}, phase={0: 0.4}))
    assert r["amplitude"][1] == 0.5 and r["phase"][0] == 0.4 and r["parameters"] == 1 + 2 + 1 + 1
    assert math.isnan(r["amplitude_error"][1]) and math.isnan(r["phase_error"][0]) and r["amplitude"][0] == pytest.approx(1.2, abs=0.05)
    free = natural_fit.fit(t, y, w, F0)
    assert free["rss"] <= r["rss"] and set(r["names"]) == {"c0", "f0", "f1", "a0", "p1"}


def test_bounds_hold_and_have_no_error():
    t, y, w, _ = curve()
    r = natural_fit.fit(t, y, w, np.array([0.729, 1.9]), held=Held(bounds={0: (0.727, 0.7295), 1: (1.8, 2.0)}))
    assert r["frequency"][0] == 0.7295 and r["at_bound"] == [0] and math.isnan(r["frequency_error"][0]) and r["frequency_error"][1] > 0
    inside = natural_fit.fit(t, y, w, np.array([0.735, 1.9]), held=Held(bounds={0: (0.7, 0.76)}))
    assert inside["frequency"][0] == pytest.approx(F0[0], abs=1e-3) and inside["at_bound"] == []


def test_ties_carry_their_errors():
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(-45, 45, 300))
    y = np.sin(2 * np.pi * 0.5 * t) + 0.4 * np.sin(2 * np.pi * 1.0 * t + 1) + rng.normal(0, 0.1, 300)
    r = natural_fit.fit(t, y, np.ones(300), np.array([0.501, 1.0]), Constraints(ties={1: ({0: 2}, 0.0)}))
    assert r["frequency"][1] == pytest.approx(2 * r["frequency"][0]) and r["frequency_error"][1] == pytest.approx(2 * r["frequency_error"][0])
    fixed = natural_fit.fit(t, y, np.ones(300), np.array([0.5, 1.0]), Constraints(fixed=frozenset({0, 1})))
    assert fixed["parameters"] == 5 and np.isnan(fixed["frequency_error"]).all()


def test_errors_are_calibrated():
    found = [natural_fit.fit(*curve(s)[:3], F0) for s in range(60)]
    for key, truth in (("frequency", F0), ("amplitude", [1.2, 0.5]), ("phase", [0.4, -1.0])):
        z = np.array([(r[key] - truth) / r[f"{key}_error"] for r in found])
        assert 0.75 < z.std() < 1.3, key


def test_refusals():
    t, y, w, _ = curve(n=6)
    for c, h, text in ((Constraints(), Held(amplitude={5: 1.0}), "no component"), (Constraints(), Held(bounds={0: (2.0, 1.0)}), "empty"), (Constraints(fixed=frozenset({0})), Held(bounds={0: (0.1, 1.0)}), "not free"), (Constraints(vary=frozenset({0})), Held(), "variation"), (Constraints(), Held(), "parameters for")):
        with pytest.raises(ValueError, match=text):
            natural_fit.fit(t, y, w, F0, c, h)


def test_catalogue(spark):
    t, y, _, g = curve(group=True)
    rows = [("a", "xy"[k], float(p), float(q), None, i) for i, (p, q, k) in enumerate(zip(t, y, g))] + [("few", "x", float(i), 1.0, None, i) for i in range(5)]
    o = spark.createDataFrame(rows, "object_id string, band string, t double, y double, dy double, rid long")
    c = spark.createDataFrame([(k, i, float(f) + 0.001) for k in ("a", "few") for i, f in enumerate(F0)], "object_id string, component int, f double")
    got = natural_fit.fit_objects(o, c, Constraints(offsets=True), subset="band").orderBy("component").collect()
    assert [r.object_id for r in got] == ["a", "a"] and got[0].frequency == pytest.approx(F0[0], abs=1e-3) and got[0].parameters == 8 and not got[0].at_bound
    near = natural_fit.fit_objects(o, c, reach=1e-4, held=Held(amplitude={1: 0.5})).orderBy("component").collect()
    assert near[0].at_bound and near[0].frequency_error is None and near[1].amplitude == 0.5
