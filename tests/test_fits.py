"""Constrained fits, resampled errors, ephemerides, drift searches, joint boxes, readouts and inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import constrained, ephemeris, grids, kernels, multiband, period_change, readouts
from lumenfold.sources import observations

OBS = "object_id string, band string, t double, y double, dy double, rid long"


def test_ties_hold_and_bad_ones_are_refused():
    rng = np.random.default_rng(0)
    t = np.sort(rng.uniform(-20, 20, 400))
    group = rng.integers(0, 2, 400)
    y = 3.0 * group + np.cos(2 * np.pi * 0.7 * t) + 0.4 * np.sin(2 * np.pi * 1.4 * t + 0.3) + rng.normal(0, 0.05, 400)
    c = constrained.Constraints(ties={1: ({0: 2}, 0.0)}, offsets=True)
    f, beta, where, rss, m = constrained.fit(t, y, np.ones(400), np.array([0.702, 1.3]), c, group)
    assert f[1] == pytest.approx(2 * f[0]) and f[0] == pytest.approx(0.7, abs=1e-4) and m == 7
    assert np.hypot(beta[where[0][0]], beta[where[0][0] + 1]) == pytest.approx(1.0, abs=0.02)
    assert beta[1] - beta[0] == pytest.approx(3.0, abs=0.02) and rss / 400 == pytest.approx(0.05**2, rel=0.2)
    fixed = constrained.fit(t, y, np.ones(400), np.array([0.71, 1.4]), constrained.Constraints(fixed=frozenset({0}), offsets=True), group)
    assert fixed[0][0] == 0.71 and fixed[3] > rss
    vary = constrained.fit(t, y, np.ones(400), np.array([0.7, 1.4]), constrained.Constraints(vary=frozenset({0}), offsets=True), group)
    assert len(vary[2][0]) == 2 and vary[3] <= constrained.fit(t, y, np.ones(400), np.array([0.7, 1.4]), constrained.Constraints(offsets=True), group)[3] + 1e-9
    for bad in (constrained.Constraints(ties={0: ({1: 1}, 0.0), 1: ({0: 1}, 0.0)}), constrained.Constraints(fixed=frozenset({5})), constrained.Constraints(ties={1: ({0: 2}, 0.0)}, fixed=frozenset({1}))):
        with pytest.raises(ValueError):
            bad.validate(2)


def test_resampled_errors_match_the_scatter_of_repeats():
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(-15, 15, 120))
    found, errors = [], None
    for k in range(60):
        y = np.cos(2 * np.pi * 0.43 * t) + rng.normal(0, 0.2, 120)
        found.append(constrained.fit(t, y, np.ones(120), np.array([0.43]))[0][0])
        errors = errors if k else constrained.wild_errors(t, y, np.ones(120), np.array([0.43]), resamples=100)[0][0]
    assert errors == pytest.approx(np.std(found), rel=0.4)


def test_polynomial_ephemerides_equal_numpy(spark):
    rng = np.random.default_rng(2)
    e = np.sort(rng.choice(2000, 60, replace=False)).astype(float)
    oc = 0.01 + 2e-5 * e + 3e-8 * e**2 + rng.normal(0, 0.002, 60)
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(e, oc)] + [("b", 0.0, 0.1), ("b", 1.0, 0.2)], "object_id string, e double, oc double")
    rows = {r.degree: r for r in ephemeris.fits(df).where("object_id = 'a'").collect()}
    assert ephemeris.fits(df).where("object_id = 'b'").count() == 0
    for d, r in rows.items():
        want = np.polynomial.polynomial.polyfit(e, oc, d)
        assert [r.c0, r.c1, r.c2, r.c3][: d + 1] == pytest.approx(want, rel=1e-5)
        assert r.chi2 == pytest.approx(np.sum((oc - np.polynomial.polynomial.polyval(e, want)) ** 2), rel=1e-6)
    assert rows[2].p_value < 1e-6 < rows[3].p_value
    best = ephemeris.best_fit(ephemeris.fits(df)).first()
    assert best.degree == 2
    got = ephemeris.best_fit(ephemeris.fits(df)).select(ephemeris.predict(F.lit(1000.0)).alias("p"), ephemeris.implied_model().alias("m"), ephemeris.scaled_error().alias("s")).first()
    assert got.p == pytest.approx(0.01 + 0.02 + 0.03, abs=0.002) and got.m == "constant" and got.s > 0


def test_drift_is_found(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 200, 300))
    a = 2e-4
    centred = t - t.mean()
    y = np.cos(2 * np.pi * 0.8 * np.log1p(a * centred) / a) + rng.normal(0, 0.1, 300)
    obs = spark.createDataFrame([("x", "b", float(u), float(v), 0.1, i) for i, (u, v) in enumerate(zip(t, y))] + [("few", "b", 0.0, 1.0, 0.1, 0)], OBS)
    seeds = spark.createDataFrame([("x", 0.801), ("few", 1.0)], "object_id string, f double")
    rows = period_change.rate_search(obs, seeds).collect()
    assert [r.object_id for r in rows] == ["x"]
    assert rows[0].f == pytest.approx(0.8, abs=5e-4) and rows[0].rate == pytest.approx(a, rel=0.15) and rows[0].power > rows[0].steady_power + 0.1


def test_joint_box_finds_what_single_bands_share():
    rng = np.random.default_rng(4)
    bands = []
    for level in (10.0, 4.0):
        t = np.sort(rng.uniform(0, 40, 150))
        bands.append((t, level - 0.1 * (np.mod(t, 2.5) < 0.15) + rng.normal(0, 0.02, 150), np.full(150, 0.02)))
    f = 1 / np.linspace(2.0, 3.0, 101)
    assert 1 / f[np.argmax(multiband.joint_box(bands, f))] == pytest.approx(2.5, abs=0.02)
    one = multiband.joint_box(bands[:1], f)
    assert np.corrcoef(one, kernels.bls(*bands[0], f))[0, 1] > 0.95


def test_readouts(spark):
    s = spark.createDataFrame([("a", k, 0.1 * k, p) for k, p in enumerate([1.0, 5.0, 2.0, 4.0])], "object_id string, k int, f double, power double")
    assert [r.score for r in readouts.peak_score(s).orderBy("k").collect()] == [0.2, 1.0, 0.4, 0.8]
    assert [r.score for r in readouts.peak_score(s, "min").orderBy("k").collect()] == [1.0, 0.0, 0.75, 0.25]
    mass = spark.range(1).select(readouts.minimum_third_mass(F.lit(0.02), F.lit(1.5)).alias("m"), readouts.mass_function(F.lit(0.004), F.lit(800.0)).alias("f")).first()
    assert mass.m**3 / (1.5 + mass.m) ** 2 == pytest.approx(0.02) and mass.f == pytest.approx((0.004 * 173.1446) ** 3 / (800 / 365.25) ** 2, rel=1e-4)
    f0, df, nf = readouts.frequency_window(2.0, 10.0)
    assert f0 == pytest.approx(0.01) and f0 + df * (nf - 1) <= 5.0 + 1e-9
    assert readouts.wavelet_frequencies(20.0, 1.0)[0] == 0.1 and readouts.drift_rates(2, 1.0, 10.0) == pytest.approx([-0.016, -0.008, 0.0, 0.008, 0.016])
    o = spark.createDataFrame([("a", 1.0, 100.0, 1.0, "flux", 0), ("a", 2.0, 20.0, 0.01, "magnitude", 1), ("a", 3.0, -1.0, 1.0, "flux", 2)], "object_id string, t double, y double, dy double, domain string, rid int")
    rows = readouts.in_domain(o, "magnitude").orderBy("rid").collect()
    assert rows[0].y == pytest.approx(20.0) and rows[1].y == 20.0 and rows[2].y is None
    back = readouts.in_domain(readouts.in_domain(o, "magnitude"), "flux").orderBy("rid").first()
    assert back.y == pytest.approx(100.0) and back.dy == pytest.approx(1.0)


def test_inputs_and_sinks(spark, tmp_path):
    for name, v in (("a", 1.0), ("b", 2.0)):
        (tmp_path / f"{name}.csv").write_text(f"time,flux\n1.0,{v}\n2.0,{v}\n")
    (tmp_path / "all.lst").write_text("# curves\na.csv\nb.csv\na.csv\n")
    paths = observations.list_inputs(spark, [f"file://{tmp_path}/all.lst", f"file://{tmp_path}/results"])
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a.csv", "b.csv"]
    got = observations.read_inputs(spark, f"file://{tmp_path}/all.lst")
    assert sorted((r.object_id, r.y) for r in got.collect()) == [("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0)]
    assert got.select("rid").distinct().count() == 4 and got.select("source").distinct().count() == 2
    rows = spark.createDataFrame([("=cmd", 1.5)], "key string, x double")
    assert observations.write_rows(rows, None) is rows
    assert observations.write_rows(rows, f"{tmp_path}/out.csv").first().key == "'=cmd"
    assert observations.write_rows(rows, f"{tmp_path}/out").first().key == "=cmd"
    with pytest.raises(ValueError):
        observations.read_inputs(spark, [])


def test_tied_fits_by_object(spark):
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, 30, 80))
    y = np.cos(2 * np.pi * 0.9 * t) + 0.3 * np.cos(2 * np.pi * 1.8 * t) + rng.normal(0, 0.05, 80)
    obs = spark.createDataFrame([("x", "gr"[i % 2], float(u), float(v + i % 2), 0.05, i) for i, (u, v) in enumerate(zip(t, y))], OBS)
    seeds = kernels.best_periods(obs, "gls", grid=grids.gls_grid(obs)).select("object_id", "f")
    rows = constrained.harmonic_fits(obs, seeds, 2, band_offsets=True, resamples=20).orderBy("component").collect()
    assert rows[1].frequency == pytest.approx(2 * rows[0].frequency) and rows[0].amplitude == pytest.approx(1.0, abs=0.1) and rows[0].frequency_error > 0
