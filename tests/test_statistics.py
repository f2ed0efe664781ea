"""Period statistics: relational plans against kernels, planted signals, odd input."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import physics, special
from lumenfold.operators import boxes, kernels, peaks, period_change, prewhitening, spectra, windows
from lumenfold.sources import observations

SCHEMA = "object_id string, band string, t double, y double, dy double, rid long"


def sine(seed=0, n=200, span=40.0, period=1.7, amp=0.4, noise=0.05, name="a"):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, span, n)) + 2458000.0
    y = 15 + amp * np.sin(2 * np.pi * t / period) + rng.normal(0, noise, n)
    return [(name, "gri"[i % 3], float(a), float(b), noise, i) for i, (a, b) in enumerate(zip(t, y))]


@pytest.fixture(scope="module")
def obs(spark):
    return spark.createDataFrame(sine() + sine(1, 60, 20.0, 0.9, name="b") + [("c", "g", 1.0, 2.0, 0.1, 0)], SCHEMA).cache()


PLANS = {"gls": lambda o: spectra.gls(o, 150), "pdm": lambda o: spectra.pdm(o, 150), "ce": lambda o: spectra.conditional_entropy(o, 150), "sl": lambda o: spectra.string_length(o, 150)}


@pytest.mark.parametrize("method", PLANS)
def test_plans_equal_kernels(obs, method):
    a = {(r.object_id, r.k): r.power for r in PLANS[method](obs).collect()}
    b = {(r.object_id, r.k): r.power for r in kernels.spectrum(obs, method, 150).collect()}
    assert a.keys() == b.keys() and {k for k, _ in a} == {"a", "b"}
    assert max(abs(a[k] - b[k]) for k in a) < 1e-7


@pytest.mark.parametrize("method", ["gls", "pdm", "ce", "sl", "mhaov", "supersmoother"])
def test_kernels_find_the_period(obs, method):
    best = {r.object_id: r.period for r in kernels.best_periods(obs, method, 400).where("rank = 1").collect()}
    for name, p in (("a", 1.7), ("b", 0.9)):
        ratio = best[name] / p
        assert min(abs(ratio - m) for m in (0.5, 1, 2, 3)) < 0.03


def test_aov_is_the_f_of_the_power(obs):
    a = {(r.object_id, r.k): r.power for r in spectra.aov(obs, 50).collect()}
    b = {(r.object_id, r.k): r.power for r in kernels.spectrum(obs, "mhaov", 50, harmonics=1).collect()}
    assert max(abs(a[k] - b[k]) / (1 + abs(b[k])) for k in a) < 1e-6


def transit(n=600, span=30.0, period=2.5, depth=0.05):
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(0, span, n))
    ph = t / period % 1
    y = 1 - depth * ((ph < 0.04) | (ph > 0.96)) + rng.normal(0, 0.005, n)
    return [("x", "g", float(a), float(b), 0.005, i) for i, (a, b) in enumerate(zip(t, y))]


@pytest.mark.parametrize("method", ["bls", "tls"])
def test_box_kernels_find_the_transit(spark, method):
    o = spark.createDataFrame(transit(), SCHEMA)
    f = 1 / kernels.best_periods(o, method, 120).first().period
    assert min(abs(f * 2.5 * m - 1) for m in (1, 2, 0.5)) < 0.03


def test_box_plans_find_the_transit(spark):
    o = spark.createDataFrame(transit(), SCHEMA)
    for df in (boxes.bls(o, 100, 50), boxes.tls(o, 100, 64)):
        p = df.orderBy(F.desc("power")).first().p
        assert min(abs(p / 2.5 - m) for m in (0.5, 1, 2, 3)) < 0.03


def test_multiband_beats_one_band(spark):
    rng = np.random.default_rng(8)
    t = np.sort(rng.uniform(0, 30, 90))
    band = rng.integers(0, 3, 90)
    y = np.array([15.0, 14.2, 13.9])[band] + 0.2 * np.sin(2 * np.pi * t / 0.7365) + rng.normal(0, 0.05, 90)
    o = spark.createDataFrame([("m", "gri"[b], float(a), float(v), 0.05, i) for i, (a, b, v) in enumerate(zip(t, band, y))], SCHEMA)
    best = peaks.best_peak(spectra.gls_offsets(o, 300)).first()
    assert abs(best.period / 0.7365 - 1) < 0.02 and best.power > 0.8
    assert peaks.best_peak(spectra.gls_per_band(o, 300)).first().power > 0.5
    for s, sense in ((spectra.pdm(o, 300, by=("object_id", "band")), "min"), (spectra.string_length(o, 300, by=("object_id", "band")), "min")):
        assert spectra.pooled(s, F.col("n")).count() == 300


def test_peaks_are_apart_and_ranked(obs):
    s = spectra.gls(obs, 300)
    got = peaks.top_peaks(s, 4, 10).where("object_id = 'a'").orderBy("rank").collect()
    assert [r.rank for r in got] == [1, 2, 3, 4]
    assert all(abs(a.k - b.k) >= 10 for i, a in enumerate(got) for b in got[:i])
    assert all(a.power >= b.power for a, b in zip(got, got[1:]))
    diverse = peaks.diverse_peaks(s, 3).where("object_id = 'a'").collect()
    assert len(diverse) == 3 and diverse[0].k == got[0].k


def test_refined_peak_is_closer(obs):
    s = spectra.gls(obs, 300)
    top = peaks.refined(s).where("object_id = 'a'").orderBy(F.desc("power")).first()
    assert abs(top.f_refined - 1 / 1.7) < 0.001 and top.f_refined != top.f


def test_prewhitening_recovers_planted_modes(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.uniform(0, 27, 500))
    planted = {2.34: 0.012, 5.81: 0.007, 8.68: 0.004}
    y = sum(a * np.sin(2 * np.pi * f * t + f) for f, a in planted.items()) + rng.normal(0, 0.0015, 500)
    o = spark.createDataFrame([("p", None, float(a), float(b), None, i) for i, (a, b) in enumerate(zip(t, y))] + [("q", None, float(i), 1.0, None, i) for i in range(9)], SCHEMA)
    rows = prewhitening.prewhiten(o, 12.0, 6).orderBy("rank").collect()
    got = [r for r in rows if r.object_id == "p"]
    assert len(got) == 3
    for r, (f, a) in zip(got, planted.items()):
        assert abs(r.frequency - f) < 5 * r.frequency_error + 1e-4 and abs(r.amplitude - a) < 5 * r.amplitude_error
    assert [r["rank"] for r in rows if r.object_id == "q"] == [0]


def test_special_functions():
    assert special.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert special.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.f_sf(4.964602743730711, 1, 10) == pytest.approx(0.05, abs=1e-9)
    assert special.f_sf(2.0, 5, 5) == pytest.approx(0.2328, abs=1e-3)
    assert special.beta_inc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-9)
    t = np.linspace(0, 10, 50)
    fap = special.baluev_fap([0.01, 0.3, 0.9], t, np.ones(50), 5.0)
    assert fap[0] > 0.99 and fap[1] > fap[2] and fap[2] < 1e-15
    assert np.isnan(special.baluev_fap(0.5, t[:3], np.ones(3), 5.0))


def test_noise_has_high_false_alarm_probability(spark):
    rng = np.random.default_rng(4)
    o = spark.createDataFrame([("n", None, float(i) + float(rng.uniform()), float(rng.normal()), None, i) for i in range(60)], SCHEMA)
    assert kernels.best_periods(o, "gls", 150).first().fap > 0.01


def test_domain_round_trip(spark):
    df = spark.createDataFrame([(15.0, 0.02), (-3.0, 0.5)], "m double, e double")
    r = df.select("*", physics.flux(F.col("m"), 25.0).alias("f"), physics.flux_error(F.col("m"), F.col("e"), 25.0).alias("fe")).withColumn("m2", physics.magnitude(F.col("f"), 25.0)).withColumn("e2", physics.magnitude_error(F.col("f"), F.col("fe"))).collect()
    for x in r:
        assert x.m2 == pytest.approx(x.m) and x.e2 == pytest.approx(x.e)
    assert df.select(physics.magnitude(F.lit(-1.0)).alias("x")).first().x is None


def test_conversions_invert(spark):
    df = spark.createDataFrame([(1e-8, 0.5, 0.4, 1.1)], "v double, p double, a double, b double")
    v, p = F.col("v"), F.col("p")
    for unit in ("s/s", "s/yr", "ms/yr", "d/yr", "d/Myr", "d/cycle", "s/cycle", "1/yr"):
        assert df.select(physics.convert_pdot(physics.convert_pdot(v, "d/d", unit, p), unit, "d/d", p).alias("x")).first().x == pytest.approx(1e-8)
    rate = physics.mass_transfer_rate(v, p, F.col("a"), F.col("b"))
    assert df.select(physics.pdot_from_mass_transfer(rate, p, F.col("a"), F.col("b")).alias("x")).first().x == pytest.approx(1e-8)
    assert df.select(physics.pdot_from_mass_loss(physics.mass_loss_rate(v, p, F.lit(2.0)), p, F.lit(2.0)).alias("x")).first().x == pytest.approx(1e-8)
    with pytest.raises(ValueError):
        physics.convert_pdot(v, "d/d", "d/cycle")


def test_light_time_delay_of_a_circle(spark):
    df = spark.createDataFrame([(float(x),) for x in range(0, 100, 7)], "dt double")
    for r in df.select("dt", physics.ltte_delay(F.col("dt"), 50.0, 0.01, 0.3, 0.0, 2.0).alias("d")).collect():
        assert r.d == pytest.approx(0.01 * math.sin(2 * math.pi * (r.dt - 2.0) / 50.0 + 0.3), abs=1e-9)


def test_drift_is_found(spark):
    rng = np.random.default_rng(3)
    t = np.sort(rng.uniform(0, 100, 300))
    a = 0.002
    y = np.sin(2 * np.pi * np.log1p(a * t) / a / 1.3)
    o = spark.createDataFrame([("d", None, float(x), float(v), None, i) for i, (x, v) in enumerate(zip(t - t[0], y))], SCHEMA)
    rates = [-0.002, 0.0, 0.002]
    best = period_change.drift_search(o, rates, 500).orderBy(F.desc("power")).first()
    assert rates[best.a_idx] == 0.002 and best.power > 0.9


def test_ephemeris_and_quadratic(spark):
    e = np.arange(40)
    t = 5.0 + 0.5 * e + 0.5 * 1e-4 * 0.5 * e**2
    o = spark.createDataFrame([("e", float(x)) for x in t], "object_id string, t double")
    fit = period_change.linear_ephemeris(o, 0.5).first()
    assert fit.n == 40 and abs(fit.period - 0.5) < 0.01
    assert period_change.quadratic_drift(period_change.residuals(o, 0.5)).first().pdot == pytest.approx(1e-4, rel=0.02)


def test_partitions(spark):
    o = spark.createDataFrame([("a", b, t, 1.0, None, i) for i, (t, b) in enumerate([(0.0, "g"), (0.1, "g"), (5.0, "r"), (5.1, "g"), (20.0, None)])], SCHEMA)
    assert [r.subset for r in windows.gap_partition(o, 1.0).orderBy("t").collect()] == [0, 0, 1, 1, 2]
    assert [r.subset for r in windows.chunk_partition(o, 5.0).orderBy("t").collect()] == [0, 0, 1, 1, 4]
    assert [r.subset for r in windows.range_partition(o, [0.1, 5.05]).orderBy("t").collect()] == [0, 1, 1, 2, 2]
    assert [(r.band, r.n) for r in windows.runs(o).orderBy("run").collect()] == [("g", 2), ("r", 1), ("g", 1), (None, 1)]


def test_constant_and_tiny_objects(spark):
    rows = [("k", "g", float(i), 3.0, 0.1, i) for i in range(12)] + [("two", "g", 0.0, 1.0, 0.1, 0), ("two", "g", 1.0, 2.0, 0.1, 1), ("same", "g", 1.0, 1.0, 0.1, 0), ("same", "g", 1.0, 2.0, 0.1, 1)]
    o = spark.createDataFrame(rows, SCHEMA)
    assert {r.power for r in spectra.gls(o, 20).where("object_id = 'k'").collect()} == {0.0}
    assert {r.power for r in spectra.conditional_entropy(o, 20).where("object_id = 'k'").collect()} == {0.0}
    assert {r.power for r in spectra.pdm(o, 20).where("object_id = 'k'").collect()} == {1.0}
    for m in kernels.METHODS:
        kernels.spectrum(o, m, 20).collect()
        assert kernels.spectrum(o.limit(0), m, 20).count() == 0
    assert prewhitening.prewhiten(o, 2.0).count() == 3


def test_cleaning_and_roles(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", "g", 1.0, 2.0, 0.1, 0), ("a", "g", nan, 2.0, 0.1, 1), ("a", "g", 1.0, None, 0.1, 2), ("a", "g", 1.0, inf, 0.1, 3), ("a", "g", 1.0, 2.0, 0.0, 4), ("a", "g", 1.0, 2.0, None, 5)]
    assert {r.rid for r in observations.clean(spark.createDataFrame(rows, SCHEMA)).collect()} == {0, 5}
    assert observations.resolve_roles(["HJD", "Vmag", "e_vmag", "Filter"]) == {"t": "HJD", "y": "Vmag", "dy": "e_vmag", "band": "Filter"}
    assert observations.resolve_roles(["time", "mag", "flux", "flux_err"])["y"] == "flux"
    assert observations.resolve_roles(["time", "mag", "flux"], "magnitude")["y"] == "mag"
    assert observations.infer_domain("sap_flux") == "flux" and observations.infer_domain("foo") == "magnitude"
    with pytest.raises(ValueError):
        observations.resolve_roles(["a", "b"])


def test_multiband_kernels(spark):
    from lumenfold.operators import multiband

    rng = np.random.default_rng(6)
    t = np.sort(rng.uniform(0, 30, 150))
    band = rng.integers(0, 3, 150)
    y = np.array([15.0, 14.2, 13.9])[band] + np.array([0.3, 0.22, 0.15])[band] * np.sin(2 * np.pi * t / 1.7365) + rng.normal(0, 0.03, 150)
    o = spark.createDataFrame([("m", "gri"[b], float(a), float(v), 0.03, i) for i, (a, b, v) in enumerate(zip(t, band, y))], SCHEMA)
    shared = {r.k: r.power for r in spectra.gls_offsets(o, 120).collect()}
    kernel = {r.k: r.power for r in multiband.spectrum(o, "offsets", 120).collect()}
    assert max(abs(shared[k] - kernel[k]) for k in shared) < 1e-8
    for m in ("offsets", "flexible", "mhaov", "supersmoother"):
        f = multiband.spectrum(o, m, 120).orderBy(F.desc("power")).first().f
        assert min(abs(1 / f / 1.7365 - k) for k in (0.5, 1, 2, 3)) < 0.03, m
    sure = multiband.bootstrap_fap(o, 120, 39).first()
    assert sure.fap == pytest.approx(1 / 40) and sure.power > sure.level_10
    assert multiband.bootstrap_fap(o, 120, 39).first() == sure


def test_fits_tables(spark, tmp_path):
    from lumenfold.sources import fits

    def cards(*lines):
        text = "".join(x.ljust(80) for x in (*lines, "END"))
        return text.ljust(-(-len(text) // 2880) * 2880).encode()

    rows = np.array([(1.0, 10.5, 3), (2.0, 11.5, 4)], dtype=[("t", ">f8"), ("f", ">f4"), ("e", ">i2")])
    primary = cards("SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0")
    table = cards("XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                   14", "NAXIS2  =                    2", "PCOUNT  =                    0", "GCOUNT  =                    1", "TFIELDS =                    3",
                  "TTYPE1  = 'TIME    '", "TFORM1  = 'D       '", "TTYPE2  = 'FLUX    '", "TFORM2  = '1E      '", "TTYPE3  = 'FLUX_ERR'", "TFORM3  = 'I       '", "TSCAL3  =                  0.1")
    (tmp_path / "star.fits").write_bytes(primary + table + rows.tobytes().ljust(2880, b"\0"))
    got = fits.read_fits(spark, str(tmp_path)).orderBy("t").collect()
    assert [(r.object_id, r.t, r.y, round(r.dy, 6)) for r in got] == [("star", 1.0, 10.5, 0.3), ("star", 2.0, 11.5, 0.4)]


def test_tracking_kernels(spark):
    from lumenfold.operators import tracking

    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 300, 1200))
    y = np.sin(2 * np.pi * t / 0.9) + 0.3 * np.sin(4 * np.pi * t / 0.9) + rng.normal(0, 0.05, 1200)
    rows = tracking.phase_track(t, y, 0.9, 6)
    assert len(rows) == 6 and max(r[3] for r in rows) - min(r[3] for r in rows) < 0.01
    for r in tracking.period_profile(t, y, 0.9, 200):
        assert abs(r[3] - 0.9) < 0.01
    x = np.linspace(0, 10, 40)
    assert tracking.compare_laws(x, 5 + 0.2 * x + rng.normal(0, 0.01, 40))[0][0] in ("linear", "exponential")
    assert tracking.compare_laws(x, 5 + rng.normal(0, 0.01, 40))[0][0] == "constant"
    oc = 0.01 * np.sin(2 * np.pi * np.arange(0, 300, 3) / 77) + rng.normal(0, 0.001, 100)
    found = tracking.cyclic_search(np.arange(0, 300, 3.0), oc)
    assert abs(found[0] / 77 - 1) < 0.05 and found[2] > 10 and found[3] < 1e-6
    assert tracking.longest_chain(np.array([1.0, 2.02, 2.5, 3.0, 4.97, 9.0]), 0.0, 1.0, 0.05) == [0, 1, 3, 4]
    assert tracking.wald(np.array([1.0, 1.0, 1.0]), np.eye(3))[1] == pytest.approx(1.0)
    assert tracking.wald(np.array([0.0, 5.0]), np.eye(2))[1] < 1e-3


def test_frequency_ties():
    from lumenfold.functions import ties

    assert ties.parse_tie("2F1 - F3") == {1: 2, 3: -1}
    assert ties.format_tie({1: 2, 3: -1}) == "2F1 - F3" and ties.parse_tie(ties.format_tie({2: -1, 4: 3})) == {2: -1, 4: 3}
    with pytest.raises(ValueError):
        ties.parse_tie("2G1")
