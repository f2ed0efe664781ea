"""What an object costs: the work of kernels is counted, and results equal the plain form."""

import numpy as np
import pytest

from lumenfold.operators import constrained, folds, kernels, light_time, models, multiband, nufft, period_laws


def _curve(n: int = 67, seed: int = 3, span: float = 30.0):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, span, n))
    return t, 10 + np.sin(2 * np.pi * t / 0.7) + rng.normal(0, 0.3, n), rng.uniform(0.1, 1.0, n)


@pytest.mark.parametrize("nf", [16, 601, 840])
def test_products_are_direct_sums(nf):
    t, y, _ = _curve()
    f = 0.03 + np.arange(nf) / 150
    direct = np.exp(2j * np.pi * np.outer(f, t)) @ y
    near = nufft.Products(t, *nufft.uniform(f), nf)
    assert np.abs(near.sums(y)[0] - direct).max() < 1e-10
    assert np.abs(near.doubled().sums(y)[0] - np.exp(4j * np.pi * np.outer(f, t)) @ y).max() < 1e-10


def test_even_trials_need_few_exponentials(monkeypatch):
    """drift_rates, F2: a rate's spectrum took a cosine and a sine of every point and trial."""
    t, y, dy = _curve()
    f, seen = 0.03 + np.arange(601) / 300, []
    for name in ("cos", "sin", "exp"):
        plain = getattr(np, name)
        monkeypatch.setattr(np, name, lambda x, *a, plain=plain, **k: (seen.append(np.size(x)), plain(x, *a, **k))[1])
    kernels.gls(t - t[0], y, dy, f)
    assert sum(seen) < 0.3 * len(t) * len(f)


def _boxes_by_hand(b, a, v, slots, wrapped, lengths, floor):
    """Every start and length of one trial."""
    h = np.zeros((2, slots + 2))
    np.add.at(h[0], b, a)
    np.add.at(h[1], b, v)
    h[:, slots - wrapped : slots] = h[:, 1 : wrapped + 1]
    c, best, total = np.cumsum(h, axis=1), None, v.sum()
    for kd in sorted(lengths):
        for i in range(slots - kd + 1):
            ina, inv = c[:, i + kd] - c[:, i]
            if ina <= 0 and inv >= floor and total - inv >= floor and (best is None or ina * ina / (inv * (total - inv)) > best[0] * (1 + 1e-9)):
                best = ina * ina / (inv * (total - inv)), i, kd
    return best


@pytest.mark.parametrize("n", [1, 2, 9, 40])
def test_runs_of_points_give_the_best_box(n):
    """box_search_default, F8, and long_period_boxes, F20: also with equal bins, points at the ends, and lengths that are no neighbours."""
    rng, slots, lengths = np.random.default_rng(n), np.array([53, 60, 57, 53, 55, 58]), np.array([3, 4, 9])
    b = np.stack([rng.integers(1, s - 4, n) for s in slots])
    b[1, : n // 2] = 7
    b[2, 0] = slots[2] - 5
    b[3] = rng.choice([1, 2, slots[3] - 5, slots[3] - 6], n)
    v = rng.uniform(0.5, 2, n)
    a = (y := rng.normal(0, 1, n) * v) - v * y.sum() / v.sum()
    found = folds.box_runs(b, a, v, slots, 5, lengths, 1e-12)
    for r in range(len(b)):
        hand = _boxes_by_hand(b[r], a, v, slots[r], 5, lengths, 1e-12)
        assert (found[1][r] < 0) == (hand is None)
        if hand:
            assert found[0][r] == pytest.approx(hand[0], rel=1e-8) and (found[1][r], found[2][r]) == hand[1:]


def test_residuals_of_nothing_have_one_sign(spark):
    """correlation_factor, F14: a value equal to its object's mean was above or below it by the order of the sum."""
    rows = [("a", float(i), i, r) for i, r in enumerate([-1.0, 0.0, -1e-17, 1.0, -1e-17, -1.0])]
    found = models.correlation_factor(spark.createDataFrame(rows, "object_id string, t double, rid long, residual double")).first()
    assert found["n_runs"] == 3 and found["factor"] == 1.0


def test_shapes_by_transforms_are_direct_sums():
    """transit_search_default, F7, and long_period_transits, F19."""
    rng, bins, g = np.random.default_rng(5), 64, (0.5, 1.0, 0.8)
    a, v = rng.normal(0, 1, (3, bins)), rng.uniform(0, 2, (3, bins)) * (rng.uniform(size=(3, bins)) < 0.4)
    a *= v > 0
    fall, num, d = folds.residues(np.fft.rfft(a, axis=1), np.fft.rfft(v, axis=1), bins, v.sum(), g)
    around = np.stack([np.roll(np.eye(bins), j, axis=1) for j in range(3)])
    one, two = np.tensordot(g, around, 1), np.tensordot(np.square(g), around, 1)
    dd = v @ two.T - (v @ one.T) ** 2 / v.sum()
    want = np.where((a @ one.T < 0) & (v @ two.T > 1e-9), (a @ one.T) ** 2 / np.where(dd > 1e-9, dd, 1), 0)
    assert np.abs(num - a @ one.T).max() < 1e-9 and np.abs(fall - want).max() < 1e-6


def test_folds_stay_in_cache(monkeypatch):
    """long_period_transits, F19: folds of 2,048 trials at once were 4 MB an array."""
    t, y, dy = _curve()
    most, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, w=None, minlength=0: (most.append(minlength), plain(x, w, minlength))[1])
    kernels.tls(t - t[0], y, dy, 0.07 + np.arange(1200) / 3000)
    assert max(most) <= kernels.CACHED


def test_orbits_from_all_starts_at_once(monkeypatch):
    """eccentric_orbits, F10: 240 starts and all slopes were solved one by one."""
    rng = np.random.default_rng(8)
    t = np.sort(rng.uniform(0, 100, 14))
    joint = light_time._Joint(t - t.mean(), rng.normal(0, 1, 14), rng.uniform(0.5, 2, 14), 1)
    p = np.column_stack([rng.uniform(20, 90, 30), rng.uniform(0, 0.95, 30), rng.uniform(-1, 2, 30)])
    assert np.abs(joint.left_rows(p) - np.stack([joint.left(q) for q in p])).max() < 1e-9
    calls = []
    monkeypatch.setattr(light_time, "orbit_columns", lambda *a, plain=light_time.orbit_columns: (calls.append(1), plain(*a))[1])
    found = light_time.search(t, np.sin(t / 9) + rng.normal(0, 0.1, 14), None, 0.25, 1, True)
    assert found["reason"] is None and len(calls) < 50


@pytest.mark.parametrize("offsets", [False, True])
def test_resamples_are_fitted_together(monkeypatch, offsets):
    """resampled_errors, F5: each resample was a fit of its own."""
    t, y, dy = _curve()
    w, c, group = 1 / dy**2, constrained.Constraints(ties={1: ({0: 2}, 0.0)}, offsets=offsets), np.arange(len(t)) % 3
    rows = y + np.random.default_rng(1).normal(0, 0.3, (12, len(t)))
    f, beta = constrained.fit_rows(t, rows, w, np.array([1.43, 2.86]), c, group, 15)
    for k, v in enumerate(rows):
        one = constrained.fit(t, v, w, np.array([1.43, 2.86]), c, group, 15)
        assert np.allclose(f[k], one[0], rtol=1e-7) and np.allclose(beta[k], one[1], rtol=1e-4, atol=1e-6)
    calls, plain = [], np.linalg.lstsq
    monkeypatch.setattr(np.linalg, "lstsq", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
    constrained.wild_errors(t, y, w, np.array([1.43, 2.86]), c, 50, 0, group)
    assert len(calls) < 150


def test_draws_share_their_times(monkeypatch):
    """multiband_chances, F29: each draw summed and solved what depends on times alone again."""
    t, y, _ = _curve()
    f, rng = 0.03 + np.arange(60) / 150, np.random.default_rng(2)
    bands = [(t[b::3], np.stack([rng.permutation(y[b::3]) for _ in range(5)])) for b in range(3)]
    bands[0][1][2] = 4.0  # a draw of one value only
    want = np.stack([multiband.aov([(tau, v[k], None) for tau, v in bands], f) for k in range(5)])
    calls, plain = [], np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda *a: (calls.append(1), plain(*a))[1])
    assert np.allclose(multiband.aov_rows(bands, f), want, rtol=1e-9)
    assert len(calls) == 3


def test_slopes_of_a_law_are_one_evaluation(monkeypatch):
    """period_law_ladder, F4: each slope was two evaluations of its law, also where a step had failed."""
    t = np.linspace(0, 30, 11)
    track = period_laws._Track(t, 0.25 + 0.001 * np.sin(t), None)
    for law, m in period_laws.LAWS.items():
        q = np.random.default_rng(m).uniform(0.2, 0.9, (6, 4)) + np.array([0, 0, 0, 1.2])
        q[0, 2:] = 0.0, 2.0
        assert np.allclose(track.model_rows(law, q[:, :m]), [track.model(law, x) for x in q[:, :m]], rtol=1e-12)
    calls = []
    monkeypatch.setattr(period_laws, "change", lambda *a, plain=period_laws.change: (calls.append(1), plain(*a))[1])
    track.fit("power")
    assert len(calls) < 550  # 196 of the grid, one a step
