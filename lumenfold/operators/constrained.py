"""Multi-sine fits under constraints, and resampled errors: one grouped call per object.

Frequencies are ``f = A p + c`` of free parameters p: a tied one is an integer sum of
its parents plus a constant, a fixed one is a constant. Amplitudes and phases may
vary by subset, and each subset may have an offset of its own.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import kernels, spread


@dataclass(frozen=True)
class Constraints:
    """``ties``: child -> ({parent: integer}, constant); ``fixed``: components whose frequency stays; ``vary``: components with an amplitude and phase per subset; ``offsets``: a constant per subset."""

    ties: dict[int, tuple[dict[int, int], float]] = field(default_factory=dict)
    fixed: frozenset[int] = frozenset()
    vary: frozenset[int] = frozenset()
    offsets: bool = False

    def validate(self, k: int) -> None:
        """Refuses unknown components, ties of fixed ones, and circular ties."""
        named = {*self.ties, *self.fixed, *self.vary, *(p for parents, _ in self.ties.values() for p in parents)}
        if wrong := {i for i in named if not 0 <= i < k}:
            raise ValueError(f"no component {sorted(wrong)}")
        if both := set(self.ties) & self.fixed:
            raise ValueError(f"tied and fixed: {sorted(both)}")
        for child in self.ties:
            seen, todo = set(), [child]
            while todo:
                now = todo.pop()
                for p in self.ties.get(now, ({}, 0.0))[0]:
                    if p == child:
                        raise ValueError(f"component {child} is tied to itself")
                    if p not in seen:
                        seen.add(p)
                        todo.append(p)

    def matrix(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A, c and the first p for frequencies f."""
        k = len(f)
        free = [i for i in range(k) if i not in self.ties and i not in self.fixed]
        rows, const = np.zeros((k, len(free))), np.zeros(k)
        for j, i in enumerate(free):
            rows[i, j] = 1.0
        for i in self.fixed:
            const[i] = f[i]
        left = dict(self.ties)
        while left:
            for child, (parents, add) in list(left.items()):
                if not any(p in left for p in parents):
                    rows[child] = sum(m * rows[p] for p, m in parents.items())
                    const[child] = add + sum(m * const[p] for p, m in parents.items())
                    del left[child]
        return rows, const, f[free]


def _columns(t: np.ndarray, f: np.ndarray, group: np.ndarray, c: Constraints) -> tuple[np.ndarray, list[list[int]]]:
    """Design matrix, and for each component its (cosine, sine) columns, one pair per subset where it varies."""
    each = np.unique(group)
    cols = [(group == g).astype(float) for g in each] if c.offsets else [np.ones(len(t))]
    where: list[list[int]] = []
    for i, x in enumerate(f):
        th, own = 2 * np.pi * x * t, []
        for g in each if i in c.vary else [None]:
            mask = 1.0 if g is None else group == g
            own.append(len(cols))
            cols += [np.cos(th) * mask, np.sin(th) * mask]
        where.append(own)
    return np.column_stack(cols), where


def fit(t: np.ndarray, y: np.ndarray, w: np.ndarray, f: np.ndarray, constraints: Constraints = Constraints(), group: np.ndarray | None = None, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, list[list[int]], float, int]:
    """Frequencies, linear coefficients, their columns by component, weighted sum of squares and number of parameters: damped variable projection."""
    constraints.validate(len(f))
    group = np.zeros(len(t), dtype=np.int64) if group is None else group
    a, const, p = constraints.matrix(np.asarray(f, dtype=float))
    r = np.sqrt(w)

    def linear(p: np.ndarray):
        now = a @ p + const
        x, where = _columns(t, now, group, constraints)
        beta = np.linalg.lstsq(x * r[:, None], y * r, rcond=None)[0]
        return now, x, where, beta, float(np.sum(w * (y - x @ beta) ** 2))

    now, x, where, beta, rss = linear(p)
    damping = 1e-3
    for _ in range(rounds if len(p) else 0):
        slope = np.column_stack([sum(2 * np.pi * t * (-beta[j] * x[:, j + 1] + beta[j + 1] * x[:, j]) for j in own) for own in where]) @ a
        full = np.column_stack([x, slope]) * r[:, None]
        h, g = full.T @ full, full.T @ ((y - x @ beta) * r)
        step = np.linalg.lstsq(h + damping * np.diag(np.maximum(np.diag(h), 1e-12)), g, rcond=None)[0][x.shape[1] :]
        trial = linear(p + step)
        if trial[-1] <= rss:
            done = rss - trial[-1] <= 1e-12 * max(rss, 1e-300)
            p, damping = p + step, damping / 5
            now, x, where, beta, rss = trial
            if done:
                break
        else:
            damping *= 8
            if damping > 1e10:
                break
    return now, beta, where, rss, x.shape[1] + len(p)


def fit_rows(t: np.ndarray, y: np.ndarray, w: np.ndarray, f: np.ndarray, constraints: Constraints = Constraints(), group: np.ndarray | None = None, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """``fit`` of each row of ``y`` from the same frequencies: frequencies and linear coefficients a row. Steps are taken together, each row with a damping and an end of its own."""
    constraints.validate(len(f))
    group = np.zeros(len(t), dtype=np.int64) if group is None else group
    a, const, p0 = constraints.matrix(np.asarray(f, dtype=float))
    r = np.sqrt(w)
    each = np.unique(group)
    fixed = np.stack([(group == g).astype(float) for g in each] if constraints.offsets else [np.ones(len(t))])
    masks, where, n_cols = [], [], len(fixed)
    for i in range(len(f)):
        own = []
        for g in each if i in constraints.vary else [None]:
            masks.append((i, np.ones(len(t)) if g is None else (group == g).astype(float)))
            own.append(n_cols)
            n_cols += 2
        where.append(own)

    def columns(now: np.ndarray) -> np.ndarray:
        x = np.empty((len(now), n_cols, len(t)))
        x[:, : len(fixed)] = fixed
        th = 2 * np.pi * now[:, :, None] * t
        c, s = np.cos(th), np.sin(th)
        for k, (i, mask) in enumerate(masks):
            x[:, len(fixed) + 2 * k], x[:, len(fixed) + 2 * k + 1] = c[:, i] * mask, s[:, i] * mask
        return x

    def linear(p: np.ndarray, y: np.ndarray):
        now = p @ a.T + const
        x = columns(now)
        q, tri = np.linalg.qr((x * r).transpose(0, 2, 1))
        size = np.abs(np.einsum("kii->ki", tri))
        whole = size.min(axis=1) > 1e-10 * size.max(axis=1)
        beta = np.empty((len(p), n_cols))
        if whole.any():
            beta[whole] = np.linalg.solve(tri[whole], (q[whole].transpose(0, 2, 1) @ (y * r)[whole][:, :, None]))[:, :, 0]
        for k in np.flatnonzero(~whole):  # dependent columns: the shortest solution
            beta[k] = np.linalg.lstsq((x[k] * r).T, y[k] * r, rcond=None)[0]
        rest = y - (beta[:, None, :] @ x)[:, 0]
        return now, x, beta, rest, np.sum(w * rest**2, axis=1)

    p = np.tile(p0, (len(y), 1))
    now, x, beta, rest, rss = linear(p, y)
    damping, live = np.full(len(y), 1e-3), np.arange(len(y)) if len(p0) else np.zeros(0, dtype=int)
    for _ in range(rounds):
        if not len(live):
            break
        xl, bl = x[live], beta[live]
        slope = np.stack([sum(2 * np.pi * t * (-bl[:, j, None] * xl[:, j + 1] + bl[:, j + 1, None] * xl[:, j]) for j in own) for own in where], axis=1)
        full = np.concatenate([xl, a.T @ slope], axis=1) * r
        h = full @ full.transpose(0, 2, 1)
        g = (full @ (rest[live] * r)[:, :, None])[:, :, 0]
        at = np.arange(h.shape[1])
        h[:, at, at] += damping[live, None] * np.maximum(h[:, at, at], 1e-12)
        trial_p = p[live] + np.linalg.solve(h, g[:, :, None])[:, n_cols:, 0]
        trial = linear(trial_p, y[live])
        down = trial[-1] <= rss[live]
        done = down & (rss[live] - trial[-1] <= 1e-12 * np.maximum(rss[live], 1e-300))
        yes, no = live[down], live[~down]
        p[yes] = trial_p[down]
        for old, new in zip((now, x, beta, rest, rss), trial, strict=True):
            old[yes] = new[down]
        damping[yes] /= 5
        damping[no] *= 8
        live = live[~done & (damping[live] <= 1e10)]
    return now, beta


def wild_errors(t: np.ndarray, y: np.ndarray, w: np.ndarray, f: np.ndarray, constraints: Constraints = Constraints(), resamples: int = 200, seed: int = 0, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Standard deviations of frequencies and amplitudes over refits to the model plus residuals of random sign."""
    group = np.zeros(len(t), dtype=np.int64) if group is None else group
    now, beta, where, *_ = fit(t, y, w, f, constraints, group)
    x, _ = _columns(t, now, group, constraints)
    model, rng = x @ beta, np.random.default_rng(seed)
    rest = (y - model) * math.sqrt(len(t) / max(len(t) - x.shape[1] - len(now), 1))
    signs = np.stack([rng.choice([-1.0, 1.0], len(t)) for _ in range(resamples)])
    g, b = fit_rows(t, model + rest * signs, w, now, constraints, group, rounds=15)
    found = np.column_stack([g, *(np.hypot(b[:, own[0]], b[:, own[0] + 1]) for own in where)])
    sd = np.std(found, axis=0, ddof=1)
    return sd[: len(now)], sd[len(now) :]


ROWS = "object_id string, component long, frequency double, amplitude double, phase double, frequency_error double, amplitude_error double, rss double, parameters long, bic double"


def harmonic_fits(obs: DataFrame, seeds: DataFrame, harmonics: int = 2, band_offsets: bool = False, resamples: int = 0, seed: int = 0) -> DataFrame:
    """Components of each object: its seed frequency (object_id, f) free, and harmonics tied to it; optionally an offset per band and resampled errors."""
    columns = [c.split()[0] for c in ROWS.split(", ")]
    c = Constraints(ties={h - 1: ({0: h}, 0.0) for h in range(2, harmonics + 1)}, offsets=band_offsets)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "rid"])
        t, y, dy = kernels._points(pdf)
        n = len(t)
        if n < 2 * harmonics + 4 or t[-1] <= t[0]:
            return pd.DataFrame({x: [] for x in columns}).astype({"object_id": object, "component": "int64", "parameters": "int64"})
        w = kernels._weights(dy, n) * n
        tau = t - t.mean()
        group = pd.factorize(pdf["band"].fillna(""))[0] if band_offsets else None
        start = pdf["_f"].iloc[0] * np.arange(1, harmonics + 1)
        now, beta, where, rss, m = fit(tau, y, w, start, c, group)
        ef, ea = wild_errors(tau, y, w, now, c, resamples, zlib.crc32(str(pdf["object_id"].iloc[0]).encode()) + seed, group) if resamples else (np.full(harmonics, np.nan),) * 2
        bic = n * math.log(max(rss, 1e-300) / n) + m * math.log(n)
        rows = [(pdf["object_id"].iloc[0], i + 1, now[i], math.hypot(beta[j], beta[j + 1]), math.atan2(beta[j], beta[j + 1]), ef[i], ea[i], rss, m, bic) for i, (j, *_) in enumerate(where)]
        return pd.DataFrame(rows, columns=columns)

    joined = obs.join(seeds.selectExpr("object_id", "f AS _f"), "object_id")
    return spread.deal_objects(joined, obs).groupBy("object_id").applyInPandas(run, ROWS)
