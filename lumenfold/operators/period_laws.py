"""Period laws fitted to tracks of measured periods: constant, linear, exponential, and two with a singular epoch.

All laws but the linear one have the form ``P = P_c exp(a g(s))`` about the middle of
the track, s in days from it. With u the inverse of the singular epoch's distance,
``g = s`` is the exponential law, ``g = s / (1 - u s)`` the law ``P0 exp(b / (t - t0))``
of a merging binary (Tylenda et al. 2011), and ``g = (1 - |1 - u s|^(1 - d)) / ((1 - d) u)``
the one of a power-law mass loss (Pejcha 2014); u = 0 joins epochs before and after
the track. For given (u, d) the law is log-linear, so a grid of them is solved at once
and damped Gauss-Newton steps finish the best. The epoch stays outside the track by
at least the median spacing of its points.

A fit that has run onto its bounds, or has over half of its change within one spacing
of an end, is pinned and ranks behind every free one. Criteria share one scale of
chi2, that of the richest free fit (never below 1 where errors are given).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spread
from .light_time import solved

#: law -> number of parameters, from plain to rich; the last one is fitted only when asked for.
LAWS = {"constant": 1, "linear": 2, "exponential": 2, "singular": 3, "power": 4}
AUTO = ("constant", "linear", "exponential", "singular")
#: Range of the exponent of the power law.
EXPONENTS = (1.05, 8.0)
#: Places of the singular epoch (in units of the bound) and exponents of the first grid.
_PLACES = np.concatenate([-np.geomspace(1, 0.02, 14), np.geomspace(0.02, 1, 14)])
_GRID = (1.2, 1.6, 2.0, 2.5, 3.5, 5.0, 7.0)
NUMBERS = ("mid", "period", "slope", "u", "exponent", "epoch", "strength", "period_error", "slope_error", "epoch_error", "exponent_error", "chi2", "rms", "bic", "bic_scaled")
FIT = "object_id string, rank long, law string, n long, parameters long, pinned boolean, " + ", ".join(f"{c} double" for c in NUMBERS)


def change(s: np.ndarray, u: float, exponent: float) -> np.ndarray:
    """g(s): the logarithm of the period over that at the middle, for unit slope."""
    if abs(u) * max(float(np.max(np.abs(s), initial=0)), 1e-300) < 1e-9:
        return np.array(s, dtype=float)
    if exponent == 2.0:
        return s / (1 - u * s)
    gap = np.log(np.abs(1 - u * s))
    return -np.expm1((1 - exponent) * gap) / ((1 - exponent) * u)


def change_rows(s: np.ndarray, u: np.ndarray, exponent: np.ndarray) -> np.ndarray:
    """``change`` for rows of (u, exponent), with points of all or of each row."""
    out = np.array(np.broadcast_to(np.asarray(s, dtype=float), (len(u), np.shape(s)[-1])))
    bent = np.abs(u) * np.maximum(np.max(np.abs(s), axis=-1, initial=0), 1e-300) >= 1e-9
    for rows, square in ((bent & (exponent == 2.0), True), (bent & (exponent != 2.0), False)):
        if rows.any():
            v, d = u[rows, None], exponent[rows, None]
            at = np.broadcast_to(s, out.shape)[rows]
            gap = 1 - v * at
            out[rows] = at / gap if square else -np.expm1((1 - d) * np.log(np.abs(gap))) / ((1 - d) * v)
    return out


class _Track:
    def __init__(self, t: np.ndarray, p: np.ndarray, error: np.ndarray | None) -> None:
        good = np.isfinite(t) & np.isfinite(p) & (p > 0)
        if error is not None and np.isfinite(error).any():
            good &= np.isfinite(error) & (error > 0)
        order = np.argsort(t[good], kind="stable")
        self.t, self.p = t[good][order], p[good][order]
        self.given = error is not None and bool(np.isfinite(error).any())
        self.n = len(self.t)
        if not self.n:
            return
        self.lo, self.hi = float(self.t[0]), float(self.t[-1])
        self.span = max(self.hi - self.lo, 1e-6)
        self.floor = max(float(np.median(np.diff(self.t))), 1e-9) if self.n > 1 else self.span
        self.mid = (self.lo + self.hi) / 2
        self.s = self.t - self.mid
        self.u_most = 1 / (self.span / 2 + self.floor)
        if self.given:
            self.sigma = error[good][order]
        else:  # a common error of the size of the scatter about a line: it decides nothing but when steps end
            rest = self.p - np.polyval(np.polyfit(self.s / self.span, self.p, min(1, len(np.unique(self.t)) - 1)), self.s / self.span)
            self.sigma = np.full(self.n, max(float(np.sqrt(np.mean(rest**2))), 1e-12 * max(float(self.p.max()), 1.0)))

    def model(self, law: str, q: np.ndarray, s: np.ndarray | None = None) -> np.ndarray:
        """Periods for (P_c, slope * span[, u / bound[, exponent]])."""
        s = self.s if s is None else s
        if law == "constant":
            return np.full(len(s), q[0])
        if law == "linear":
            return q[0] + q[1] / self.span * s
        u, d = (q[2] * self.u_most if len(q) > 2 else 0.0), (q[3] if len(q) > 3 else 2.0)
        with np.errstate(over="ignore", invalid="ignore"):
            return q[0] * np.exp(np.clip(q[1] / self.span * change(s, u, d), -60, 60))

    def model_rows(self, law: str, q: np.ndarray) -> np.ndarray:
        """``model`` at the track's points for each row of parameters."""
        return _Tracks([self]).model(law, q, np.zeros(len(q), dtype=int))

    def fit(self, law: str) -> tuple[np.ndarray, float, np.ndarray]:
        """(parameters, chi2, covariance) of a law."""
        q, chi, cov = _Tracks([self]).fit(law)
        return q[0], float(chi[0]), cov[0]


class _Tracks:
    """Tracks side by side, so that a law's steps are those of all. Rows are filled up with points of infinite error."""

    def __init__(self, tracks: list[_Track]) -> None:
        size = max(t.n for t in tracks)
        self.p, self.s, self.sigma = np.ones((len(tracks), size)), np.zeros((len(tracks), size)), np.full((len(tracks), size), np.inf)
        for i, t in enumerate(tracks):
            self.p[i, : t.n], self.s[i, : t.n], self.sigma[i, : t.n] = t.p, t.s, t.sigma
        self.n, self.span, self.u_most, self.lo, self.hi, self.floor, self.mid = (np.array([getattr(t, c) for t in tracks]) for c in ("n", "span", "u_most", "lo", "hi", "floor", "mid"))
        ends = [t.t[[0, 1, -2, -1]] if t.n > 1 else t.t[[0, 0, 0, 0]] for t in tracks]
        near = np.column_stack([self.lo, self.lo + self.floor, self.hi - self.floor, self.hi])
        self.ends = np.where((self.span > 2 * self.floor)[:, None], near, np.array(ends)) - self.mid[:, None]

    def model(self, law: str, q: np.ndarray, of: np.ndarray, s: np.ndarray | None = None) -> np.ndarray:
        """Periods at the points of tracks ``of`` for rows of (P_c, slope * span[, u / bound[, exponent]])."""
        s = (self.s if s is None else s)[of]
        if law == "constant":
            return np.broadcast_to(q[:, :1], s.shape)
        if law == "linear":
            return q[:, :1] + q[:, 1:2] / self.span[of, None] * s
        u = q[:, 2] * self.u_most[of] if q.shape[1] > 2 else np.zeros(len(q))
        d = q[:, 3] if q.shape[1] > 3 else np.full(len(q), 2.0)
        with np.errstate(all="ignore"):
            return q[:, :1] * np.exp(np.clip(q[:, 1:2] / self.span[of, None] * change_rows(s, u, d), -60, 60))

    def starts(self, law: str) -> np.ndarray:
        """(track, start, parameter): where the steps of each track begin."""
        w = 1 / self.sigma**2
        if law == "constant":
            return ((self.p * w).sum(axis=1) / w.sum(axis=1))[:, None, None]
        if law == "linear":
            x = self.s / self.span[:, None]
            xm, pm = ((v * w).sum(axis=1) / w.sum(axis=1) for v in (x, self.p))
            xc = x - xm[:, None]
            slope = (xc * w * (self.p - pm[:, None])).sum(axis=1) / np.maximum((xc * xc * w).sum(axis=1), 1e-300)
            return np.column_stack([pm - slope * xm, slope])[:, None, :]
        grid = np.array([(0.0, 2.0)] if law == "exponential" else [(v, d) for v in _PLACES for d in (_GRID if law == "power" else (2.0,))])
        of = np.repeat(np.arange(len(self.p)), len(grid))
        u, d = np.tile(grid, (len(self.p), 1)).T
        base, slope, chi = (x.reshape(len(self.p), len(grid)) for x in self._log_linear(change_rows(self.s[of], u * self.u_most[of], d), of))
        slope = slope * self.span[:, None]
        if law == "exponential":
            return np.stack([base, slope], axis=2)
        best = np.stack([np.argmin(np.where(np.sign(grid[:, 0]) == side, chi, np.inf), axis=1) for side in (-1, 1)], axis=1)
        found = np.concatenate([np.stack([np.take_along_axis(x, best, axis=1) for x in (base, slope)], axis=2), grid[best]], axis=2)
        return found[:, :, : LAWS[law]]

    def _log_linear(self, g: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P_c, slope, chi2) of the log-linear fit for each row g."""
        w, y = ((self.p / self.sigma) ** 2)[of], np.log(self.p)[of]
        total = w.sum(axis=1)
        mean, my = (g * w).sum(axis=1) / total, (y * w).sum(axis=1) / total
        gc = g - mean[:, None]
        slope = np.where((v := (gc * gc * w).sum(axis=1)) > 0, (gc * (y - my[:, None]) * w).sum(axis=1) / np.maximum(v, 1e-300), 0.0)
        base = np.exp(my - slope * mean)
        fit = base[:, None] * np.exp(np.clip(slope[:, None] * g, -60, 60))
        return base, slope, (((self.p[of] - fit) / self.sigma[of]) ** 2).sum(axis=1)

    def fit(self, law: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parameters, chi2 and covariances of a law, a row a track."""
        m = LAWS[law]
        lo, hi = np.array([-np.inf, -np.inf, -1.0, EXPONENTS[0]])[:m], np.array([np.inf, np.inf, 1.0, EXPONENTS[1]])[:m]
        rest = lambda q, of: (self.p[of] - self.model(law, q, of)) / self.sigma[of]

        def slopes(q: np.ndarray, of: np.ndarray) -> np.ndarray:
            d = np.full((len(q), m), 1e-6)
            d[:, : m if law == "linear" else 1] = 1e-6 * np.abs(q[:, :1])
            each = d[:, :, None] * np.eye(m)
            up, down = np.minimum(q[:, None, :] + each, hi), np.maximum(q[:, None, :] - each, lo)
            found = self.model(law, np.concatenate([up, down]).reshape(-1, m), np.tile(np.repeat(of, m), 2)).reshape(2, len(q), m, -1)
            width = np.einsum("ijj->ij", up - down)[:, :, None]
            return (found[1] - found[0]) / self.sigma[of][:, None, :] / width

        begun = self.starts(law)
        each = begun.shape[1]
        q, of = np.clip(begun.reshape(-1, m), lo, hi), np.repeat(np.arange(len(self.p)), each)
        r, damping, live, at = rest(q, of), np.full(len(q), 1e-3), np.arange(len(q)), np.arange(m)
        chi, j, moved = np.einsum("ij,ij->i", r, r), np.zeros((len(q), m, self.p.shape[1])), np.ones(len(q), dtype=bool)
        for _ in range(120):
            if not len(live):
                break
            fresh = live[moved[live]]
            if len(fresh):
                j[fresh], moved[fresh] = slopes(q[fresh], of[fresh]), False
            h, g = np.einsum("iaj,ibj->iab", j[live], j[live]), np.einsum("iaj,ij->ia", j[live], r[live])
            h[:, at, at] += damping[live, None] * np.maximum(h[:, at, at], 1e-300)
            trial = np.clip(q[live] - solved(h, g), lo, hi)
            new = rest(trial, of[live])
            value = np.einsum("ij,ij->i", new, new)
            better = value < chi[live]
            won, lost = live[better], live[~better]
            done = chi[won] - value[better] <= 1e-10 * chi[won]
            q[won], r[won], chi[won], moved[won] = trial[better], new[better], value[better], True
            damping[won] /= 5
            damping[lost] *= 8
            go = np.ones(len(live), dtype=bool)
            go[better] = ~done
            go[~better] = damping[lost] <= 1e12
            live = live[go]
        best = np.argmin(np.where(np.isnan(chi), np.inf, chi).reshape(-1, each), axis=1) + np.arange(len(self.p)) * each
        q, chi = q[best], chi[best]
        j = slopes(q, np.arange(len(q)))
        unit = np.sqrt(np.maximum((j * j).sum(axis=2), 1e-300))
        j = j / unit[:, :, None]
        return q, chi, np.linalg.pinv(np.einsum("iaj,ibj->iab", j, j)) / (unit[:, :, None] * unit[:, None, :])

    def pinned(self, law: str, q: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Whether a singular law has become a step at an end of the track, or its exponent stands at a bound."""
        if LAWS[law] < 3:
            return np.zeros(len(q), dtype=bool)
        m = np.log(self.model(law, q, np.arange(len(q)), self.ends))
        all_ = np.abs(m[:, 3] - m[:, 0])
        found = (all_ > 0) & (np.maximum(np.abs(m[:, 1] - m[:, 0]), np.abs(m[:, 3] - m[:, 2])) > 0.5 * all_)
        if law == "power":
            margin = np.maximum(error[:, 3], 0.01 * (EXPONENTS[1] - EXPONENTS[0]))
            found |= ~((EXPONENTS[0] + margin < q[:, 3]) & (q[:, 3] < EXPONENTS[1] - margin))
        return found

    def published(self, law: str, q: np.ndarray) -> np.ndarray:
        """(period, slope, epoch, exponent, strength) of each row: P0, dP/dt or d ln P/dt or none, t0, d, and b or the amplitude."""
        a = q[:, 1] / self.span if q.shape[1] > 1 else np.zeros(len(q))
        if LAWS[law] < 3:
            none = np.full(len(q), np.nan)
            return np.column_stack([q[:, 0], a, none, none, none])
        u, d = q[:, 2] * self.u_most, q[:, 3] if q.shape[1] > 3 else np.full(len(q), 2.0)
        with np.errstate(all="ignore"):
            return np.column_stack([q[:, 0] * np.exp(np.clip(a / u / (1 - d), -700, 700)), a, self.mid + 1 / u, d, -a * (np.sign(u) if law == "power" else 1.0) * np.abs(1 / u) ** d])


def compare(t: np.ndarray, p: np.ndarray, error: np.ndarray | None = None, laws: tuple[str, ...] = AUTO) -> list[dict]:
    """Fits of the laws that the points can constrain, best first, as dicts of the columns of FIT."""
    return compare_tables([(t, p, error)], laws)[0]


def compare_tables(tables: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]], laws: tuple[str, ...] = AUTO) -> list[list[dict]]:
    """``compare`` of several tracks, whose steps are taken together."""
    if wrong := set(laws) - set(LAWS):
        raise ValueError(f"unknown law {', '.join(sorted(wrong))}; there are {', '.join(LAWS)}")
    tracks = [_Track(np.asarray(t, float), np.asarray(p, float), None if error is None else np.asarray(error, float)) for t, p, error in tables]
    distinct, out = [len(np.unique(x.t)) for x in tracks], [[] for _ in tracks]
    for law in laws:
        m = LAWS[law]
        those = [i for i, x in enumerate(tracks) if x.n >= m + 1 and (m == 1 or distinct[i] >= m)]
        if not those:
            continue
        group = _Tracks([tracks[i] for i in those])
        q, chi, cov = group.fit(law)
        given, rows = np.array([tracks[i].given for i in those]), np.arange(len(those))
        rest = np.where(np.isfinite(group.sigma), group.p - group.model(law, q, rows), 0.0)
        square, dof = (rest * rest).sum(axis=1), np.maximum(1, group.n - m)
        raw = np.where(given, chi, square)
        cov = cov * np.where(given, np.maximum(1.0, chi / dof), chi / dof)[:, None, None]
        value, steps = group.published(law, q), []
        for i in range(m):
            d = np.zeros_like(q)
            d[:, i] = 1e-5 * np.maximum(np.abs(q[:, i]), 1e-3)
            steps.append((group.published(law, q + d) - group.published(law, q - d)) / (2 * d[:, i : i + 1]))
        with np.errstate(invalid="ignore"):
            sd = np.sqrt(np.maximum(np.einsum("jri,rjk,kri->ri", np.array(steps), cov, np.array(steps)), 0))
        bic = np.where(given, raw, group.n * np.log(np.maximum(raw, 1e-300) / group.n)) + m * np.log(group.n)
        pinned = group.pinned(law, q, np.sqrt(np.maximum(np.einsum("ijj->ij", cov), 0)))
        for k, i in enumerate(those):
            out[i].append({"law": law, "n": tracks[i].n, "parameters": m, "pinned": bool(pinned[k]), "mid": tracks[i].mid, "period": value[k, 0], "slope": value[k, 1], "u": q[k, 2] * tracks[i].u_most if m > 2 else 0.0, "exponent": value[k, 3], "epoch": value[k, 2], "strength": value[k, 4],
                           "period_error": sd[k, 0], "slope_error": sd[k, 1] if m > 1 else math.nan, "epoch_error": sd[k, 2], "exponent_error": sd[k, 3] if m > 3 else math.nan, "chi2": float(raw[k]), "rms": math.sqrt(square[k] / tracks[i].n), "bic": float(bic[k]), "_center": q[k, 0]})
    return [_ranked(x, found) for x, found in zip(tracks, out, strict=True)]


def _ranked(track: _Track, out: list[dict]) -> list[dict]:
    """Fits on one scale of chi2, from the best on."""
    if not out:
        return []
    free = [r for r in out if not r["pinned"]] or out
    rich = max(free, key=lambda r: (r["parameters"], -r["chi2"]))
    scale = rich["chi2"] / max(1, rich["n"] - rich["parameters"])
    scale = max(1.0, scale) if track.given else max(scale, np.finfo(float).tiny)
    for r in out:
        r["bic_scaled"] = r["chi2"] / scale + r["parameters"] * math.log(r["n"])
    return [r | {"rank": i + 1} for i, r in enumerate(sorted(out, key=lambda r: (r["pinned"], r["bic_scaled"], r["parameters"])))]


def values(fit: dict, t: np.ndarray) -> np.ndarray:
    """Periods of a fit of ``compare`` at given times."""
    s = np.asarray(t, dtype=float) - fit["mid"]
    if fit["law"] == "constant":
        return np.full(len(s), fit["_center"])
    if fit["law"] == "linear":
        return fit["_center"] + fit["slope"] * s
    return fit["_center"] * np.exp(np.clip(fit["slope"] * change(s, fit["u"], fit["exponent"] if fit["law"] == "power" else 2.0), -60, 60))


def ladder(periods: DataFrame, laws: tuple[str, ...] = AUTO) -> DataFrame:
    """Ranked laws of each track (object_id, t, y the period, dy its error or null). Objects with too few points have no row."""
    columns = [c.split()[0] for c in FIT.split(", ")]

    def run(objects: list[pd.DataFrame]) -> pd.DataFrame:
        found = compare_tables([tuple(o[c].to_numpy(float) for c in ("t", "y", "dy")) for o in objects], laws)
        rows = [[o["object_id"].iloc[0] if c == "object_id" else r[c] for c in columns] for o, each in zip(objects, found, strict=True) for r in each]
        return pd.DataFrame(rows, columns=columns).astype({"object_id": object, "law": object, "rank": "int64", "n": "int64", "parameters": "int64", "pinned": bool} | dict.fromkeys(NUMBERS, float))

    out = spread.in_blocks(spread.deal_objects(periods.select("object_id", "t", "y", "dy")), run, FIT)
    return out.select([F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c) if c in NUMBERS else F.col(c) for c in columns])


def log_rate(t: Column) -> Column:
    """d ln P / dt of a row of ``ladder`` at a time: an expression of its columns."""
    s = t - F.col("mid")
    gap = 1 - F.col("u") * s
    single = F.col("slope") * F.signum(gap) * F.pow(F.abs(gap), -F.coalesce("exponent", F.lit(2.0)))
    single = F.when(F.col("law") == "singular", F.col("slope") / (gap * gap)).otherwise(single)
    return F.when(F.col("law") == "constant", 0.0).when(F.col("law") == "linear", F.col("slope") / (F.col("period") + F.col("slope") * s)).when(F.col("law") == "exponential", F.col("slope")).otherwise(single)


def period_at(t: Column) -> Column:
    """Period of a row of ``ladder`` at a time."""
    s, d = t - F.col("mid"), t - F.col("epoch")
    power = F.col("period") * F.exp(F.col("strength") / (1 - F.col("exponent")) * F.pow(F.abs(d), 1 - F.col("exponent")))
    return (
        F.when(F.col("law") == "constant", F.col("period")).when(F.col("law") == "linear", F.col("period") + F.col("slope") * s)
        .when(F.col("law") == "exponential", F.col("period") * F.exp(F.col("slope") * s)).when(F.col("law") == "singular", F.col("period") * F.exp(F.col("strength") / d)).otherwise(power)
    )


def timescale_years(t: Column) -> Column:
    """P / |dP/dt| in years; null where the period does not change."""
    return 1 / F.nullif(F.abs(log_rate(t)), F.lit(0.0)) / 365.25
