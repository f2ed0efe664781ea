"""The contract of a search method, and a registry that users extend.

A method is a kernel ``(t, y, dy, f, **settings) -> statistic per trial`` with t from
an object's first time, whether small or large values win, the settings it takes, a
table of trial grids, and a policy for its list of peaks. A registered method works
wherever a built-in one does: in ``search`` (several methods at once, each with its
settings), and in SQL as ``periodogram(TABLE(points) PARTITION BY (object_id), 'name')``
(``functions.sql``). What a task needs travels with it, so executors need not have
registered anything; a kernel must be picklable or importable there.

Peaks lie ``separation`` trials apart, or, for alias-diverse methods, are no harmonics
or day and year aliases of a better one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grids, kernels, peaks

PEAKS = "object_id string, rank long, k long, period double, f double, power double"
#: How close a frequency and a relative of a better one may be, in cycles per day.
TOLERANCE = 0.01


@dataclass(frozen=True)
class Method:
    """``grid``: observations -> (object_id, f0, df, nf); None: 1/T to the pseudo-Nyquist frequency. ``cost``: of a point and trial against a plain fold."""

    name: str
    kernel: Callable[..., np.ndarray]
    smallest: bool = False
    settings: frozenset[str] = frozenset()
    grid: Callable[[DataFrame], DataFrame] | None = None
    diverse: bool = False
    separation: int = 15
    cost: float = 1.0

    def __post_init__(self) -> None:
        if not normal(self.name):
            raise ValueError("a method needs a name with letters or digits")
        if self.separation < 1 or self.cost <= 0:
            raise ValueError("separation and cost are positive")

    def check(self, settings: Mapping) -> dict:
        if wrong := set(settings) - self.settings:
            raise ValueError(f"{self.name} has no setting {', '.join(sorted(wrong))}")
        return dict(settings)

    def with_peak_defaults(self, separation: int | None = None, diverse: bool | None = None) -> Method:
        """The method with another policy for its peaks."""
        return replace(self, separation=self.separation if separation is None else separation, diverse=self.diverse if diverse is None else diverse)

    def trials(self, obs: DataFrame) -> DataFrame:
        return (self.grid or grids.fold_grid)(obs)

    def peaks(self, f: np.ndarray, power: np.ndarray, n: int) -> list[int]:
        """Indices of the ``n`` best trials under the policy; of equal ones the first."""
        score = np.round(np.where(np.isfinite(power), -power if self.smallest else power, -np.inf), 9)
        if self.diverse:  # aliases of a peak's slope are no peaks
            inner = np.r_[True, score[1:] > score[:-1]] & np.r_[score[:-1] >= score[1:], True] if len(f) > 1 else np.ones(len(f), bool)
            score = np.where(inner, score, -np.inf)
        taken: list[int] = []
        for i in np.argsort(-score, kind="stable").tolist() if self.diverse else ():
            if len(taken) == n or score[i] == -np.inf:
                break
            if not any(related(f[i], f[j]) for j in taken):
                taken.append(i)
        free = score > -np.inf
        while not self.diverse and len(taken) < n and free.any():
            i = int(np.argmax(np.where(free, score, -np.inf)))
            taken.append(i)
            free[max(0, i - self.separation + 1) : i + self.separation] = False
        return taken


def related(f: float, other: float, tolerance: float = TOLERANCE, harmonics: int = 8) -> bool:
    """Whether a frequency is a harmonic of the other, or an alias of it by days or a year; as ``peaks.alias_related``."""
    close = lambda a, b, m=1: abs(a - b) <= m * tolerance
    days = [m * d for d, _ in peaks.CLASSIC_WINDOW[:2] for m in (1, 2)]
    year = peaks.CLASSIC_WINDOW[3][0]
    return (
        close(f, other) or any(close(f, m * other, m) or close(m * f, other, m) for m in range(2, harmonics + 1))
        or any(close(f, other + d) or close(f, abs(other - d)) for d in days) or close(f, other + year) or close(f, other - year)
    )


def normal(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


_REGISTRY: dict[str, Method] = {}
_ALSO = {"lombscargle": "gls", "conditionalentropy": "ce", "stringlength": "sl", "aov": "mhaov"}


def register(method: Method) -> Method:
    """Adds or replaces a method under its name (letter case and separators do not count); returns it."""
    _REGISTRY[normal(method.name)] = method
    return method


for _name, _kernel in kernels.METHODS.items():
    register(Method(_name, _kernel, _name in kernels.MINIMISED, frozenset(kernels.SETTINGS[_name]), grids.GRIDS[_name], _name in ("bls", "tls"), cost=kernels.RELATIVE[_name]))


def names() -> list[str]:
    return sorted(_REGISTRY)


def get(name: str | Method) -> Method:
    if isinstance(name, Method):
        return name
    key = normal(name)
    found = _REGISTRY.get(key) or _REGISTRY.get(_ALSO.get(key, ""))
    if found is None:
        raise ValueError(f"unknown method {name!r}; there are {', '.join(names())}")
    return found


def alias_diverse_for(name: str) -> bool:
    """Whether a method's list of peaks leaves out aliases of better ones."""
    return get(name).diverse


def select_settings(methods: list[str | Method], settings: Mapping[str, Mapping] | None) -> dict[str, dict]:
    """Settings by method from a mapping whose keys are method names in any spelling; refuses unknown names, two keys of one method, and settings a method has not got. Settings of methods that are not run are left aside."""
    given: dict[str, Mapping] = {}
    for key, value in (settings or {}).items():
        name = get(key).name
        if name in given:
            raise ValueError(f"two keys name {name}")
        given[name] = value
    return {m.name: m.check(given.get(m.name, {})) for m in map(get, methods)}


def best_periods(obs: DataFrame, method: str | Method, n: int = 1, nf: int | None = None, grid: DataFrame | None = None, **settings) -> DataFrame:
    """PEAKS of each object: on ``grid``, on ``nf`` trials from 1/T in steps of 1/(5T), or on the method's own grid."""
    m = get(method)
    m.check(settings)
    grid = grid if grid is not None or nf else m.trials(obs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t, y, dy = kernels._points(pdf)
        span = t[-1] - t[0] if len(t) else 0.0
        f = kernels._grid_of(pdf, nf, None, span) if span > 0 else np.zeros(0)
        power = np.asarray(m.kernel(t - t[0], y, dy, f, **settings), dtype=float) if len(f) else np.zeros(0)
        if power.shape != f.shape:
            raise ValueError(f"{m.name} gave {power.shape} values for {f.shape} trials")
        rows = [(pdf["object_id"].iloc[0], r + 1, k, 1 / f[k], f[k], power[k]) for r, k in enumerate(m.peaks(f, power, n))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PEAKS.split(", ")]).astype({"object_id": object, "rank": "int64", "k": "int64", "period": float, "f": float, "power": float})

    return kernels._with_grid(obs, grid, nf, m.cost).groupBy("object_id").applyInPandas(run, PEAKS)


def search(obs: DataFrame, methods: list[str | Method], n: int = 1, nf: int | None = None, settings: Mapping[str, Mapping] | None = None) -> DataFrame:
    """PEAKS and ``method`` for several methods, each on its own grid and with its own settings."""
    chosen, found = select_settings(methods, settings), None
    for m in dict.fromkeys(map(get, methods)):
        part = best_periods(obs, m, n, nf, **chosen[m.name]).withColumn("method", F.lit(m.name))
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no method")
    return found


def local_trials(t: np.ndarray, nf: int | None = None) -> np.ndarray:
    """Trials for sorted times of one object where no grid table is at hand: 1/T to 2.5 N/T, five a peak, or ``nf`` of them."""
    span = t[-1] - t[0] if len(t) else 0.0
    if span <= 0:
        return np.zeros(0)
    n = nf or max(1, math.floor(12.5 * len(t) - 4))
    return 1 / span + np.arange(n) / (5 * span)
