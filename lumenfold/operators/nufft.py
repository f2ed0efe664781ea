"""Sums of exponentials at many equally spaced frequencies by gridding and FFT.

``F_k = sum_j c_j exp(2 pi i (f0 + k df) t_j)`` for k < nf: the values are spread
to a grid twice as fine with the exponential of a semicircle, whose transform is
divided out after one FFT. Error some 1e-11 of the sum of absolute values.
"""

from __future__ import annotations

import copy
import math
from functools import lru_cache

import numpy as np

WIDTH = 14
_BETA = 2.30 * WIDTH


def _fast_length(n: int) -> int:
    """The smallest product of 2, 3 and 5 that is n or more, and even."""
    best = 1 << max(1, (n - 1).bit_length())
    p5 = 1
    while p5 < best:
        p3 = p5
        while p3 < best:
            p2 = max(2, 1 << max(1, (-(-n // p3) - 1).bit_length()))
            if n <= p2 * p3 < best:
                best = p2 * p3
            p3 *= 3
        p5 *= 5
    return best


def _kernel(z: np.ndarray) -> np.ndarray:
    return np.exp(_BETA * (np.sqrt(np.maximum(1 - z * z, 0)) - 1))


@lru_cache(maxsize=64)
def _correction(nf: int, size: int) -> np.ndarray:
    """Transform of the kernel at the frequencies k - nf // 2, by Gauss-Legendre quadrature."""
    x, w = np.polynomial.legendre.leggauss(40)
    k = np.arange(nf) - nf // 2
    half = WIDTH / 2
    turn = np.cos(np.outer(2 * np.pi * half / size * k, x[x > 0]))
    return 2 * half * (turn @ (w[x > 0] * _kernel(x[x > 0])))


def grid_size(nf: int) -> int:
    """Cells of the grid for ``nf`` frequencies."""
    return _fast_length(max(2 * nf, 2 * WIDTH))


def spread(t: np.ndarray, values: np.ndarray, f0: float, df: float, nf: int) -> np.ndarray:
    """The grid of each row of ``values``: shape (rows, grid_size(nf)), complex. Grids of parts of the points add up to the grid of all."""
    values = np.atleast_2d(values)
    size = grid_size(nf)
    x = np.mod(df * t, 1.0) * size
    c = values * np.exp(2j * np.pi * (np.mod(f0 * t, 1.0) + np.mod((nf // 2) * np.mod(df * t, 1.0), 1.0)))
    first = np.ceil(x - WIDTH / 2).astype(np.int64)
    at = first[:, None] + np.arange(WIDTH)
    share = _kernel((at - x[:, None]) * (2 / WIDTH))
    at = np.mod(at, size).ravel()
    out = np.empty((len(values), size), dtype=complex)
    for i, row in enumerate(c):
        each = (row[:, None] * share).ravel()
        out[i] = np.bincount(at, each.real, size) + 1j * np.bincount(at, each.imag, size)
    return out


def transform(grid: np.ndarray, nf: int) -> np.ndarray:
    """F_k of each grid: shape (rows, nf), complex."""
    size = grid_size(nf)
    k = np.mod(np.arange(nf) - nf // 2, size)
    return np.stack([np.fft.ifft(g)[k] * size / _correction(nf, size) for g in grid])


def sums(t: np.ndarray, values: np.ndarray, f0: float, df: float, nf: int) -> np.ndarray:
    """F_k for each row of ``values``: shape (rows, nf), complex."""
    return transform(spread(t, values, f0, df, nf), nf)


class Products:
    """F_k of few points without a grid: exponentials of coarse steps times those of fine ones, some 2 sqrt(nf) a point in place of nf, met in one matrix product a row. They are kept for further values at the same times."""

    def __init__(self, t: np.ndarray, f0: float, df: float, nf: int) -> None:
        fine, turn = max(1, math.isqrt(nf)), 2j * np.pi * t
        self.nf = nf
        self.step = np.exp(np.outer(turn, df * np.arange(fine)))
        self.jump = np.exp(np.outer(f0 + df * fine * np.arange(-(-nf // fine)), turn))

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.stack([((self.jump * row) @ self.step).ravel()[: self.nf] for row in np.atleast_2d(values)])

    def doubled(self) -> Products:
        """The same at twice the times."""
        out = copy.copy(self)
        out.step, out.jump = self.step * self.step, self.jump * self.jump
        return out


def uniform(frequencies: np.ndarray) -> tuple[float, float] | None:
    """(f0, df) of equally spaced ascending frequencies, else None."""
    n = len(frequencies)
    if n < 2:
        return None
    df = (frequencies[-1] - frequencies[0]) / (n - 1)
    even = df > 0 and np.abs(frequencies - (frequencies[0] + df * np.arange(n))).max() <= 1e-9 * df
    return (float(frequencies[0]), float(df)) if even else None
