"""Boxes and shapes over folded points: the inner sums of the box and transit searches.

Boxes: with far fewer points than bins nearly all boxes hold the points of another one.
What a box scores depends on its points alone, so each run of points (in order of phase)
is scored once, and the shortest length and earliest start that hold just this run are
those of the box. Shapes: a shape's sums over all starts come from Fourier transforms.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Boxes whose squared objectives differ by less than this share are equal.
TIE = 1e-10
#: Cost of a run of points against a box of bins.
RUN = 2.0
#: Runs of so many points are scored for every start; longer ones for starts whose longest box holds more. Starts scored at once, and the share of a trial's highest bound that goes first.
NEAR = 12
AT_ONCE = 4096
SHARE = 0.5
#: Shapes: bins folded at once, bins whose starts share their bound and sums, blocks of starts at once, share as above, and the least weight of a point and outside a window, of all.
FOLDED, BLOCK, BLOCKS, SHAPES_SHARE, LEAST = 1 << 15, 4, 2048, 0.7, 1e-8


def sparse(n: int, share: float, bins: float, lengths: int) -> bool:
    """Whether runs of ``n`` points, the longest box as a ``share`` of the period, are fewer than boxes of that many bins and lengths."""
    return RUN * n * (2 + share * n) < bins * lengths


def remainders(tau: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """``np.mod`` of each period (row) and time from 0 on, to the last bit, several times as fast: whole periods are products without rounding."""
    p = periods[:, None]
    whole = tau / p
    np.floor(whole, out=whole)
    if not whole.size or whole.max() >= 1 << 20:
        return np.mod(tau[None, :], p)
    high = (np.ascontiguousarray(periods).view(np.int64) & ~np.int64((1 << 21) - 1)).view(float)[:, None]
    left = tau - whole * high
    whole *= p - high
    left -= whole
    return np.add(left, p, out=left, where=left < 0)


def box_runs(bin_of: np.ndarray, a: np.ndarray, v: np.ndarray, slots: np.ndarray, wrapped: int, lengths: np.ndarray, floor: float, likelihood: bool = False) -> tuple[np.ndarray, ...]:
    """(squared objective, start, length, sum of a, sum of v) of each row's best box; start -1 where none is a dip.

    ``bin_of``: bins from 1 on of each trial (row) and point. The period's last bin is ``slots - wrapped``; from it on the
    first ``wrapped`` bins stand once more. A box of start i holds the bins i + 1 to i + length. Of equal boxes the
    shortest, then the earliest wins.

    The dips among the points that the longest box from a start may hold bound what its runs score (Cauchy-Schwarz), so
    only starts whose bound reaches the best score so far are scored: highest bounds first, then those left.
    """
    m, n = bin_of.shape
    total, longest, bits = v.sum(), int(lengths.max()), n.bit_length()
    if n < 2 or not m or not v.min() > 2 * floor or (int(slots.max()) + longest + 2) << bits >= 1 << 29:
        return _all_runs(bin_of, a, v, slots, wrapped, lengths, floor, likelihood)
    last, first = (slots - wrapped).astype(np.int32)[:, None] << bits, np.int32((wrapped + 1) << bits)
    behind = ((slots + 1).astype(np.int32) << bits | n)[:, None]
    keys = bin_of.astype(np.int32) << bits | np.arange(n, dtype=np.int32)
    np.putmask(keys, keys >= last, np.broadcast_to(behind, keys.shape))
    keys.sort(axis=1)
    again = keys[:, : int(np.count_nonzero(keys.min(axis=0) < first))]
    keys = np.concatenate([keys, np.where(again < first, again + (last - (1 << bits)), behind), behind], axis=1)
    keys.sort(axis=1)
    # points are rows and trials columns, with a row before the first point and some behind the last
    stride = keys.shape[1] + 1
    at = np.full((stride + n, m), 1 << 29, dtype=np.int32)
    at[0], at[1:stride] = 0, keys.T
    who = (at[1 : stride - 1] & ((1 << bits) - 1)).astype(np.intp)
    at[:stride] >>= bits
    near = most = min(n - 1, NEAR)
    wide = many = at[near : near + stride] - at[:stride] < longest
    while most < n - 1 and wide.any():
        most = min(most + 4, n - 1)
        wide = at[most : most + stride] - at[:stride] < longest
    at = at[: stride + most]
    # sums of all before a point: of a, of v, and of what dips alone could score
    sums = np.empty((3, stride + most, m))
    for x, c in zip((a, v, np.minimum(a, 0) ** 2 / v), sums, strict=True):
        c[:2] = 0
        np.append(x, 0.0).take(who, out=c[2:stride], mode="clip")
        for j in range(3, stride):
            np.add(c[j - 1], c[j], out=c[j])
        c[stride:] = c[stride - 1]
    end, cv, cq = sums
    end[stride:] = np.inf
    begin, same = end[:stride].copy(), at[1:stride] == at[: stride - 1]
    begin[0] = -np.inf  # a run that parts points of one bin is no box
    np.putmask(begin[1:], same, -np.inf)
    np.putmask(end[1:stride], same, np.inf)
    bound, rest = cq[near : near + stride] - cq[:stride], cv[near : near + stride] - cv[:stride]
    if most > near:
        wide = np.flatnonzero(many)
        for x, c in ((bound, cq), (rest, cv)):
            x.ravel()[wide] = c.ravel().take(wide + most * m) - c.ravel().take(wide)
    np.subtract(total, rest, out=rest)
    np.maximum(rest, floor, out=rest)
    bound /= rest * rest if likelihood else rest
    np.putmask(bound, begin == -np.inf, -1.0)
    lengths = np.sort(lengths)
    least = np.append(lengths[np.searchsorted(lengths, np.arange(1, longest + 1))], 1 << 30).astype(np.int32)
    at, end, cv, begin, many, left = (x.ravel() for x in (at, end, cv, begin, many, bound))

    def scores(starts: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(squared objective, length, bins, bin before, sum of a, sum of v) of runs of 1 to k points; -1 where there is no box or no dip."""
        steps = np.arange(0, (k + 1) * m, m)[:, None] + starts
        b, before = at.take(steps), at.take(starts - m)
        kd = least.take(b[:-1] - b[0], mode="clip")
        bad = kd >= b[1:] - before
        ina = end.take(steps[1:])
        ina -= begin.take(starts)
        bad |= ina > 0
        inv = cv.take(steps[1:])
        inv -= cv.take(starts)
        outside = total - inv
        score = ina * ina
        score /= outside * inv
        if likelihood:
            score /= outside
        np.putmask(score, bad, -1.0)
        return score, kd, b, before, ina, inv

    reached, highest = np.full(stride * m, -1.0), bound.max(axis=0)
    with np.errstate(all="ignore"):
        for share in (1.0, SHARE, 0.0):
            starts = np.flatnonzero(bound >= np.maximum(np.maximum(reached.reshape(stride, m).max(axis=0), 0) * (1 - 1e-9), share * highest))
            starts = starts[starts >= m]
            longer = many.take(starts)
            for which, k in ((starts[~longer], near), (starts[longer], most)):
                for i in range(0, len(which), AT_ONCE):
                    part = which[i : i + AT_ONCE]
                    reached[part] = scores(part, k)[0].max(axis=0)
            left[starts] = -1.0
        top = reached.reshape(stride, m).max(axis=0)
        out = np.zeros(m), np.full(m, -1), np.zeros(m, dtype=np.int64), np.zeros(m), np.zeros(m)
        starts = np.flatnonzero(reached.reshape(stride, m) >= np.where(top > 0, top * (1 - TIE), np.inf))
        score, kd, b, before, ina, inv = scores(starts, most)
    k, i = np.nonzero(score >= top[starts % m] * (1 - TIE))
    row, kd = starts[i] % m, kd[k, i]
    found = score[k, i], np.maximum(before[i], b[k, i] - kd), kd, ina[k, i], inv[k, i]
    order = np.lexsort((found[1], kd, row))
    order = order[np.diff(row[order], prepend=-1) > 0]
    none = np.flatnonzero(~(top > 0))
    plain = _all_runs(bin_of[none], a, v, slots[none], wrapped, lengths, floor, likelihood) if len(none) else ()
    for x, y in zip(out, found, strict=True):
        x[row[order]] = y[order]
    for x, y in zip(out, plain, strict=False):
        x[none] = y
    return out


def _all_runs(bin_of: np.ndarray, a: np.ndarray, v: np.ndarray, slots: np.ndarray, wrapped: int, lengths: np.ndarray, floor: float, likelihood: bool) -> tuple[np.ndarray, ...]:
    """``box_runs`` without bounds: all runs of all starts, for weights next to nothing, bins without number, and trials without a dip."""
    m, n = bin_of.shape
    total = v.sum()
    bits = max(1, (n - 1).bit_length())
    packed = bin_of << bits | np.arange(n)
    packed.sort(axis=1)
    b, who = packed >> bits, packed & ((1 << bits) - 1)
    nb = (slots - wrapped)[:, None]
    kept, again = (b < nb).sum(axis=1), (b <= wrapped).sum(axis=1)
    width = int((kept + again).max())
    j = np.arange(width)[None, :]
    real = j < (kept + again)[:, None]
    source = np.where(j < kept[:, None], j, np.minimum(j - kept[:, None], n - 1))
    at = np.take_along_axis(b, source, axis=1) + np.where(j < kept[:, None], 0, nb - 1)
    # rows lie one after the other, each with an entry before its first point and at least one behind its last
    stride, longest, lengths = width + 2, int(lengths.max()), np.sort(lengths)
    flat = np.empty((m, stride), dtype=np.int64)
    flat[:, 0] = 0
    flat[:, 1:-1] = np.where(real, at, (slots + 1)[:, None])
    flat[:, -1] = slots + 1
    flat += (np.arange(m) * (int(slots.max()) + longest + 2))[:, None]  # no run goes on in the next row
    flat = flat.ravel().astype(np.int32 if int(flat.max()) < 1 << 31 else np.int64)
    who = np.take_along_axis(who, source, axis=1)
    over = np.arange(stride)[None, :] > (kept + again + 1)[:, None]
    over[:, 0] = True
    sums = []
    for x in (a, v):
        c = np.zeros((m, stride))
        np.cumsum(x[who], axis=1, out=c[:, 2:])  # at a point: all before it
        c[over] = np.nan
        sums.append(c.ravel())
    ca, cv = sums
    least = lengths[np.searchsorted(lengths, np.arange(1, longest + 1))]  # the shortest length that spans so many steps of bins
    rises = np.diff(flat, prepend=-1) > 0
    found = []
    for k in range(1, width + 1):
        across = flat[k - 1 : -1] - flat[:-k]
        within = across < longest
        if not within.any():
            break
        ina = ca[k:] - ca[:-k]
        within &= ina <= 0
        within &= rises[:-k]
        within &= rises[k:]
        first = np.flatnonzero(within)
        kd = least[across[first]]
        before = flat[first - 1]
        fits = kd < flat[first + k] - before
        first, kd, before = first[fits], kd[fits], before[fits]
        found.append((first // stride, np.maximum(before, flat[first + k - 1] - kd), kd, ina[first], cv[first + k] - cv[first]))
    best, start, size, out_a, out_v = np.zeros(m), np.full(m, -1), np.zeros(m, dtype=np.int64), np.zeros(m), np.zeros(m)
    if not found:
        return best, start, size, out_a, out_v
    row, begin, kd, ina, inv = (np.concatenate(x) for x in zip(*found, strict=True))
    rest = total - inv
    score = ina * ina / np.where((inv < floor) | (rest < floor), np.nan, inv * rest * (rest if likelihood else 1.0))
    most = np.full(m, -1.0)
    np.fmax.at(most, row, score)
    near = np.flatnonzero((score >= most[row] * (1 - TIE)) & (most[row] >= 0))
    near = near[np.lexsort((begin[near], kd[near], row[near]))]
    rows, pick = np.unique(row[near], return_index=True)
    pick = near[pick]
    best[rows], start[rows], size[rows], out_a[rows], out_v[rows] = score[pick], begin[pick] - rows * (int(slots.max()) + longest + 2), kd[pick], ina[pick], inv[pick]
    return best, start, size, out_a, out_v


@lru_cache(maxsize=64)
def _transforms(shape: tuple[float, ...], bins: int) -> tuple[np.ndarray, np.ndarray]:
    g = np.r_[np.array(shape), np.zeros(bins - len(shape))]
    return np.conj(np.fft.rfft(g)), np.conj(np.fft.rfft(g * g))


def residues(data: np.ndarray, weight: np.ndarray, bins: int, total: float, shape: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a level and the shape at each start lower chi2 by (0 where it is no dip), and the numerator and denominator of its depth, from transforms of folded weighted values and weights.

    Starts without a fit are multiplied by nothing: masks cost several times as much as the sums.
    """
    g, g2 = _transforms(shape, bins)
    num, cw, den = (np.fft.irfft(x, bins, axis=1) for x in (data * g, weight * g, weight * g2))
    cw *= cw
    cw *= -1 / total
    cw += den
    fall = np.minimum(num, 0)
    fall *= fall
    fall /= np.maximum(cw, 1e-20 * total)
    good = cw > 1e-9 * den
    good &= den > 1e-12 * total
    fall *= good
    return fall, num, cw


@lru_cache(maxsize=16)
def _bank(shapes: tuple[tuple[float, ...], ...]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all shapes at the starts of a block, over the bins that they reach; and these above their squares."""
    g = np.zeros((len(shapes) * BLOCK, max(map(len, shapes)) + BLOCK - 1))
    for i, shape in enumerate(shapes):
        for j in range(BLOCK):
            g[i * BLOCK + j, j : j + len(shape)] = shape
    return g, np.concatenate([g, g * g])


def few_points(v: np.ndarray, bins: int, shapes: tuple[tuple[float, ...], ...]) -> bool:
    """Whether ``shape_powers`` is for points of these weights: few for their bins, and none next to nothing."""
    return 2 * len(v) <= bins and bins % BLOCK == 0 and max(map(len, shapes)) + BLOCK <= bins and v.min() > LEAST * v.sum()


def shape_powers(tau: np.ndarray, periods: np.ndarray, a: np.ndarray, v: np.ndarray, bins: int, shapes: tuple[tuple[float, ...], ...]) -> np.ndarray:
    """The most that a level and a shape lower chi2 by at each period, for weighted values ``a`` about their mean and weights ``v``.

    The dips in a window bound what any shape in it can take away, over the weight outside (Cauchy-Schwarz twice). So only
    blocks of starts whose bound reaches the best so far are summed up, directly; ``residues`` sums up all.
    """
    (g, both), total, n = _bank(shapes), v.sum(), len(tau)
    reach, r = g.shape[1], len(g)
    blocks, over = bins // BLOCK, -(-reach // BLOCK)
    out, ahead = np.zeros(len(periods)), np.minimum(a, 0) ** 2 / v
    step = max(1, FOLDED // (bins + reach))
    for begin in range(0, len(periods), step):
        p = periods[begin : begin + step]
        m = len(p)
        x = tau[:, None] / p
        x -= np.floor(x)
        b = np.minimum((x * bins).astype(np.int64), bins - 1)
        trial = np.arange(m)
        of_bin, of_block = (b * m + trial).ravel(), (b // BLOCK * m + trial).ravel()
        ra, rv, rq = (np.repeat(c, m) for c in (a, v, ahead))
        ha, hv = (np.bincount(of_bin, c, (bins + reach) * m) for c in (ra, rv))
        outside, bound = np.empty((2, blocks, m))
        for c, size, h in ((of_block, rv, outside), (of_block, rq, bound)):
            around = np.bincount(c, size, (blocks + over) * m).reshape(-1, m)
            around[blocks:] = around[:over]
            h[:] = around[:blocks]
            for j in range(1, over):
                h += around[j : j + blocks]
        for h in (ha, hv):
            h[bins * m :] = h[: reach * m]
        np.subtract(total, outside, out=outside)
        whole = np.flatnonzero(outside.min(axis=0) <= LEAST * total)
        np.maximum(outside, LEAST * total, out=outside)
        bound /= outside
        bound *= total
        highest, reached, steps = bound.max(axis=0), np.zeros((blocks, m)), np.arange(0, reach * m, m)[:, None]
        for share in (1.0, SHAPES_SHARE, 0.0):
            which = np.flatnonzero(bound >= np.maximum(np.maximum(reached.max(axis=0) * (1 - 1e-9), share * highest), np.finfo(float).tiny))
            for i in range(0, len(which), BLOCKS):
                part = which[i : i + BLOCKS]
                at = steps + (part + part // m * ((BLOCK - 1) * m))
                fall, sums = g @ ha.take(at), both @ hv.take(at)
                np.minimum(fall, 0, out=fall)
                fall *= fall
                d = sums[:r]
                d *= d
                d *= -1 / total
                d += sums[r:]
                np.maximum(d, np.finfo(float).tiny, out=d)
                fall /= d
                reached.ravel()[part] = fall.max(axis=0)
            bound.ravel()[which] = -1.0
        out[begin : begin + m] = reached.max(axis=0)
        if len(whole):  # all points in a window: no bound
            at = (b[:, whole] + np.arange(len(whole)) * bins).ravel()
            data, weight = (np.fft.rfft(np.bincount(at, np.repeat(c, len(whole)), len(whole) * bins).reshape(-1, bins), axis=1) for c in (a, v))
            out[begin + whole] = np.max([residues(data, weight, bins, total, shape)[0].max(axis=1) for shape in shapes], axis=0)
    return out
