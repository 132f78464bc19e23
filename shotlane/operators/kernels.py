"""Numeric kernels on one sequence (numpy arrays in, numpy arrays out).

Only the fits that no Spark expression can state live here.  Sequences are one
shot long, at most the frames of its video.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np


def isotonic(values: np.ndarray) -> np.ndarray:
    """Closest non-decreasing sequence in least squares (pool adjacent violators)."""
    total, size = [], []
    for v in np.asarray(values, dtype=float):
        t, n = float(v), 1
        while total and total[-1] * n > t * size[-1]:
            t, n = t + total.pop(), n + size.pop()
        total.append(t)
        size.append(n)
    return np.repeat(np.divide(total, size), size) if total else np.empty(0)


def spread_flat(values: np.ndarray) -> np.ndarray:
    """Each level stretch between two others becomes a ramp from the value before it to the one after.

    Worked on stretches (start, size, level): the value a stretch ends with depends
    only on the one before it, so the ends are one fold and the points then follow at once.
    """
    v = np.asarray(values, dtype=float)
    first = np.flatnonzero(np.append(True, np.abs(np.diff(v)) >= 1e-9)[: v.size])
    size, level = np.diff(np.append(first, v.size)), v[first]
    following = np.append(level[1:], np.nan)[: level.size]

    def end(before: float, stretch) -> float:
        own, after, n = stretch
        return before + (after - before) * n / (n + 1) if n > 1 and after > before else own

    before = np.array([*accumulate(zip(level, following, size), end, initial=np.nan)][: level.size])
    ramp = (size > 1) & (following > before)
    place = np.arange(v.size) - np.repeat(first, size) + 1
    tilt = np.repeat(np.where(ramp, (following - before) / (size + 1), 0.0), size)
    return np.maximum.accumulate(np.repeat(np.where(ramp, before, level), size) + tilt * place)


def anchor_ends(smooth: np.ndarray, raw: np.ndarray, length: int = 5) -> np.ndarray:
    """A blend of both: half raw at either end, fading to all smooth ``length`` points in."""
    n = len(smooth)
    if n <= 2:
        return np.array(smooth, dtype=float)
    reach = max(min(length, n) - 1, 1)
    at = np.arange(n)
    kept = [1 - np.clip(0.5 * (1 - d / reach), 0.0, None) for d in (at, n - 1 - at)]
    return raw + kept[0] * kept[1] * (np.asarray(smooth, dtype=float) - raw)


def hook_side(x: np.ndarray, y: np.ndarray) -> int:
    """+1 or -1 where the middle of the shot clearly moves to one side while rolling on, else 0."""
    lo, hi = int(0.20 * len(x)), int(0.80 * len(x))
    if len(x) < 12 or hi - lo <= 4 or y[hi] - y[lo] <= 1.0 or abs(x[hi] - x[lo]) < 0.04:
        return 0
    return int(np.sign(x[hi] - x[lo]))


def clamp_hook(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Once the shot clearly hooks one way, its last eighth may not step back the other way."""
    out, side = np.array(x, dtype=float), hook_side(x, y)
    if side:
        tail = max(int(0.80 * len(out)), len(out) - max(6, len(out) // 8))
        out[tail:] = [*accumulate(out[tail:], lambda held, new: held if side * (new - held) < -1e-3 else new)]
    return out


# ---- smoothing spline with a residual budget (Dierckx 1975/1993) -----------

def _basis(t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cubic B-spline values at x: four per point, and the first coefficient they belong to."""
    cell = np.clip(np.searchsorted(t, x, side="right") - 1, 3, t.size - 5)
    b = np.ones((x.size, 1))
    for d in range(1, 4):
        nb = np.zeros((x.size, d + 1))
        for j in range(d):
            right, left = t[cell + j + 1], t[cell + j + 1 - d]
            part = b[:, j] / (right - left)
            nb[:, j] += (right - x) * part
            nb[:, j + 1] += (x - left) * part
        b = nb
    return b, cell - 3


def _dense(t: np.ndarray, x: np.ndarray) -> np.ndarray:
    b, first = _basis(t, x)
    a = np.zeros((x.size, t.size - 4))
    a[np.arange(x.size)[:, None], first[:, None] + np.arange(4)] = b
    return a


def _jumps(t: np.ndarray) -> np.ndarray:
    """Third-derivative jump of each B-spline at each inner knot, scaled by the mean knot spacing."""
    inner = t.size - 8
    width = (t[-4] - t[3]) / (inner + 1)
    r = np.arange(inner)[:, None]
    j = r + np.arange(5)
    gaps = t[r + 4][:, :, None] - t[j[:, :, None] + np.arange(5)]
    # the knot itself is one of the five: it does not count
    gaps[gaps == 0.0] = width
    out = np.zeros((inner, t.size - 4))
    out[r, j] = (t[j + 4] - t[j]) / np.prod(gaps / width, axis=2) / width
    return out


def _solve(normal: np.ndarray, rhs: np.ndarray, a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normal equations; the slow orthogonal solver only where they are singular."""
    try:
        return np.linalg.solve(normal, rhs)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, y, rcond=None)[0]


def smoothing_spline(x: np.ndarray, y: np.ndarray, budget: float, at: np.ndarray) -> np.ndarray:
    """Smooth y(x) so that the squared residuals sum to ``budget``; x strictly increasing, at least 4 points.

    Few knots first: a plain cubic if that fits, then knots where the residual
    is largest until the budget is met, then the smoothest curve on those knots
    whose residual equals it.
    """
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    m = x.size
    tol = 0.001 * budget
    lo, hi = x[0], x[-1]

    def fit(inner: np.ndarray):
        t = np.concatenate([np.full(4, lo), inner, np.full(4, hi)])
        a = _dense(t, x)
        c = _solve(a.T @ a, a.T @ y, a, y)
        res = (y - a @ c) ** 2
        return t, a, c, res, float(res.sum())

    inner = np.empty(0)
    t, a, c, res, fp = fit(inner)
    if fp <= budget + tol:
        return _dense(t, np.clip(at, lo, hi)) @ c
    fp_cubic, before, add = fp, 0.0, 0
    max_inner = m - 4
    while fp > budget + tol and inner.size < max_inner:
        over = fp - budget
        if inner.size == 0:
            add = 1
        else:
            want = int(add * over / (before - fp)) if before - fp > tol else 2 * add
            add = min(2 * add, max(want, add // 2, 1))
        before = fp
        # squared residual per knot interval; a point on a knot counts half on each side
        edges = np.concatenate([[lo], inner, [hi]])
        own = np.searchsorted(inner, x, side="right")
        share = np.bincount(own, weights=res, minlength=edges.size - 1)
        on = np.flatnonzero(np.isin(x, inner))
        for i in on:
            share[own[i]] -= res[i] / 2
            share[own[i] - 1] += res[i] / 2
        spans = [[float(share[k]), np.flatnonzero((x > edges[k]) & (x < edges[k + 1]))] for k in range(edges.size - 1)]
        placed = []
        for _ in range(add):
            if inner.size + len(placed) >= max_inner:
                break
            open_spans = [k for k, s in enumerate(spans) if s[1].size]
            if not open_spans:
                break
            k = max(open_spans, key=lambda j: spans[j][0])
            total, pts = spans[k]
            mid = pts.size // 2
            placed.append(x[pts[mid]])
            left, right = pts[:mid], pts[mid + 1:]
            spans[k:k + 1] = [[total * left.size / pts.size, left], [total * right.size / pts.size, right]]
        if not placed:
            break
        inner = np.sort(np.concatenate([inner, placed]))
        t, a, c, res, fp = fit(inner)
        if inner.size >= max_inner:
            break
    if abs(fp - budget) <= tol or fp > budget or inner.size == 0:
        return _dense(t, np.clip(at, lo, hi)) @ c

    rough = _jumps(t)
    fit_part, rough_part, rhs = a.T @ a, rough.T @ rough, a.T @ y

    def smooth(p: float):
        c = _solve(fit_part + rough_part / p ** 2, rhs, np.vstack([a, rough / p]), np.concatenate([y, np.zeros(rough.shape[0])]))
        return c, float(((y - a @ c) ** 2).sum())

    # residual falls from the cubic's (p -> 0) to the free knots' (p -> inf): bracket, then bisect on log p
    small, large = 1e-4, 1.0
    while smooth(large)[1] > budget and large < 1e12:
        small, large = large, large * 10.0
    while smooth(small)[1] < budget and small > 1e-7:
        large, small = small, small / 10.0
    c, fp = smooth(large)
    for _ in range(60):
        if abs(fp - budget) <= tol:
            break
        p = np.sqrt(small * large)
        c, fp = smooth(p)
        if fp > budget:
            small = p
        else:
            large = p
    return _dense(t, np.clip(at, lo, hi)) @ c


def clean_trajectory(frames: np.ndarray, xs: np.ndarray, ys: np.ndarray, sigma: float, length_m: float):
    """Dense, smoothed, forward-only x and y for every frame between the first and last detection."""
    frames = np.asarray(frames, dtype=float)
    every = np.arange(frames[0], frames[-1] + 1.0)
    enough, budget = frames.size >= 4, frames.size * sigma ** 2

    def fitted(axis, values, at, line):
        return anchor_ends(smoothing_spline(axis, values, budget, at), line) if enough else line

    x, y = (fitted(frames, values, every, np.interp(every, frames, values)) for values in (xs, ys))
    y = np.clip(spread_flat(isotonic(y)), 0.0, length_m)
    if every.size >= 6:
        rolled = np.maximum.accumulate(y) + 1e-6 * np.arange(every.size)
        x = fitted(rolled, x, rolled, x)
    return every, clamp_hook(x, y), y


def curvatures(t: np.ndarray, v: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Second derivatives at the points of natural cubics (zero at both ends) through many series at once.

    ``t`` and the rows of ``v`` hold the series one after another.  One elimination forth and back over places, all series that
    reach a place together: linear in the points.
    """
    order = np.argsort(-sizes, kind="stable")
    longest, starts = sizes[order], (np.cumsum(sizes) - sizes)[order]
    inner = lambda i: starts[: np.searchsorted(-longest, -(i + 2), side="right")] + i  # noqa: E731  series with a point after place i
    h = np.diff(t)
    slope = np.diff(v, axis=0) / h[:, None]
    ratio, curv = np.zeros(len(t)), np.zeros(v.shape)
    last = int(longest[0]) - 2 if len(sizes) else 0
    for i in range(1, last + 1):
        at = inner(i)
        pivot = 2 * (h[at - 1] + h[at]) - h[at - 1] * ratio[at - 1]
        ratio[at] = h[at] / pivot
        curv[at] = (6 * (slope[at] - slope[at - 1]) - h[at - 1, None] * curv[at - 1]) / pivot[:, None]
    for i in range(last, 0, -1):
        at = inner(i)
        curv[at] -= ratio[at, None] * curv[at + 1]
    return curv


def natural_cubics(t: np.ndarray, v: np.ndarray, sizes: np.ndarray, factor: int, curved: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Even grids of ``factor`` times the points from the first to the last of each series, and the natural cubics there; series of at least three points."""
    with np.errstate(divide="ignore", invalid="ignore"):  # repeated times have no cubic: NaN in their series
        curv = curvatures(t, v, sizes) if curved else np.zeros(v.shape)
        starts, many = np.cumsum(sizes) - sizes, sizes * factor
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        t0, t1 = t[starts], t[starts + sizes - 1]
        at = place * np.repeat((t1 - t0) / (many - 1), many) + np.repeat(t0, many)
        at[np.cumsum(many) - 1] = t1
        # the interval of a grid point: knots and grid points in one order by (series, time), knots first
        ids = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.arange(len(sizes)), many)
        by = np.lexsort((np.repeat([0, 1], [len(t), len(at)]), np.concatenate([t, at]), np.concatenate(ids)))
        knots = np.cumsum(by < len(t))
        k = np.empty(len(at), np.int64)
        k[by[by >= len(t)] - len(t)] = knots[by >= len(t)] - 1
        k = np.minimum(k, np.repeat(starts + sizes - 2, many))
        h, d, e = (t[k + 1] - t[k])[:, None], (at - t[k])[:, None], (t[k + 1] - at)[:, None]
        out = (curv[k] * e ** 3 + curv[k + 1] * d ** 3) / (6 * h) + (v[k] / h - curv[k] * h / 6) * e + (v[k + 1] / h - curv[k + 1] * h / 6) * d
    return at, out
