"""Seasonal-trend decomposition of short series of one length at a time (numpy kernel for batches and grouped maps)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# a few MB, so that a step's arrays stay in the processor's cache
_CELLS = 100_000
# points of a series up to which its fits are products with square matrices
_SHORT = 128


@lru_cache(maxsize=256)
def _plan(n: int, span: int, first: int, last: int) -> tuple[np.ndarray, ...]:
    """Neighbour indexes and distance weights of the fits at positions first..last of n points."""
    width = min(span, n)
    at = np.arange(first, last + 1, dtype=float)
    left = np.clip(at.astype(int) - (width - 1) // 2, 0, n - width)
    idx = left[:, None] + np.arange(width)
    x = idx.astype(float)
    dist = np.abs(x - at[:, None])
    reach = np.maximum(at - left, left + width - 1 - at) + ((span - n) // 2 if span > n else 0)
    ratio = dist / np.maximum(reach, 1e-12)[:, None]
    near = np.where(ratio <= 0.999, (1 - np.minimum(ratio, 1) ** 3) ** 3, 0.0)
    return idx, x, np.where(ratio <= 0.001, 1.0, near), at[:, None]


@lru_cache(maxsize=256)
def _low_pass(n: int, period: int, span: int) -> np.ndarray:
    """Matrix of the moving means and the unweighted fits that take n + 2 * period points to n."""
    means = _moving(_moving(_moving(np.eye(n + 2 * period), period), period), 3)
    idx, factors = _plain_factors(n, span)
    return (factors * means[:, idx]).sum(axis=2)


@lru_cache(maxsize=256)
def _plain_factors(n: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour indexes and factors of the fits at all n points when no row is weighed down."""
    idx, x, near, at = _plan(n, span, 0, n - 1)
    return idx, _factors(near[None], x, at, n)[0]


def _factors(w: np.ndarray, x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Factors of the neighbours in local linear fits with the weights ``w``."""
    total = w.sum(axis=2, keepdims=True)
    w = np.where(total > 0, w / np.where(total > 0, total, 1.0), 1.0 / x.shape[1])
    mid = (w * x).sum(axis=2, keepdims=True)
    off = x - mid
    spread = (w * off * off).sum(axis=2, keepdims=True)
    usable = spread > (0.001 * max(n - 1, 1)) ** 2
    slope = np.where(usable, (at - mid) / np.where(usable, spread, 1.0), 0.0)
    return w * (1 + slope * off)


def _smooth(y: np.ndarray, span: int, weights: np.ndarray, first: int, last: int) -> np.ndarray:
    """Local linear fits at the positions first..last, for every row of ``y``."""
    n = y.shape[1]
    if n <= _SHORT:
        return _smooth_short(y, span, weights, first, last)
    idx, x, near, at = _plan(n, span, first, last)
    return (_factors(near * weights[:, idx], x, at, n) * y[:, idx]).sum(axis=2)


@lru_cache(maxsize=512)
def _moments(n: int, span: int, first: int, last: int) -> tuple[np.ndarray, ...]:
    """Matrices from n points to the distance-weighted sums at positions first..last: plain, by offset, by squared offset."""
    idx, x, near, at = _plan(n, span, first, last)
    made = np.zeros((3, len(at), n))
    for i, m in enumerate((near, near * (x - at), near * (x - at) ** 2)):
        np.put_along_axis(made[i], idx, m, axis=1)
    return tuple(np.ascontiguousarray(m.T) for m in made)


def _smooth_short(y: np.ndarray, span: int, weights: np.ndarray, first: int, last: int) -> np.ndarray:
    """``_smooth`` by products with fixed matrices; offsets are taken from the position of the fit."""
    n = y.shape[1]
    plain, once, twice = _moments(n, span, first, last)
    heavy = weights * y
    total = weights @ plain
    some = total > 0
    safe = np.where(some, total, 1.0)
    mid, level = (weights @ once) / safe, (heavy @ plain) / safe
    spread = (weights @ twice) / safe - mid * mid
    usable = some & (spread > (0.001 * max(n - 1, 1)) ** 2)
    slope = np.where(usable, ((heavy @ once) / safe - mid * level) / np.where(usable, spread, 1.0), 0.0)
    fitted = level - mid * slope
    if some.all():
        return fitted
    # no point of the window counts: all its points count the same, on a line where they spread
    return np.where(some, fitted, _even(y, span, first, last))


def _even(y: np.ndarray, span: int, first: int, last: int) -> np.ndarray:
    """Fits whose neighbours all have the same weight."""
    idx, x, near, at = _plan(y.shape[1], span, first, last)
    return (_factors(np.zeros((1, *near.shape)), x, at, y.shape[1]) * y[:, idx]).sum(axis=2)


def _moving(y: np.ndarray, k: int) -> np.ndarray:
    """Mean of every ``k`` neighbours, for every row of ``y``."""
    return np.array([np.convolve(row, np.full(k, 1.0 / k), mode="valid") for row in y])


def _odd(v: float) -> int:
    k = int(np.ceil(v))
    return k if k % 2 else k + 1


def decompose(
    y: np.ndarray, period: int, seasonal: int = 7, robust: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, residual); they add up to ``y``."""
    trend, season, resid = decompose_rows(np.asarray(y, dtype=float)[None, :], period, seasonal, robust)
    return trend[0], season[0], resid[0]


def decompose_rows(
    y: np.ndarray, period: int, seasonal: int = 7, robust: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``decompose`` of every row of ``y``, each as if it stood alone; some ``_CELLS`` neighbours are weighed at a time."""
    # products with matrices hold no row of neighbours per point
    neighbours = 1 if y.shape[1] <= _SHORT else _odd(1.5 * period / (1 - 1.5 / seasonal))
    step = max(1, _CELLS // max(1, y.shape[1] * neighbours))
    parts = [_decompose(y[at : at + step], period, seasonal, robust) for at in range(0, len(y), step)]
    return tuple(np.concatenate(p) for p in zip(*parts))


def _decompose(y: np.ndarray, period: int, seasonal: int, robust: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, n = y.shape
    trend_span = _odd(1.5 * period / (1 - 1.5 / seasonal))
    low_span = _odd(period + 1)
    inner, outer = (2, 15) if robust else (5, 0)
    trends, seasons = np.zeros((m, n)), np.zeros((m, n))
    low_idx, low_factors = _plain_factors(n, low_span)
    # phases of equal length are smoothed together
    lengths = [len(range(p, n, period)) for p in range(period)]
    batches = [
        (k, np.array([p for p in range(period) if lengths[p] == k])[:, None] + period * np.arange(k + 2))
        for k in sorted(set(lengths))
    ]
    deviation = np.std(y, axis=1)
    # the rows that still move, with their state
    live = np.arange(m)
    weights, trend = np.ones((m, n)), np.zeros((m, n))
    for step in range(outer + 1):
        own = y[live]
        for _ in range(inner):
            cycle = np.empty((len(live), n + 2 * period))
            rest = own - trend
            for k, spots in batches:
                rows = spots[:, :k]
                fitted = _smooth(rest[:, rows].reshape(-1, k), seasonal, weights[:, rows].reshape(-1, k), -1, k)
                cycle[:, spots] = fitted.reshape(len(live), *spots.shape)
            if n <= _SHORT:
                low = cycle @ _low_pass(n, period, low_span)
            else:
                low = _moving(_moving(_moving(cycle, period), period), 3)
                low = (low_factors * low[:, low_idx]).sum(axis=2)
            season = cycle[:, period : period + n] - low
            trend = _smooth(own - season, trend_span, weights, 0, n - 1)
        trends[live], seasons[live] = trend, season
        if step < outer:
            resid = np.abs(own - season - trend)
            scale = 6 * np.median(resid, axis=1)
            # nearly exact fit: nothing left to weigh down
            moves = ~(scale <= 1e-6 * deviation[live])
            if not moves.any():
                break
            live, trend = live[moves], trend[moves]
            r = np.minimum(resid[moves] / scale[moves, None], 1.0)
            weights = (1 - r**2) ** 2
    return trends, seasons, y - trends - seasons


def adf_statistic(y: np.ndarray) -> tuple[float, int]:
    """t statistic of the lagged level (with constant); lag order by the information criterion."""
    n = len(y)
    d = np.diff(y)
    most = min(int(np.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)

    def design(lags: int, start: int):
        rows = np.arange(start, len(d))
        cols = [y[rows]] + [d[rows - k] for k in range(1, lags + 1)] + [np.ones(len(rows))]
        return np.column_stack(cols), d[rows]

    best, chosen = np.inf, 0
    for lags in range(most + 1):
        x, t = design(lags, most)
        beta, *_ = np.linalg.lstsq(x, t, rcond=None)
        sse = float(((t - x @ beta) ** 2).sum())
        m = len(t)
        aic = m * np.log(max(sse, 1e-300) / m) + 2 * x.shape[1]
        if aic < best:
            best, chosen = aic, lags
    x, t = design(chosen, chosen)
    beta, *_ = np.linalg.lstsq(x, t, rcond=None)
    resid = t - x @ beta
    s2 = float(resid @ resid) / (len(t) - x.shape[1])
    se = np.sqrt(s2 * np.linalg.pinv(x.T @ x)[0, 0])
    return float(beta[0] / se) if se > 0 else float("nan"), chosen


def kpss_statistic(y: np.ndarray) -> tuple[float, int]:
    """Level stationarity statistic with the data-driven lag choice."""
    n = len(y)
    e = y - y.mean()
    cover = int(n ** (2.0 / 9.0))
    s0 = float(e @ e) / n
    s1 = 0.0
    for i in range(1, cover + 1):
        prod = float(e[i:] @ e[:-i]) / (n / 2.0)
        s0 += prod
        s1 += i * prod
    gamma = 1.1447 * ((s1 / s0) ** 2) ** (1.0 / 3.0) if s0 != 0 else 0.0
    lags = min(int(gamma * n ** (1.0 / 3.0)), n - 1)
    eta = float((np.cumsum(e) ** 2).sum()) / n**2
    var = float(e @ e)
    for i in range(1, lags + 1):
        var += 2 * float(e[i:] @ e[:-i]) * (1 - i / (lags + 1.0))
    var /= n
    return (eta / var if var > 0 else float("nan")), lags
