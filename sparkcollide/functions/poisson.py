"""Poisson probabilities of whole columns by the regularised incomplete gamma function.

P(k <= n | mean) = Q(n + 1, mean).  Left of the mode the complement comes from the
power series, right of it Q comes from the continued fraction; both need about
sqrt(n) steps and a few vectors of memory, whatever n is.  The common factor is
written as a deviance, so large counts lose no digits.
"""

from __future__ import annotations

import math

import numpy as np

EPS = 1e-16
STEPS = 10_000_000
_SMALL = np.array([0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)])


def _stirling_rest(n: np.ndarray) -> np.ndarray:
    """log n! less Stirling's formula, n >= 1."""
    big = np.maximum(n, 16.0)
    r = 1.0 / (big * big)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / big
    return np.where(n < 16, _SMALL[np.minimum(n, 15).astype(int)], series)


def _log1p_less(d: np.ndarray) -> np.ndarray:
    """log(1 + d) - d without cancellation near zero."""
    small = np.abs(d) < 0.3
    r = np.where(small, d / (2 + d), 0.0)
    r2, total = r * r, np.zeros_like(d)
    for k in range(23, 1, -2):  # atanh series, |r| < 0.18
        total = r2 * (1.0 / k + total)
    return np.where(small, -d * r + 2 * r * total, np.log1p(np.where(small, 0.0, d)) - np.where(small, 0.0, d))


def log_pmf(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """log P(k = n), n >= 0, mean > 0."""
    some = np.maximum(n, 1.0)
    return np.where(n == 0, -mean, some * _log1p_less((mean - some) / some) - _stirling_rest(some) - 0.5 * np.log(2 * math.pi * some))


def _series(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """1 + x/(a+1) + x^2/((a+1)(a+2)) + ... with a = n + 1, for x < a."""
    total, term, k = np.ones_like(mean), np.ones_like(mean), np.zeros_like(mean)
    open_ = np.arange(len(mean))
    for step in range(1, STEPS):
        if not len(open_):
            break
        term[open_] *= mean[open_] / (n[open_] + 1 + step)
        total[open_] += term[open_]
        if step % 8 == 0:
            open_ = open_[term[open_] > EPS * total[open_]]
    return total


def _fraction(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Continued fraction of Gamma(a, x) / (x^a e^-x) with a = n + 1, for x >= a (modified Lentz)."""
    tiny, a = 1e-300, n + 1.0
    b = mean + 1 - a
    c, d = np.full_like(mean, 1 / tiny), 1 / np.where(np.abs(b) < tiny, tiny, b)
    value, open_ = d.copy(), np.arange(len(mean))
    for k in range(1, STEPS):
        if not len(open_):
            break
        top, at = k * (a[open_] - k), b[open_] + 2 * k
        low, high = top * d[open_] + at, at + top / c[open_]
        d[open_], c[open_] = 1 / np.where(np.abs(low) < tiny, tiny, low), np.where(np.abs(high) < tiny, tiny, high)
        change = c[open_] * d[open_]
        value[open_] *= change
        open_ = open_[np.abs(change - 1) > EPS * 2]
    return value


def log_cdf(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """log P(k <= n) for whole arrays; n < 0 gives -inf, a mean of zero gives 0, null or negative input NaN."""
    n, mean = np.floor(np.asarray(n, float)), np.asarray(mean, float)
    n, mean = np.broadcast_arrays(n, mean)
    out = np.where((n < 0) & (mean >= 0), -np.inf, np.where((mean == 0) & (n >= 0), 0.0, np.nan))
    for left in (True, False):
        rows = np.flatnonzero((n >= 0) & (mean > 0) & np.isfinite(mean) & ((mean < n + 1) == left))
        k, x = n[rows], mean[rows]
        if left:
            above = np.exp(log_pmf(k + 1, x)) * _series(k, x)
            out[rows] = np.log1p(-np.minimum(above, 1.0))
        else:
            out[rows] = np.minimum(0.0, log_pmf(k, x) + np.log(x * _fraction(k, x)))
    return out


def signal_limit(background: np.ndarray, observed: np.ndarray, alpha: float, relative: bool, largest: float = 1e9) -> np.ndarray:
    """Signal at which P(k <= observed | background + signal), over its value without signal if ``relative``, has fallen to alpha.

    Newton steps on the logarithm, which is concave and falling, kept inside a
    bracket that every step narrows.  Zero where there is nothing left to fall.
    """
    n, b = np.asarray(observed, float), np.asarray(background, float)
    base = log_cdf(n, b) if relative else np.zeros(len(b))
    if len(b) and np.exp(base).min() == 0:
        raise ValueError("no limit: the observed count has probability zero without signal")
    goal = base + math.log(alpha)
    # a normal quantile of the cube root puts the start close to the root
    z = 3.0 - 0.5 * math.log10(max(alpha, 1e-12))
    start = (n + 1) * (1 - 1 / (9 * (n + 1)) + z / (3 * np.sqrt(n + 1))) ** 3 - b
    low, high = np.zeros(len(b)), np.maximum(1.0, start)
    todo = np.arange(len(b))
    while len(todo := todo[log_cdf(n[todo], b[todo] + high[todo]) > goal[todo]]):
        low[todo] = high[todo]
        high[todo] *= 4
        if high[todo].max() > 4 * largest:
            raise ValueError(f"no limit up to a signal of {largest:g}")
    high = np.where(log_cdf(n, b) <= goal, 0.0, high)
    s, todo = high.copy(), np.flatnonzero(high > 0)
    for _ in range(200):
        if not len(todo):
            break
        k, x = n[todo], b[todo] + s[todo]
        value = log_cdf(k, x)
        over = value - goal[todo]
        low[todo], high[todo] = np.where(over > 0, s[todo], low[todo]), np.where(over > 0, high[todo], s[todo])
        with np.errstate(divide="ignore"):  # flat beyond the bracket: halve it
            step = s[todo] + over / np.exp(log_pmf(k, x) - value)
        inside = (step > low[todo]) & (step < high[todo])
        new = np.where(inside, step, 0.5 * (low[todo] + high[todo]))
        moved = np.abs(new - s[todo]) > 1e-13 * np.maximum(1.0, b[todo] + s[todo])
        s[todo] = new
        todo = todo[moved & (high[todo] - low[todo] > 1e-13 * np.maximum(1.0, b[todo] + high[todo]))]
    if len(s) and s.max() > largest:
        raise ValueError(f"no limit up to a signal of {largest:g}")
    return s
