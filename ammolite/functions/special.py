"""Tail probabilities as pandas UDFs: SQL has no incomplete gamma or beta function. Nulls and impossible arguments give null.

They belong on results, a few rows each, not on the rows that those are made from.
"""

from __future__ import annotations

import math
import statistics

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

_each_lgamma = np.frompyfunc(lambda x: math.lgamma(x) if x > 0 else math.nan, 1, 1)
_each_erfc = np.frompyfunc(math.erfc, 1, 1)


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.asarray(_each_lgamma(x), float)


def gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Upper regularised incomplete gamma function: a series where x < a + 1, else a continued fraction (Lentz)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(a.shape, np.nan)
    good = (a > 0) & (x >= 0)
    zero = good & (x == 0)
    out[zero] = 1.0
    front = np.exp(a * np.log(np.where(x > 0, x, 1)) - x - _lgamma(np.where(a > 0, a, 1)))
    low = good & ~zero & (x < a + 1)
    if low.any():
        s = term = 1 / a[low]
        for n in range(1, 2000):
            term = term * x[low] / (a[low] + n)
            s = s + term
            if (term < s * 1e-16).all():
                break
        out[low] = 1 - front[low] * s
    high = good & ~zero & (x >= a + 1)
    if high.any():
        b = x[high] + 1 - a[high]
        c, d = np.full(b.shape, 1e300), 1 / b
        h = d
        for n in range(1, 2000):
            an = -n * (n - a[high])
            b = b + 2
            d, c = 1 / (an * d + b), b + an / c
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[high] = front[high] * h
    return out


def beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by a continued fraction, from the side where it converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c, d = np.ones(p.shape), 1 / (1 - (p + q) * y / (p + 1))
        h = d
        for m in range(1, 500):
            for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1 / (1 + top * d), 1 + top / c
                h = h * d * c
        out = front * h
    out = np.where(y <= 0, 0.0, out)
    out = np.where(flip, 1 - out, out)
    return np.where((a > 0) & (b > 0) & (x >= 0) & (x <= 1), out, np.nan)


def normal_sf_values(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.asarray(_each_erfc(np.asarray(z, float) / math.sqrt(2)), float)


def chi2_sf_values(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return gamma_q(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def t_sf_values(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return np.where(t >= 0, tail, 1 - tail)


def f_sf_values(f: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    f, df1, df2 = (np.asarray(v, float) for v in (f, df1, df2))
    return beta_i(df2 / 2, df1 / 2, df2 / (df2 + df1 * np.maximum(f, 0)))


def _column(values):
    """A UDF of as many columns as `values` has arguments; missing arguments give null."""

    def run(*args: pd.Series) -> pd.Series:
        return pd.Series(values(*(a.astype(float).to_numpy() for a in args))).where(lambda s: s.notna(), None)

    return lambda *columns: F.pandas_udf(run, "double")(*(F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns))


normal_sf = _column(normal_sf_values)
chi2_sf = _column(chi2_sf_values)
t_sf = _column(t_sf_values)
f_sf = _column(f_sf_values)


def lgamma_values(x: np.ndarray) -> np.ndarray:
    return _lgamma(np.asarray(x, float))


def normal_quantile_values(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution, 0 and 1 giving minus and plus infinity; outside of them null."""
    inverse = statistics.NormalDist().inv_cdf
    one = lambda q: inverse(q) if 0 < q < 1 else -math.inf if q == 0 else math.inf if q == 1 else math.nan
    return np.array([one(float(q)) for q in np.asarray(p, float)], float)


def kolmogorov_sf_values(x: np.ndarray) -> np.ndarray:
    """Limit distribution of the largest distance of two empirical distributions."""
    x = np.asarray(x, float)
    k = np.arange(1, 101)[:, None]
    out = 2 * ((-1.0) ** (k - 1) * np.exp(-2.0 * k * k * x * x)).sum(0)
    return np.where(np.isnan(x), np.nan, np.where(x < 0.05, 1.0, np.clip(out, 0, 1)))


#: Values that are summed at once.
CHUNK = 16_384


def _outwards(logs, top: float, start: int, end: int) -> float:
    """Sum of exp(logs - top) from `start` to `end`, either way, over values that never rise; what follows too little to count is left."""
    total, step = 0.0, 1 if end >= start else -1
    while (end - start) * step >= 0:
        n = min(CHUNK, abs(end - start) + 1)
        w = np.exp(logs(start + step * np.arange(n, dtype=float)) - top)
        total += float(w.sum())
        start += step * n
        if w[-1] * (abs(end - start) + 1) <= 1e-18 * total:
            break
    return total


def _no_likelier(logs, low: int, high: int, mode: int, at: int) -> float:
    """The share of low..high that is no likelier than `at` (to 1e-7), of weights exp(logs) that rise up to the mode and fall from it on. Only values near what counts are held."""
    one = lambda i: float(logs(np.array([float(i)]))[0])
    top, limit = one(mode), one(at) + 1e-7
    if limit >= top:
        return 1.0
    a, b = low - 1, mode  # the last one before the mode that counts
    while b - a > 1:
        m = (a + b) // 2
        a, b = (m, b) if one(m) <= limit else (a, m)
    c, d = mode, high + 1  # the first one after it
    while d - c > 1:
        m = (c + d) // 2
        c, d = (c, m) if one(m) <= limit else (m, d)
    tails = (_outwards(logs, top, a, low) if a >= low else 0.0) + (_outwards(logs, top, d, high) if d <= high else 0.0)
    rest = (_outwards(logs, top, mode, low)) + (_outwards(logs, top, mode + 1, high) if mode < high else 0.0)
    return min(1.0, tails / rest)


def binomial_p_values(k: np.ndarray, n: np.ndarray, p0: np.ndarray) -> np.ndarray:
    """Two-sided exact p: the probability of all counts no likelier than k (to 1e-7)."""
    out = []
    for a, m, p in zip(*(np.asarray(v, float) for v in (k, n, p0))):
        if not (0 <= a <= m and 0 < p < 1):
            out.append(math.nan)
            continue
        # terms of a count and of its mirror image add up in the same way, so that they are equal where they should be
        logs = lambda i, m=m, p=p: (i * math.log(p) + (m - i) * math.log1p(-p)) - (_lgamma(i + 1) + _lgamma(m - i + 1))
        out.append(_no_likelier(logs, 0, int(m), min(int(m), int((m + 1) * p)), int(a)))
    return np.array(out, float)


def fisher_p_values(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Two-sided exact p of a 2 x 2 table: the probability of all tables with its margins no likelier than it (to 1e-7)."""
    out = []
    for cells in zip(*(np.asarray(v, float) for v in (a, b, c, d))):
        if not all(x >= 0 for x in cells):
            out.append(math.nan)
            continue
        x, r, k, n = cells[0], cells[0] + cells[1], cells[0] + cells[2], sum(cells)
        low, high = int(max(0.0, r + k - n)), int(min(r, k))
        logs = lambda i, r=r, k=k, n=n: -((_lgamma(i + 1) + _lgamma(n - r - k + i + 1)) + (_lgamma(r - i + 1) + _lgamma(k - i + 1)))
        out.append(_no_likelier(logs, low, high, min(high, max(low, int((r + 1) * (k + 1) // (n + 2)))), int(x)))
    return np.array(out, float)


lgamma = _column(lgamma_values)
normal_quantile = _column(normal_quantile_values)
kolmogorov_sf = _column(kolmogorov_sf_values)
binomial_p = _column(binomial_p_values)
fisher_p = _column(fisher_p_values)
