"""Empirical mode decomposition of series (series, pos, v), each in a task of its own; ensembles have a task a series and trial.

Sifting takes the mean of two envelopes, natural cubic splines through the maxima and through the minima, off what is left, again and again;
every step needs the whole series, so a series must fit a task, and series and trials are what runs side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the range that an envelope mean may have, and relative change at which sifting has converged.
ENVELOPE_SHARE, CONVERGED = 0.05, 1e-10


def extrema(x: np.ndarray) -> np.ndarray:
    """Places of inner maxima; a level stretch counts at its middle."""
    edges = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.append(0, edges + 1), np.append(edges, len(x) - 1)
    levels = x[starts]
    top = np.flatnonzero((levels[1:-1] > levels[:-2]) & (levels[1:-1] > levels[2:])) + 1
    return (starts[top] + ends[top]) // 2


def natural_spline(t: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline through (t, y) whose second derivative is 0 at both ends, its end pieces going on beyond them."""
    n, h = len(t), np.diff(t)
    m = np.zeros(n)
    if n > 2:
        slope = np.diff(y) / h
        diag, right, upper = (2 * (h[:-1] + h[1:])).tolist(), (6 * np.diff(slope)).tolist(), h[1:-1].tolist()
        for i in range(1, n - 2):
            w = upper[i - 1] / diag[i - 1]
            diag[i] -= w * upper[i - 1]
            right[i] -= w * right[i - 1]
        for i in range(n - 3, -1, -1):
            right[i] = (right[i] - (upper[i] * right[i + 1] if i < n - 3 else 0.0)) / diag[i]
        m[1:-1] = right
    k = np.clip(np.searchsorted(t, at, "right") - 1, 0, n - 2)
    a, b = (t[k + 1] - at) / h[k], (at - t[k]) / h[k]
    return a * y[k] + b * y[k + 1] + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h[k] ** 2 / 6


def envelope_mean(x: np.ndarray) -> np.ndarray | None:
    high, low = extrema(x), extrema(-x)
    if len(high) < 2 or len(low) < 2:
        return None
    at = np.arange(len(x), dtype=float)
    return (natural_spline(high.astype(float), x[high], at) + natural_spline(low.astype(float), x[low], at)) / 2


def is_mode(x: np.ndarray) -> bool:
    """As many extrema as changes of sign, but for one, and an envelope mean that is small against the range."""
    signs = np.signbit(x[x != 0])
    if abs(len(extrema(x)) + len(extrema(-x)) - int((signs[1:] != signs[:-1]).sum())) > 1:
        return False
    mean = envelope_mean(x)
    return mean is None or np.ptp(x) <= 0 or np.abs(mean).max() <= ENVELOPE_SHARE * np.ptp(x)


def decompose(x: np.ndarray, modes: int, sifts: int, tolerance: float) -> list[np.ndarray]:
    """Modes, fastest first, then the trend: they add up to the series."""
    out, trend, scale = [], x.copy(), x.std()
    for _ in range(modes):
        h, before, taken = trend.copy(), trend.copy(), 0
        for _ in range(sifts):
            mean = envelope_mean(h)
            if mean is None:
                break
            new = h - mean
            power = float(before @ before)
            overlap = float(before @ new) / power if power > 0 else 0.0
            before, h, taken = h, new, taken + 1
            if is_mode(h):
                size = np.sqrt(h @ h)
                if overlap < tolerance or size > 0 and np.sqrt(((h - before) ** 2).sum()) / size < CONVERGED:
                    break
        if not taken or h.std() <= 0:
            break
        out.append(h)
        trend = trend - h
        if trend.std() <= scale * 1e-12:
            break
    return [*out, trend]


def emd(x: DataFrame, modes: int = 10, sifts: int = 50, tolerance: float = 0.2, trials: int = 1, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """(series, mode, pos, v): modes from 1, the trend as mode 0; with several trials their means over series with added noise.

    Each trial adds normal noise of `noise` standard deviations of the series, once with either sign, seeded by series and trial; a mode that a trial lacks
    counts as 0 there. Series of fewer than 8 values, and constant ones, are all trend.
    """
    kinds = dict(x.dtypes)
    rows = x.select("series", F.col("pos").cast("long").alias("pos"), F.col("v").cast("double").alias("v")).withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))

    def run(key, f):
        f = f.sort_values("pos")
        v = f["v"].to_numpy()
        total = np.zeros((modes + 1, len(v)))
        signs = (1.0, -1.0) if noise > 0 else (1.0,)
        shift = np.random.default_rng([seed, int(key[1])]).normal(0, 1, len(v)) * noise * v.std()
        for s in signs:
            parts = decompose(v + s * shift, modes, sifts, tolerance) if len(v) >= 8 and np.ptp(v) > 0 else [v]
            for k, part in enumerate(parts):
                total[(k + 1) % len(parts)] += part / len(signs)
        rows = np.flatnonzero((total != 0).any(1) | (np.arange(len(total)) == 0))
        return pd.DataFrame({"series": [key[0]] * (len(rows) * len(v)), "trial": key[1], "mode": np.repeat(rows, len(v)), "pos": np.tile(f["pos"].to_numpy(), len(rows)), "v": total[rows].ravel()})

    parts = rows.groupBy("series", "trial").applyInPandas(run, f"series {kinds['series']}, trial int, mode int, pos long, v double")
    return parts.groupBy("series", "mode", "pos").agg((F.sum("v") / trials).alias("v"))
