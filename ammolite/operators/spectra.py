"""Spectra, wavelets and filters of evenly sampled series (series, pos, v), positions from 0 to n - 1.

Long series are transformed and convolved in pieces (see `functions.fourier`); windows and segments are groups of their own.
Positions without a value count as 0, so series with gaps should be interpolated first. Frequencies are cycles a sample unless a step is given.
"""

from __future__ import annotations

import math
import zlib
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions.fourier import MOST, convolved, dft, filtered
from ammolite.functions.special import chi2_sf
from ammolite.functions.storage import cut


def centred(x: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(rows (series, pos, re, im) of all positions, less the series' mean over n; (series, mean, variance))."""
    sums = cut(x.groupBy("series").agg((F.sum("v") / n).alias("mean"), (F.sum(F.col("v") * F.col("v")) / n).alias("square")), "moments")
    moments = sums.select("series", "mean", F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean")).alias("variance"))
    every = sums.select("series", "mean", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("pos")) if n <= MOST else x.sparkSession.range(n).select(F.col("id").alias("pos")).crossJoin(F.broadcast(sums.select("series", "mean")))
    rows = every.join(x.select("series", F.col("pos").cast("long").alias("pos"), "v"), ["series", "pos"], "left")
    return rows.select("series", "pos", (F.coalesce("v", F.lit(0.0)) - F.col("mean")).alias("re"), F.lit(0.0).alias("im")), moments


def power_spectrum(x: DataFrame, n: int, step: float = 1.0, most: int = MOST) -> DataFrame:
    """(series, k, frequency, power) for k = 1 to n // 2: squared amplitude over n times the variance, so that white noise has a mean of 1."""
    rows, moments = centred(x, n)
    square = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    found = dft(rows, n, most=most).where(F.col("pos").between(1, n // 2)).join(moments, "series")
    return found.select("series", F.col("pos").alias("k"), (F.col("pos") / (n * step)).alias("frequency"), (square / (n * F.col("variance"))).alias("power"))


def dpss(n: int, nw: float, k: int) -> tuple[float, np.ndarray]:
    """(concentration, taper k of unit energy) of the discrete prolate sequences of n points, the most concentrated being taper 0.

    The taper is an eigenvector of a symmetric tridiagonal matrix: its eigenvalue by counting sign changes while
    halving an interval, the vector by inverse iteration. Its first value is positive.
    """
    w, t = nw / n, np.arange(n, dtype=float)
    diag, off = ((n - 1 - 2 * t) / 2) ** 2 * math.cos(2 * math.pi * w), t[1:] * (n - t[1:]) / 2
    if n <= 600:
        v = np.linalg.eigh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))[1][:, n - 1 - k]
    else:
        d, squares = diag.tolist(), [0.0, *(off * off).tolist()]
        radius = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
        lo, hi = float((diag - radius).min()), float((diag + radius).max())
        while hi - lo > 1e-14 * max(1.0, abs(lo), abs(hi)):
            mid = (lo + hi) / 2
            if mid in (lo, hi):
                break
            above, q = 0, 1.0
            for a, b in zip(d, squares):
                q = a - mid - b / q
                if q == 0.0:
                    q = 1e-300
                above += q > 0
            lo, hi = (mid, hi) if above > k else (lo, mid)
        value, o = (lo + hi) / 2, off.tolist()
        # tapers are even or odd: start with one of the right kind
        v = np.ones(n) if k % 2 == 0 else np.where(t < (n - 1) / 2, 1.0, -1.0)
        shift = value + 1e-13 * max(1.0, abs(value))
        for _ in range(4):
            v = _solve(d, o, shift, v)
            v /= np.sqrt((v * v).sum())
    v = v / np.sqrt((v * v).sum())
    v = -v if v[0] < 0 else v
    spectrum = np.fft.rfft(v, 2 * n)
    auto = np.fft.irfft(spectrum * spectrum.conj(), 2 * n)[:n]
    kernel = 4 * w * np.sinc(2 * w * t)
    kernel[0] = 2 * w
    return float(auto @ kernel), v


def _solve(d: list, o: list, shift: float, v: np.ndarray) -> np.ndarray:
    """(T - shift) x = v for a symmetric tridiagonal T, by elimination."""
    n, c, y = len(d), [0.0] * len(d), v.tolist()
    pivot = d[0] - shift
    for i in range(n - 1):
        pivot = pivot or 1e-300
        c[i] = o[i] / pivot
        y[i] /= pivot
        y[i + 1] -= o[i] * y[i]
        pivot = d[i + 1] - shift - o[i] * c[i]
    y[n - 1] /= pivot or 1e-300
    for i in range(n - 2, -1, -1):
        y[i] -= c[i] * y[i + 1]
    return np.array(y)


def tapers(spark, n: int, nw: float, count: int) -> DataFrame:
    """(taper, concentration, pos, w), each taper made in a task of its own."""

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                share, v = dpss(n, nw, k)
                for i in range(0, n, 65536):
                    part = v[i : i + 65536]
                    yield pa.record_batch([pa.array([k] * len(part), pa.int32()), pa.array([share] * len(part)), pa.array(np.arange(i, i + len(part))), pa.array(part)], names=["taper", "concentration", "pos", "w"])

    return cut(spark.range(0, count, 1, count).mapInArrow(run, "taper int, concentration double, pos long, w double"), "tapers")


def multitaper(x: DataFrame, n: int, nw: float = 3.0, step: float = 1.0, most: int = MOST) -> DataFrame:
    """(series, k, frequency, power, dof, p): spectra under 2 nw - 1 tapers, averaged by concentration; p by chi-square under white noise."""
    count = max(1, min(int(2 * nw - 1), n // 2))
    w = tapers(x.sparkSession, n, nw, count)
    rows, moments = centred(x, n)
    tapered = rows.join(w.select("pos", "taper", "w"), "pos").select(F.struct("series", "taper").alias("key"), "pos", (F.col("re") * F.col("w")).alias("re"))
    # series and taper as one name, since a transform's key is one column
    names = cut(tapered.select("key").distinct().withColumn("series", F.xxhash64("key")), "tapered")
    spectra = dft(tapered.withColumn("series", F.xxhash64("key")).select("series", "pos", "re", F.lit(0.0).alias("im")), n, most=most).where(F.col("pos").between(1, n // 2))
    shares = w.select("taper", "concentration").distinct()
    total = shares.agg(F.sum("concentration").alias("s"), F.sum(F.col("concentration") * F.col("concentration")).alias("q"))
    found = spectra.join(names.select("series", F.col("key.series").alias("of"), F.col("key.taper").alias("taper")), "series").join(F.broadcast(shares), "taper")
    found = found.groupBy("of", "pos").agg(F.sum(F.col("concentration") * (F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("e"))
    found = found.withColumnRenamed("of", "series").join(moments, "series").join(F.broadcast(total), how="cross")
    dof = 2 * F.col("s") * F.col("s") / F.col("q")
    power = F.col("e") / (F.col("s") * F.col("variance"))
    return found.select("series", F.col("pos").alias("k"), (F.col("pos") / (n * step)).alias("frequency"), power.alias("power"), dof.alias("dof")).withColumn("p", chi2_sf(F.col("dof") * F.col("power"), F.col("dof")))


def gaussian_lowpass(x: DataFrame, n: int, sigma: float, most: int = MOST) -> DataFrame:
    """(series, pos, v): smoothed by a Gaussian of the given standard deviation in samples; the level is kept."""
    rows = x.select("series", "pos", F.col("v").alias("re"), F.lit(0.0).alias("im"))
    return filtered(rows, n, lambda f: F.exp(-2 * math.pi**2 * sigma**2 * f * f), most)


def gaussian_bandpass(x: DataFrame, n: int, period: float, sigma: float | None = None, most: int = MOST) -> DataFrame:
    """(series, pos, v): around one period in samples, less the mean; the Gaussian's width is period / 2 pi unless given."""
    sigma = period / (2 * math.pi) if sigma is None else sigma
    rows, _ = centred(x, n)
    return filtered(rows, n, lambda f: F.exp(-2 * math.pi**2 * sigma**2 * (f - 1 / period) * (f - 1 / period)), most)


def bandpass(x: DataFrame, n: int, shortest: float, longest: float, most: int = MOST) -> DataFrame:
    """(series, pos, v): between two periods in samples, at which the power is halved, less the mean."""
    centre, half = (1 / longest + 1 / shortest) / 2, (1 / shortest - 1 / longest) / 2
    rows, _ = centred(x, n)
    return filtered(rows, n, lambda f: F.exp(-math.log(math.sqrt(2)) * ((f - centre) / half) * ((f - centre) / half)), most)


def taner_kernel(n: int, period: float) -> np.ndarray:
    """Weights of a band from half to twice the frequency of a period, under a four-term Blackman-Harris window."""
    # fixed values: eight periods of the upper edge, four of the lower one, the window's terms
    low, high = 1 / (2 * period), 2 / period
    half = max(1, min(max(math.ceil(8 / high), math.ceil(4 / low)), max(1, (n - 1) // 2)))
    lag = np.arange(-half, half + 1, dtype=float)
    angle = 2 * np.pi * np.arange(2 * half + 1) / (2 * half)
    window = 0.35875 - 0.48829 * np.cos(angle) + 0.14128 * np.cos(2 * angle) - 0.01168 * np.cos(3 * angle)
    return (2 * high * np.sinc(2 * high * lag) - 2 * low * np.sinc(2 * low * lag)) * window


def taner_filter(x: DataFrame, n: int, period: float, block: int = MOST) -> DataFrame:
    """(series, pos, v): weighted band-pass around a period in samples; the series is mirrored at its ends."""
    kernel = taner_kernel(n, period)
    half = len(kernel) // 2
    mirrored = F.array(F.col("pos"), F.when(F.col("pos").between(1, half), -F.col("pos")), F.when(F.col("pos").between(n - 1 - half, n - 2), 2 * (n - 1) - F.col("pos")))
    rows = x.select("series", F.explode(F.array_compact(mirrored)).alias("pos"), F.col("v").alias("re"))
    return convolved(rows, n, {0: kernel}, block).select("series", "pos", F.col("re").alias("v"))


def wavelet_shape(scale: float, kind: str) -> np.ndarray:
    """A wavelet of unit energy over five scales to either side: Morlet of central frequency 6, or the Mexican hat."""
    length = max(math.ceil(10 * scale) | 1, 7)
    eta = (np.arange(length) - (length - 1) / 2) / scale
    shape = np.exp(-(eta**2) / 2) * (np.exp(6j * eta) * np.pi**-0.25 if kind == "morlet" else 1 - eta**2)
    return shape / np.sqrt((np.abs(shape) ** 2).sum())


def wavelet(x: DataFrame, n: int, scales: list[int], kind: str = "morlet", block: int = MOST) -> DataFrame:
    """(series, scale, frequency, pos, power, reliable): squared wavelet coefficients at each scale and position.

    A coefficient is reliable where the nearer end is at least sqrt(2) scales away.
    """
    if kind not in ("morlet", "mexican_hat"):
        raise ValueError(f"unknown wavelet {kind!r}")
    kernels = {s: wavelet_shape(s, kind)[::-1].conj() for s in scales}
    length = 4 * math.pi / (6 + math.sqrt(38)) if kind == "morlet" else 2 * math.pi / math.sqrt(2.5)
    out = convolved(x.select("series", "pos", F.col("v").alias("re")), n, kernels, block)
    edge = F.least(F.col("pos"), n - 1 - F.col("pos"))
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    return out.select("series", F.col("kernel").alias("scale"), (1 / (length * F.col("kernel"))).alias("frequency"), "pos", power.alias("power"), (edge >= math.sqrt(2) * F.col("kernel")).alias("reliable"))


def evolutionary(x: DataFrame, n: int, window: int, overlap: float = 0.5, frequencies: int = 200, method: str = "fft", nw: float = 3.0) -> DataFrame:
    """(series, start, frequency, power) of windows of `window` samples, whose starts are window * (1 - overlap) apart.

    Frequencies begin at one cycle a window and go on in quarters of it. "fft" gives the squared amplitude of the
    window's values as they are over its squared length, twice except at the highest frequency; "mtm" the average under tapers over the window's variance.
    """
    if method not in ("fft", "mtm"):
        raise ValueError(f"unknown method {method!r}")
    step, length = max(1, round(window * (1 - overlap))), 4 * window
    bins = 4 + np.arange(max(1, min(frequencies, length // 2 - 3)))
    count = max(1, min(int(2 * nw - 1), window // 2))
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - window + 1) / step))
    last = F.least(F.floor(F.col("pos") / step), F.lit((n - window) // step))
    rows = x.select("series", F.col("pos").cast("long").alias("pos"), "v").withColumn("first", first).withColumn("last", last).where("first <= last")
    rows = rows.select("series", "pos", "v", F.explode(F.sequence("first", "last")).alias("start"))
    held = {}

    def run(key, f):
        v = np.zeros(window)
        v[f["pos"].to_numpy() - key[1] * step] = f["v"]
        if method == "fft":
            power = np.abs(np.fft.rfft(v, length)) ** 2 / window**2 * 2
            power[-1] /= 2
        else:
            if not held:
                held["w"] = [dpss(window, nw, k) for k in range(count)]
            v = v - v.mean()
            spread, total = (v**2).mean(), sum(s for s, _ in held["w"])
            power = sum(s * np.abs(np.fft.rfft(t * v, length)) ** 2 for s, t in held["w"]) / (total * spread) if spread > 0 else np.zeros(length // 2 + 1)
        return pd.DataFrame({"series": [key[0]] * len(bins), "start": key[1] * step, "frequency": bins / length, "power": power[bins]})

    kind = dict(x.dtypes)["series"]
    return rows.groupBy("series", "start").applyInPandas(run, f"series {kind}, start long, frequency double, power double")


def coherence(x: DataFrame, y: DataFrame, n: int, segments: int = 4) -> DataFrame:
    """(k, frequency, coherence, phase) of two evenly sampled series (pos, v) over segments of n // segments samples, for k = 1 to half of that.

    Segments are centred and transformed one by one; spectra and cross spectra are averaged over them. The phase is that of the second series
    against the first, in radians. Where either has no power, the coherence is null.
    """
    length = n // segments
    both = x.select("pos", F.col("v").alias("a")).join(y.select("pos", F.col("v").alias("b")), "pos").where(F.col("pos") < length * segments)

    def run(key, f):
        z = np.zeros((2, length))
        z[:, f["pos"].to_numpy() % length] = f[["a", "b"]].to_numpy().T
        a, b = np.fft.rfft(z - z.mean(1, keepdims=True))[:, 1:]
        cross = a.conj() * b
        return pd.DataFrame({"k": np.arange(1, len(a) + 1), "xx": np.abs(a) ** 2, "yy": np.abs(b) ** 2, "re": cross.real, "im": cross.imag})

    parts = both.groupBy(F.floor(F.col("pos") / length).alias("segment")).applyInPandas(run, "k long, xx double, yy double, re double, im double")
    s = parts.groupBy("k").agg(*(F.sum(c).alias(c) for c in ("xx", "yy", "re", "im")))
    level = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.nullif(F.col("xx") * F.col("yy"), F.lit(0.0))
    return s.select("k", (F.col("k") / length).alias("frequency"), level.alias("coherence"), F.atan2("im", "re").alias("phase"))


def red_windows(n: int, count: int, fraction: float) -> tuple[np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
    """(grid in units of 1 / n, windows (first place, tricube weights), odd window widths) of `count` frequencies from 1 to n // 2.

    A window is as wide as twice the fraction of its frequency, at least 5 points and at most a quarter of the grid.
    """
    grid = np.linspace(1, n // 2, count)
    widths = np.clip(np.round(2 * fraction * grid / (grid[1] - grid[0])), 5, max(5, count // 4)).astype(int) | 1
    windows = []
    for m, w in enumerate(widths.tolist()):
        lo, hi = max(0, m - w // 2), min(count, m + w // 2 + 1)
        windows.append((lo, (1 - ((np.arange(lo, hi) - m) / (w / 2)) ** 2) ** 3))
    return grid, windows, widths


def _averaged(v: np.ndarray, windows: list) -> np.ndarray:
    return np.array([v[lo : lo + len(w)] @ w / w.sum() for lo, w in windows])


def red_noise(n: int, phi: float, rng: np.random.Generator) -> np.ndarray:
    """A first-order autoregression of unit variance, centred."""
    shocks = rng.normal(size=n)
    shocks[1:] *= math.sqrt(1 - phi * phi)
    v = np.fromiter(accumulate(shocks.tolist(), lambda a, b: phi * a + b), float, n)
    return v - v.mean()


def redfit(x: DataFrame, n: int, step: float = 1.0, frequencies: int | None = None, window: float = 0.6, simulations: int = 100, level: float = 0.05, seed: int = 1, most: int = MOST) -> DataFrame:
    """(series, k, frequency, phi, raw, score, power, red, noise_sd, width, dof, p, peak): a periodogram against red noise, frequency by frequency.

    The series loses its straight line; phi is its first autocorrelation (within 0.99 of 0), `raw` the periodogram's distance
    from red noise of that phi over its root, on a grid of five points a resolution element (200 to 4,000 unless given, at least 32).
    `score`, `power` and `red` are raw distances, periodogram and red noise averaged under tricube windows, `dof` the
    effective number of points under one. p = (1 + replicates of red noise whose averaged power is at least the series') /
    (simulations + 1), 1 without any. A peak has p at most `level` and a positive score no smaller than its neighbours'.

    phi comes from the transform (the circular product less the pair that closes the circle), so the series is not joined with
    itself. A replicate is made and transformed in one task, n values. Series without variance have no rows; empty tables give none.
    """
    if not 0 < window < 5:
        raise ValueError("the window must lie between 0 and 5")
    if n < 16:
        raise ValueError("at least 16 positions are needed")
    count = frequencies or min(4000, max(200, 5 * max(2, round(n // 2 / n * (n - 1)))))
    if count < 32:
        raise ValueError("at least 32 frequencies are needed")
    spark, kind, half = x.sparkSession, dict(x.dtypes)["series"], n // 2
    rows, _ = centred(x, n)
    middle = (n - 1) / 2
    slopes = cut(rows.groupBy("series").agg((F.sum(F.col("re") * (F.col("pos") - middle)) / (n * (n * n - 1) / 12)).alias("slope")), "slopes")
    rows = cut(rows.join(slopes, "series").select("series", "pos", (F.col("re") - F.col("slope") * (F.col("pos") - middle)).alias("re"), "im"), "detrended")
    square = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    spectrum = cut(dft(rows, n, most=most).select("series", "pos", square.alias("e")), "spectrum")
    ends = rows.where(F.col("pos").isin(0, n - 1)).groupBy("series").agg(F.sum(F.when(F.col("pos") == 0, F.col("re"))).alias("first"), F.sum(F.when(F.col("pos") == n - 1, F.col("re"))).alias("last"))
    sums = spectrum.groupBy("series").agg((F.sum("e") / n).alias("s0"), (F.sum(F.col("e") * F.cos(2 * math.pi * F.col("pos") / n)) / n).alias("s1")).join(ends, "series")
    later = F.col("s0") - F.col("first") * F.col("first")
    phi = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), (F.col("s1") - F.col("first") * F.col("last")) / later))
    # what a straight line leaves of itself by rounding is no variance
    levels = rows.join(slopes, "series").groupBy("series").agg(F.max(F.abs(F.col("slope") * middle)).alias("line"))
    fits = cut(sums.join(levels, "series").where((F.col("s0") / n > 0) & (F.sqrt(F.col("s0") / n) > 1e-12 * F.col("line"))).select("series", F.when(later > 0, phi).otherwise(0.0).alias("phi"), (F.col("s0") / n).alias("variance")), "fits")
    grid, windows, widths = red_windows(n, count, window)
    below = np.minimum(np.floor(grid).astype(int), half - 1)
    share = grid - below
    # two rows a grid point
    ties = spark.createDataFrame(pd.DataFrame({"k": np.tile(np.arange(count), 2), "pos": np.concatenate([below, below + 1]), "w": np.concatenate([1 - share, share])}), "k int, pos long, w double")
    fine = spectrum.where(F.col("pos").between(1, half)).join(F.broadcast(ties), "pos").join(fits, "series")
    fine = fine.groupBy("series", "phi", "k").agg(F.sum(F.col("w") * F.col("e") / (n * F.col("variance"))).alias("power"))
    totals = np.array([w.sum() for _, w in windows])
    squares = np.array([(w * w).sum() for _, w in windows])
    angle = 2 * math.pi * grid / n

    def fit(key, f):
        phi, power = key[1], np.zeros(count)
        power[f["k"].to_numpy()] = f["power"]
        red = (1 - phi**2) / (1 - 2 * phi * np.cos(angle) + phi**2)
        spread = (1 - phi**4) / (n**2 * (1 - 2 * phi**2 * np.cos(2 * angle) + phi**4))
        raw = (power - red) / np.sqrt(red)
        sd = np.sqrt(np.array([spread[lo : lo + len(w)] @ (w * w) for lo, w in windows]) / squares) * totals
        out = {"series": [key[0]] * count, "k": np.arange(count), "frequency": grid / (n * step), "phi": phi, "raw": raw, "score": _averaged(raw, windows)}
        return pd.DataFrame(out | {"power": _averaged(power, windows), "red": _averaged(red, windows), "noise_sd": sd, "width": widths, "dof": totals**2 / squares})

    found = cut(fine.groupBy("series", "phi").applyInPandas(fit, f"series {kind}, k int, frequency double, phi double, raw double, score double, power double, red double, noise_sd double, width int, dof double"), "redfit")
    if simulations < 1:
        tested = found.withColumn("p", F.lit(1.0))
    else:

        def replicate(batches):
            for batch in batches:
                names, hits = batch.column("series"), []
                for name, rep, phi, seen in zip(names.to_pylist(), *(batch.column(c).to_pylist() for c in ("rep", "phi", "seen"))):
                    v = red_noise(n, phi, np.random.default_rng([seed, rep, zlib.crc32(str(name).encode())]))
                    power = np.abs(np.fft.rfft(v)) ** 2 / (n * (v**2).mean())
                    null = _averaged(power[below] * (1 - share) + power[below + 1] * share, windows)
                    hits.append((null >= np.array(seen)).astype(np.int32).tolist())
                yield pa.record_batch([names, pa.array(hits, pa.list_(pa.int32()))], names=["series", "hits"])

        seen = found.groupBy("series", "phi").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "power"))), lambda c: c["power"]).alias("seen"))
        dealt = seen.crossJoin(F.broadcast(spark.range(simulations).withColumnRenamed("id", "rep"))).repartition("series", "rep")
        drawn = dealt.select("series", "rep", "phi", "seen").mapInArrow(replicate, f"series {kind}, hits array<int>")
        counts = drawn.select("series", F.posexplode("hits").alias("k", "hit")).groupBy("series", "k").agg(F.sum("hit").alias("hits"))
        tested = found.join(counts, ["series", "k"]).withColumn("p", (F.col("hits") + 1) / (simulations + 1)).drop("hits")
    near = W.partitionBy("series").orderBy("k")  # as many rows as there are frequencies
    peak = (F.col("p") <= level) & (F.col("score") > 0) & (F.col("score") >= F.lag("score").over(near)) & (F.col("score") >= F.lead("score").over(near))
    return tested.withColumn("peak", F.coalesce(peak, F.lit(False)))
