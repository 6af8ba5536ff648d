"""Distributed transforms, tapers and filters against NumPy on whole series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ammolite.functions import fourier
from ammolite.operators import spectra


def rows(spark, *series):
    return spark.createDataFrame([(k, t, float(z.real), float(z.imag)) for k, s in enumerate(series) for t, z in enumerate(s)], "series int, pos long, re double, im double")


def values(df, n, name="series"):
    out = {}
    for r in df.collect():
        out.setdefault(r[name], np.zeros(n, complex))[r.pos] = complex(r.re, r.im)
    return out


@pytest.mark.parametrize(("n", "most"), [(60, 64), (60, 16), (97, 32), (105, 24)])
def test_transform_of_any_length(spark, n, most):
    """One piece, factors, and primes, which need a chirp."""
    rng = np.random.default_rng(n)
    x = [rng.normal(size=n) + 1j * rng.normal(size=n) for _ in range(2)]
    got = values(fourier.dft(rows(spark, *x), n, most=most), n)
    back = values(fourier.dft(fourier.dft(rows(spark, *x), n, most=most), n, inverse=True, most=most), n)
    for k in range(2):
        assert np.allclose(got[k], np.fft.fft(x[k])) and np.allclose(back[k], x[k])


def test_one_series_is_several_tasks(spark):
    n = 4096
    short = fourier.dft(rows(spark, np.arange(n, dtype=float)), n, most=64)
    assert fourier._classes(n, 64) == 64 and fourier._classes(97, 16) is None and fourier._classes(10**12, 1 << 20) == 1_000_000
    assert short.count() == n


def test_convolution_over_blocks(spark):
    rng = np.random.default_rng(4)
    x, n = rng.normal(size=300), 300
    kernels = {1: rng.normal(size=7), 2: rng.normal(size=201) + 1j * rng.normal(size=201)}
    got = values(fourier.convolved(rows(spark, x), n, kernels, block=32), n, "kernel")
    for k, w in kernels.items():
        h = len(w) // 2
        assert np.allclose(got[k], np.convolve(x, w)[h : h + n])


@pytest.mark.parametrize("n", [100, 900])
def test_tapers_are_orthonormal_and_concentrated(n):
    found = [spectra.dpss(n, 3.0, k) for k in range(5)]
    v = np.array([t for _, t in found])
    assert np.allclose(v @ v.T, np.eye(5), atol=1e-7) and all(t[0] > 0 for _, t in found)
    lag = np.arange(n)[:, None] - np.arange(n)[None]
    inside = np.where(lag == 0, 6 / n, np.sin(2 * np.pi * 3 / n * lag) / (np.pi * np.where(lag == 0, 1, lag)))
    assert np.allclose([s for s, _ in found], [t @ inside @ t for t in v], atol=1e-7)
    assert sorted((s for s, _ in found), reverse=True) == [s for s, _ in found] and found[0][0] > 0.999999
    assert all(np.allclose(inside @ t, s * t, atol=1e-6) for s, t in found)


def test_multitaper_finds_a_period_and_matches_whole_transforms(spark):
    n = 240
    x = np.sin(2 * np.pi * np.arange(n) / 20) + np.random.default_rng(2).normal(size=n) * 0.3
    df = spark.createDataFrame([("s", t, float(v)) for t, v in enumerate(x)], "series string, pos long, v double")
    got = sorted(spectra.multitaper(df, n, 3.0, 0.5, most=32).collect(), key=lambda r: r.k)
    z = x - x.mean()
    found = [spectra.dpss(n, 3.0, k) for k in range(5)]
    want = sum(s * np.abs(np.fft.rfft(t * z)) ** 2 for s, t in found) / (sum(s for s, _ in found) * z.var())
    assert np.allclose([r.power for r in got], want[1:]) and np.isclose(got[11].frequency, 0.1)
    assert abs(max(got, key=lambda r: r.power).k - 12) <= 3 and min(got, key=lambda r: r.p).p < 1e-6
    windows = spectra.evolutionary(df, n, 60, 0.5, 40, "mtm").collect()
    assert {r.start for r in windows} == {0, 30, 60, 90, 120, 150, 180}


def test_filters_keep_what_they_should(spark):
    n = 360
    t = np.arange(n)
    x = np.sin(2 * np.pi * t / 24) + np.sin(2 * np.pi * t / 5) + 3
    df = spark.createDataFrame([("s", int(k), float(v)) for k, v in enumerate(x)], "series string, pos long, v double")
    series = lambda f: np.array([r.v for r in sorted(f.collect(), key=lambda r: r.pos)])
    assert np.allclose(series(spectra.bandpass(df, n, 18.0, 36.0, 64)), np.sin(2 * np.pi * t / 24), atol=0.05)
    smooth = series(spectra.gaussian_lowpass(df, n, 10.0, 64))
    assert abs(smooth.mean() - 3) < 1e-9 and smooth.std() < 0.1
    inner = series(spectra.taner_filter(df, n, 24.0, 50))[100:260]
    assert np.corrcoef(inner, np.sin(2 * np.pi * t / 24)[100:260])[0, 1] > 0.99
    best = spectra.wavelet(df, n, list(range(3, 40, 2)), "morlet", 100).where("reliable").groupBy("scale").agg(F.avg("power").alias("p")).orderBy(F.desc("p")).first()
    assert abs(best.scale - 24) <= 2
    with pytest.raises(ValueError):
        spectra.wavelet(df, n, [3], "haar")


def test_coherence_of_a_series_with_itself_delayed(spark):
    n = 400
    x = np.random.default_rng(3).normal(size=n + 2)
    one = lambda v: spark.createDataFrame([(t, float(z)) for t, z in enumerate(v)], "pos long, v double")
    got = spectra.coherence(one(x[2:]), one(x[:n]), n, 8).collect()
    assert np.mean([r.coherence for r in got]) > 0.8
    r = next(r for r in got if r.k == 5)
    assert abs(r.phase + 2 * np.pi * r.frequency * 2) < 0.5


def plain_redfit(v, frequencies=None, window=0.6):
    """REDFIT's curves of one series by plain loops over whole arrays."""
    n = len(v)
    t = np.arange(n)
    v = v - np.polyval(np.polyfit(t, v, 1), t)
    phi = np.clip((v[1:] * v[:-1]).sum() / (v[1:] ** 2).sum(), -0.99, 0.99)
    power = np.abs(np.fft.rfft(v - v.mean())) ** 2 / (n * v.var())
    count = frequencies or min(4000, max(200, 5 * max(2, round(n // 2 / n * (n - 1)))))
    f = np.linspace(1, n // 2, count)
    fine = np.interp(f, np.arange(1, n // 2 + 1), power[1 : n // 2 + 1])
    red = (1 - phi**2) / (1 - 2 * phi * np.cos(2 * np.pi * f / n) + phi**2)
    raw = (fine - red) / np.sqrt(red)
    out = []
    for m in range(count):
        w = min(max(round(2 * window * f[m] / (f[1] - f[0])), 5), max(5, count // 4))
        w += w % 2 == 0
        u = (np.arange(count) - m) / (w / 2)
        k = np.where(np.abs(u) < 1, (1 - u**2) ** 3, 0)
        out.append((raw @ k / k.sum(), fine @ k / k.sum(), red @ k / k.sum(), k.sum() ** 2 / (k**2).sum()))
    return phi, raw, np.array(out)


def series_rows(spark, **series):
    return spark.createDataFrame([(name, t, float(x)) for name, v in series.items() for t, x in enumerate(v)], "series string, pos long, v double")


@pytest.mark.parametrize(("n", "frequencies"), [(200, None), (97, 60)])
def test_redfit_matches_plain_curves(spark, n, frequencies):
    rng = np.random.default_rng(n)
    v = spectra.red_noise(n, 0.6, rng) + 0.02 * np.arange(n) + 0.8 * np.sin(2 * np.pi * np.arange(n) / 11)
    got = spectra.redfit(series_rows(spark, a=v, b=rng.normal(size=n)), n, 2.0, frequencies, simulations=0, most=64).where("series = 'a'").orderBy("k").toPandas()
    phi, raw, curves = plain_redfit(v, frequencies)
    assert np.allclose(got["phi"], phi) and np.allclose(got["raw"], raw)
    assert np.allclose(got[["score", "power", "red", "dof"]], curves) and np.isclose(got["frequency"].iloc[-1], n // 2 / (2 * n))
    assert (got["p"] == 1).all() and not got["peak"].any()


def test_redfit_finds_a_cycle_in_red_noise(spark):
    """A planted cycle is a peak at its period; red noise alone is called significant about as often as the level says."""
    n, rng = 256, np.random.default_rng(8)
    noise = spectra.red_noise(n, 0.7, rng)
    got = spectra.redfit(series_rows(spark, cycle=noise + 1.5 * np.sin(2 * np.pi * np.arange(n) / 8), noise=noise), n, simulations=99).toPandas()
    peaks = got[got["peak"] & (got["series"] == "cycle")]
    assert abs(1 / peaks.loc[peaks["score"].idxmax(), "frequency"] - 8) < 0.3 and peaks["p"].min() == 0.01
    assert (got[got["series"] == "noise"]["p"] <= 0.05).mean() < 0.2
    again = spectra.redfit(series_rows(spark, noise=noise), n, simulations=99).orderBy("k").toPandas()
    assert (again["p"].to_numpy() == got[got["series"] == "noise"].sort_values("k")["p"].to_numpy()).all()


def test_redfit_of_flat_and_empty_series(spark):
    flat = series_rows(spark, line=np.arange(64) * 0.3, level=np.ones(64))
    assert spectra.redfit(flat, 64, simulations=3).count() == 0
    assert spectra.redfit(flat.limit(0), 64, simulations=3).count() == 0
    with pytest.raises(ValueError):
        spectra.redfit(flat, 64, window=6)
