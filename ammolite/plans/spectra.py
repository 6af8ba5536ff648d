"""Spectra, filters and wavelets of the hourly value of events (720 hours, all types together, and by type); a task transforms 128 values at most."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammolite.operators import spectra as o

N, MOST = 720, 128


def hours(s, d, by="'all'"):
    """(series, pos, v): value of the events of each hour; hours without events have none."""
    at = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000)
    return s.read.parquet(f"{d}/events.parquet").groupBy(F.expr(by).alias("series"), at.alias("pos")).agg(F.sum("value").alias("v"))


def _rounded(f, *columns, digits=5):
    return lambda s, d: (lambda x: x.select(*(F.round(c, digits).alias(c) if c in columns else c for c in x.columns)))(f(s, d))


def _kind(s, d, name):
    return hours(s, d, "event_type").where(F.col("series") == name)


QUERIES = {
    "power_spectrum": _rounded(lambda s, d: o.power_spectrum(hours(s, d), N, 1.0, MOST).drop("frequency"), "power"),
    "power_spectrum_chirp": _rounded(lambda s, d: o.power_spectrum(hours(s, d).where("pos < 701"), 701, 1.0, MOST).drop("frequency"), "power"),
    "multitaper": _rounded(lambda s, d: o.multitaper(hours(s, d), N, 3.0, 1.0, MOST), "power", "dof", "p"),
    "gaussian_lowpass": _rounded(lambda s, d: o.gaussian_lowpass(hours(s, d), N, 6.0, MOST), "v", digits=3),
    "gaussian_filter": _rounded(lambda s, d: o.gaussian_bandpass(hours(s, d), N, 24.0, None, MOST), "v", digits=3),
    "bandpass_filter": _rounded(lambda s, d: o.bandpass(hours(s, d), N, 18.0, 36.0, MOST), "v", digits=3),
    "taner_filter": _rounded(lambda s, d: o.taner_filter(hours(s, d), N, 24.0, MOST), "v", digits=3),
    "wavelet": _rounded(lambda s, d: o.wavelet(hours(s, d), N, list(range(2, 13)), "morlet", MOST).drop("frequency"), "power", digits=2),
    "wavelet_mexican_hat": _rounded(lambda s, d: o.wavelet(hours(s, d), N, list(range(2, 13)), "mexican_hat", MOST).drop("frequency"), "power", digits=2),
    "evolutionary_spectrum": _rounded(lambda s, d: o.evolutionary(hours(s, d), N, 180, 0.5, 60), "power", digits=2),
    "evolutionary_multitaper": _rounded(lambda s, d: o.evolutionary(hours(s, d), N, 180, 0.5, 60, "mtm"), "power"),
    "redfit": _rounded(lambda s, d: o.redfit(hours(s, d, "event_type"), N, simulations=0, most=MOST).drop("frequency", "p", "peak"), "phi", "raw", "score", "power", "red", "noise_sd", "dof"),
    "redfit_peaks": _rounded(lambda s, d: o.redfit(hours(s, d, "event_type"), N, most=MOST).where("peak").select("series", "k", "frequency", "score", "p"), "frequency", "score", "p"),
    "coherence": _rounded(lambda s, d: o.coherence(_kind(s, d, "click"), _kind(s, d, "view"), N, 6).select("k", "coherence"), "coherence"),
}

_H = "WITH h AS (SELECT CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS BIGINT) AS pos, sum(value) AS v FROM events GROUP BY 1), g AS (SELECT g.t AS pos, coalesce(v, 0) AS v FROM range({n}) g(t) LEFT JOIN h ON h.pos = g.t), z AS (SELECT pos, v, v - avg(v) OVER () AS z, var_pop(v) OVER () AS s FROM g)"
_SPECTRUM = _H + " SELECT 'all' AS series, k, round((sum(z * cos(2 * pi() * ((k * pos) % {n}) / {n})) ** 2 + sum(z * sin(2 * pi() * ((k * pos) % {n}) / {n})) ** 2) / ({n} * any_value(s)), 5) AS power FROM z, range(1, {n} // 2 + 1) f(k) GROUP BY k"
#: A filter is a convolution around the circle with the transform of its response.
_FILTER = _H + ", w AS (SELECT f.d, sum(({r}) * cos(2 * pi() * ((k.k * f.d) % 720) / 720)) / 720 AS w FROM range(720) f(d), (SELECT k, least(k, 720 - k) / 720 AS f FROM range(720) k(k)) k GROUP BY f.d) SELECT 'all' AS series, a.pos, round(sum(w.w * b.{v}), 3) AS v FROM z a, z b, w WHERE w.d = (a.pos - b.pos + 720) % 720 GROUP BY a.pos"
_WAVE = _H + """, e AS (SELECT s, t, {re} AS re, {im} AS im FROM (SELECT s.s, t.t, t.t / s.s AS e FROM range(2, 13) s(s), range(-60, 61) t(t) WHERE abs(t.t) <= 5 * s.s)),
u AS (SELECT s, t, re / n AS re, im / n AS im FROM (SELECT *, sqrt(sum(re * re + im * im) OVER (PARTITION BY s)) AS n FROM e))
SELECT 'all' AS series, CAST(s AS INTEGER) AS scale, g.pos, round(sum(u.re * o.v) ** 2 + sum(u.im * o.v) ** 2, 2) AS power, least(g.pos, 719 - g.pos) >= sqrt(2) * s AS reliable FROM g JOIN u ON true JOIN g o ON o.pos = g.pos + u.t GROUP BY s, g.pos"""
#: The grid has five points a resolution element, 1,800; windows are at most a quarter of it.
_REDFIT = """WITH h AS (SELECT event_type AS series, CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS BIGINT) AS pos, sum(value) AS v FROM events GROUP BY 1, 2), g AS (SELECT n.series, g.t AS pos, coalesce(v, 0) AS v FROM (SELECT DISTINCT series FROM h) n CROSS JOIN range(720) g(t) LEFT JOIN h ON h.series = n.series AND h.pos = g.t),
l AS (SELECT series, regr_slope(v, pos) AS b, regr_intercept(v, pos) AS a FROM g GROUP BY 1), z AS (SELECT series, pos, v - a - b * pos AS z FROM g JOIN l USING (series)), s AS (SELECT series, sum(z * z) AS q FROM z GROUP BY 1),
a AS (SELECT x.series, greatest(-0.99, least(0.99, sum(x.z * y.z) / sum(y.z * y.z))) AS phi FROM z x JOIN z y ON y.series = x.series AND y.pos = x.pos + 1 GROUP BY 1),
p AS (SELECT series, k, (sum(z * cos(2 * pi() * ((k * pos) % 720) / 720)) ** 2 + sum(z * sin(2 * pi() * ((k * pos) % 720) / 720)) ** 2) / any_value(q) AS p FROM z JOIN s USING (series), range(1, 361) f(k) GROUP BY series, k),
m AS (SELECT m, 1 + m * 359 / 1799 AS x, least(floor(1 + m * 359 / 1799), 359) AS lo FROM range(1800) g(m)), r AS (SELECT m, 2 * floor(greatest(5, least(450, round(1.2 * x / (359 / 1799)))) / 2) + 1 AS w FROM m),
f AS (SELECT a.series, m.m, (1 - (x - lo)) * b.p + (x - lo) * c.p AS p, (1 - phi ** 2) / (1 - 2 * phi * cos(2 * pi() * x / 720) + phi ** 2) AS red, (1 - phi ** 4) / (720 ** 2 * (1 - 2 * phi ** 2 * cos(4 * pi() * x / 720) + phi ** 4)) AS spread, phi FROM m CROSS JOIN a JOIN p b ON b.series = a.series AND b.k = lo JOIN p c ON c.series = a.series AND c.k = lo + 1),
t AS (SELECT r.m, o.m AS o, r.w, (1 - ((o.m - r.m) / (r.w / 2)) ** 2) ** 3 AS t FROM r JOIN m o ON abs(o.m - r.m) < r.w / 2)
SELECT f.series, CAST(t.m AS INTEGER) AS k, round(any_value(f.phi), 5) AS phi, round(any_value((f.p - f.red) / sqrt(f.red)) FILTER (t.o = t.m), 5) AS raw, round(sum(t * (f.p - f.red) / sqrt(f.red)) / sum(t), 5) AS score, round(sum(t * f.p) / sum(t), 5) AS power, round(sum(t * f.red) / sum(t), 5) AS red,
 round(sqrt(sum(t * t * spread) / sum(t * t)) * sum(t), 5) AS noise_sd, CAST(any_value(w) AS INTEGER) AS width, round(sum(t) ** 2 / sum(t * t), 5) AS dof FROM t JOIN f ON f.m = t.o GROUP BY f.series, t.m"""

ORACLE_SQL = {
    "redfit": _REDFIT,
    "power_spectrum": _SPECTRUM.format(n=720),
    "power_spectrum_chirp": _SPECTRUM.format(n=701),
    "gaussian_lowpass": _FILTER.format(n=720, r="exp(-2 * pi() ** 2 * 36 * f * f)", v="v"),
    "gaussian_filter": _FILTER.format(n=720, r="exp(-2 * pi() ** 2 * (24 / (2 * pi())) ** 2 * (f - 1 / 24) ** 2)", v="z"),
    "bandpass_filter": _FILTER.format(n=720, r="exp(-ln(sqrt(2)) * ((f - (1 / 36 + 1 / 18) / 2) / ((1 / 18 - 1 / 36) / 2)) ** 2)", v="z"),
    "taner_filter": _H.format(n=720) + """, w AS (SELECT l, (CASE WHEN l = 0 THEN 2 * (2 / 24 - 1 / 48) ELSE (sin(2 * pi() * 2 / 24 * l) - sin(2 * pi() / 48 * l)) / (pi() * l) END) * (0.35875 - 0.48829 * cos(2 * pi() * (l + 192) / 384) + 0.14128 * cos(4 * pi() * (l + 192) / 384) - 0.01168 * cos(6 * pi() * (l + 192) / 384)) AS w FROM range(-192, 193) g(l))
SELECT 'all' AS series, a.pos, round(sum(w * b.v), 3) AS v FROM g a JOIN w ON true JOIN g b ON b.pos = CASE WHEN a.pos - l < 0 THEN l - a.pos WHEN a.pos - l > 719 THEN 1438 - a.pos + l ELSE a.pos - l END GROUP BY a.pos""",
    "wavelet": _WAVE.format(n=720, re="exp(-e * e / 2) * cos(6 * e)", im="exp(-e * e / 2) * sin(6 * e)"),
    "wavelet_mexican_hat": _WAVE.format(n=720, re="exp(-e * e / 2) * (1 - e * e)", im="0"),
    "evolutionary_spectrum": _H.format(n=720) + """ SELECT 'all' AS series, start, k / 720 AS frequency, round(2 * (sum(v * cos(2 * pi() * k * (pos - start) / 720)) ** 2 + sum(v * sin(2 * pi() * k * (pos - start) / 720)) ** 2) / 32400, 2) AS power
FROM g JOIN (SELECT 90 * s AS start FROM range(7) q(s)) ON pos >= start AND pos < start + 180 JOIN range(4, 64) f(k) ON true GROUP BY start, k""",
    "coherence": """WITH h AS (SELECT event_type AS e, CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000) AS BIGINT) AS pos, sum(value) AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2), b AS (SELECT a.pos, a.v AS a, b.v AS b FROM h a JOIN h b ON a.pos = b.pos AND a.e = 'click' AND b.e = 'view'),
g AS (SELECT g.t // 120 AS seg, g.t % 120 AS t, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM range(720) g(t) LEFT JOIN b ON b.pos = g.t WHERE g.t // 120 IN (SELECT pos // 120 FROM b)), z AS (SELECT seg, t, a - avg(a) OVER (PARTITION BY seg) AS a, b - avg(b) OVER (PARTITION BY seg) AS b FROM g),
f AS (SELECT seg, k, sum(a * cos(2 * pi() * k * t / 120)) AS ar, -sum(a * sin(2 * pi() * k * t / 120)) AS ai, sum(b * cos(2 * pi() * k * t / 120)) AS br, -sum(b * sin(2 * pi() * k * t / 120)) AS bi FROM z, range(1, 61) q(k) GROUP BY seg, k)
SELECT k, round((sum(ar * br + ai * bi) ** 2 + sum(ar * bi - ai * br) ** 2) / (sum(ar * ar + ai * ai) * sum(br * br + bi * bi)), 5) AS coherence FROM f GROUP BY k""",
}
