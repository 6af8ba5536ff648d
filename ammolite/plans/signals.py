"""More series queries, over the hourly means of events by type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammolite.operators import series as o
from ammolite.operators import signals as g
from ammolite.plans.series import _H, FREQUENCIES, ORACLE_SQL as _SERIES
from ammolite.plans.series import hourly as H

TEMPLATE = [0.0, 1.0, 3.0, 1.0, 0.0]
POWERS = [k / 10 for k in range(-20, 21)]
SHARES = [0.001, 0.1, 0.5, 0.9, 0.999]


def _events(s, d):
    return s.read.parquet(f"{d}/events.parquet")


def _spectrum(s, d):
    return o.lomb_scargle(H(s, d), FREQUENCIES)


def _shifted(s, d):
    """The series again, an hour and a half later for every second type and an hour later for the others."""
    return H(s, d).select("series", (F.col("t") + F.when(F.col("series") < "m", 1.0).otherwise(1.5)).alias("t"), (F.col("v") + 1).alias("v"))


QUERIES = {
    "spectral_peaks": lambda s, d: g.spectral_peaks(_spectrum(s, d)),
    "spectral_moments": lambda s, d: g.spectral_moments(_spectrum(s, d)),
    "estimate_ar1_rho": lambda s, d: g.ar1_rho(H(s, d)),
    "ar1_spectrum": lambda s, d: g.ar1_spectrum(g.ar1_rho(H(s, d)), FREQUENCIES, 1.0),
    "prewhiten": lambda s, d: g.prewhiten(H(s, d)),
    "autoassociation": lambda s, d: g.autoassociation(H(s, d), 2.0, 48.0),
    "moving_average_smooth": lambda s, d: g.moving_average(H(s, d), 6),
    "moving_average_trailing": lambda s, d: g.moving_average(H(s, d), 5, "trailing"),
    "fixed_bandwidth_moving_average": lambda s, d: g.bandwidth_average(H(s, d), 9.0),
    "find_n_peaks": lambda s, d: g.find_n_peaks(H(s, d), 10),
    "remove_peaks": lambda s, d: g.remove_peaks(H(s, d), 60.0),
    "matched_filter": lambda s, d: g.matched_filter(H(s, d), TEMPLATE),
    "pad_zero": lambda s, d: g.pad_series(H(s, d), 10),
    "pad_mirror": lambda s, d: g.pad_series(H(s, d), 10, "mirror"),
    "pad_periodic": lambda s, d: g.pad_series(H(s, d), 10, "periodic"),
    "cosine_taper": lambda s, d: g.cosine_taper(H(s, d)),
    "domain_transform_cumulative": lambda s, d: g.cumulative(H(s, d), 0.5),
    "robust_linear_fit": lambda s, d: g.robust_line(H(s, d)),
    "polynomial_trend": lambda s, d: g.polynomial_trend(H(s, d)),
    "inverse_percentile": lambda s, d: g.inverse_percentile(_events(s, d), "event_type", "value", SHARES),
    "non_exceedance_probability": lambda s, d: g.non_exceedance(_events(s, d), "event_type", "value", 50.0, "weibull"),
    "box_cox_power": lambda s, d: g.box_cox_power(_events(s, d), "event_type", "value", POWERS),
    "box_cox_transform": lambda s, d: H(s, d).select("series", "t", F.round(g.box_cox(F.col("v"), 0.5), 6).alias("v"), F.round(g.box_cox_inverse(g.box_cox(F.col("v"), 0.5), 0.5), 6).alias("back")),
    "test_uniform_sampling": lambda s, d: g.uniform_sampling(H(s, d)),
    "apply_square": lambda s, d: g.apply_function(H(s, d), "square"),
    "apply_sqrt": lambda s, d: g.apply_function(H(s, d), "sqrt"),
    "merge_series": lambda s, d: g.merge_series(H(s, d), _shifted(s, d)),
    "merge_series_mean": lambda s, d: g.merge_series(H(s, d), _shifted(s, d), "mean"),
    "remove_outliers_iqr": lambda s, d: g.remove_outliers(H(s, d)),
    "remove_outliers_zscore": lambda s, d: g.remove_outliers(H(s, d), "zscore", 2.0),
    "lb_keogh": lambda s, d: g.lb_keogh(H(s, d), "click", "view", 2),
    "pyper_peterman_correction": lambda s, d: g.effective_correlation(H(s, d), "click", "view", 24),
}

_N = _H + ", n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) AS i FROM h)"
_LS = "WITH ls AS (" + _SERIES["lomb_scargle"] + ")"
_RHO = _H + ", z AS (SELECT series, t, v, v - avg(v) OVER (PARTITION BY series) AS z FROM h), y AS (SELECT *, lag(z) OVER (PARTITION BY series ORDER BY t) AS z0, lag(v) OVER (PARTITION BY series ORDER BY t) AS v0 FROM z), r AS (SELECT series, count(*) + 1 AS n, sum(z * z0) / sum(z0 * z0) AS rho FROM y WHERE z0 IS NOT NULL GROUP BY 1)"
_PADS = _N + ", s AS (SELECT series, i - 1 AS i, v FROM n), c AS (SELECT series, count(*) AS n FROM s GROUP BY 1) SELECT series, i, round(v, 6) AS v FROM s UNION ALL "
_POS = "SELECT event_type AS grp, value AS v, (row_number() OVER (PARTITION BY event_type ORDER BY value) - {a}) / (count(*) OVER (PARTITION BY event_type) + {b}) AS p FROM (SELECT DISTINCT event_type, value FROM events WHERE value IS NOT NULL)"
_FIT = "SELECT series, count(*) AS n, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM {x} GROUP BY 1"
_KEEP = "SELECT h.* FROM h JOIN {l} l USING (series) JOIN (SELECT e.series, 1.4826 * median(abs(e.e - m.m)) AS s FROM (SELECT h.series, v - a - b * t AS e FROM h JOIN {l} USING (series)) e JOIN (SELECT h.series, median(v - a - b * t) AS m FROM h JOIN {l} USING (series) GROUP BY 1) m USING (series) GROUP BY 1) q USING (series) WHERE abs(v - a - b * t) <= 3 * s"
_WE = ", m AS (SELECT *, t + CASE WHEN series < 'm' THEN 1.0 ELSE 1.5 END AS t2 FROM h), u AS (SELECT series, t, v, 0 AS src FROM h UNION ALL SELECT series, t2, v + 1, 1 FROM m)"

ORACLE_SQL = {
    "spectral_peaks": _LS + """, x AS (SELECT *, max(power) OVER (PARTITION BY series) AS top, row_number() OVER (PARTITION BY series ORDER BY f) AS i FROM ls),
y AS (SELECT *, i - row_number() OVER (PARTITION BY series ORDER BY f) AS run FROM x WHERE power > 0.5 * top), z AS (SELECT *, row_number() OVER (PARTITION BY series, run ORDER BY power DESC, f) AS k FROM y)
SELECT series, f, round(1 / f, 6) AS period, power, round(power / top, 6) AS relative_power FROM z WHERE k = 1""",
    "spectral_moments": _LS + """, x AS (SELECT series, f, power AS p, lead(f) OVER w AS g, lead(power) OVER w AS q FROM ls WINDOW w AS (PARTITION BY series ORDER BY f)),
m AS (SELECT series, sum((p + q) / 2 * (g - f)) AS m0, sum((f * p + g * q) / 2 * (g - f)) AS m1, sum((f * f * p + g * g * q) / 2 * (g - f)) AS m2 FROM x GROUP BY 1),
z AS (SELECT series, m0, m1, m2, m1 / m0 AS c, sum(((f - m1 / m0) ** 2 * p + (g - m1 / m0) ** 2 * q) / 2 * (g - f)) AS z2, sum(((f - m1 / m0) ** 3 * p + (g - m1 / m0) ** 3 * q) / 2 * (g - f)) AS z3, sum(((f - m1 / m0) ** 4 * p + (g - m1 / m0) ** 4 * q) / 2 * (g - f)) AS z4 FROM x JOIN m USING (series) GROUP BY ALL)
SELECT series, round(m0, 6) AS m0, round(m1, 6) AS m1, round(m2, 6) AS m2, round(c, 6) AS centroid, round(sqrt(z2 / m0), 6) AS bandwidth, round(z3 / m0 / sqrt(z2 / m0) ** 3, 4) AS skewness, round(z4 / m0 / (z2 / m0) ** 2 - 3, 4) AS kurtosis FROM z""",
    "estimate_ar1_rho": _RHO + " SELECT series, n, round(rho, 6) AS rho FROM r",
    "ar1_spectrum": _RHO + ", q AS (SELECT series, round(rho, 6) AS rho FROM r) SELECT series, k / 100 AS f, round((1 - rho * rho) / (1 - 2 * rho * cos(2 * pi() * (k / 100)) + rho * rho), 6) AS power FROM q, range(1, 21) g(k)",
    "prewhiten": _RHO + """, q AS (SELECT y.series, rho AS phi, count(*) AS n, var_pop(z - rho * z0) AS va, var_pop(v - v0) AS vd FROM y JOIN r USING (series) WHERE z0 IS NOT NULL GROUP BY ALL)
SELECT series, n, round(phi, 6) AS phi, round(n * ln(va) + 2, 4) AS aic_ar1, round(n * ln(vd) + 2, 4) AS aic_difference, CASE WHEN n * ln(va) <= n * ln(vd) THEN 'ar1' ELSE 'difference' END AS chosen FROM q""",
    "autoassociation": _H + """, z AS (SELECT series, t, (v - avg(v) OVER (PARTITION BY series)) / stddev_pop(v) OVER (PARTITION BY series) AS z FROM h)
SELECT a.series, CAST(floor((b.t - a.t) / 2 + 1e-6) AS BIGINT) AS bin, count(*) AS pairs, round(avg(a.z * b.z), 6) AS association, round(corr(a.z, b.z), 6) AS r FROM z a JOIN z b ON a.series = b.series AND b.t > a.t AND b.t - a.t <= 48 GROUP BY 1, 2""",
    "moving_average_smooth": _H + " SELECT series, t, round(avg(v) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS v FROM h",
    "moving_average_trailing": _H + " SELECT series, t, round(avg(v) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS v FROM h",
    "fixed_bandwidth_moving_average": _H + " SELECT series, t, round(avg(v) OVER (PARTITION BY series ORDER BY t RANGE BETWEEN 4.5 PRECEDING AND 4.5 FOLLOWING) + 1e-9, 6) AS v FROM h",
    "find_n_peaks": _H + """, l AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM h WINDOW w AS (PARTITION BY series ORDER BY t)), p AS (SELECT series, t, v, CAST(row_number() OVER (PARTITION BY series ORDER BY v DESC, t) AS INTEGER) AS place FROM l WHERE v > a AND v > b)
SELECT series, t, round(v, 6) AS v, place FROM p WHERE place <= 10""",
    "remove_peaks": _H + """, l AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM h WINDOW w AS (PARTITION BY series ORDER BY t)), p AS (SELECT series, t, CASE WHEN NOT coalesce(v > 60 AND v > a AND v > b, false) THEN v END AS v FROM l),
q AS (SELECT *, last_value(v IGNORE NULLS) OVER x AS v0, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER x AS t0, first_value(v IGNORE NULLS) OVER y AS v1, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER y AS t1 FROM p
 WINDOW x AS (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), y AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT series, t, round(coalesce(v, v0 + (t - t0) / (t1 - t0) * (v1 - v0)), 6) AS v FROM q""",
    "matched_filter": _N + """, w AS (SELECT unnest([0, 1, 2, 3, 4]) AS j, unnest([0.0, 1.0, 3.0, 1.0, 0.0]) AS w), c AS (SELECT a.series, a.t, count(*) AS n, corr(b.v, w) AS r FROM n a JOIN w ON true JOIN n b ON b.series = a.series AND b.i = a.i + j GROUP BY a.series, a.t)
SELECT series, t, CASE WHEN NOT isnan(r) THEN round(r, 6) END AS r FROM c WHERE n = 5""",
    "pad_zero": _PADS + "SELECT series, n + k, 0.0 FROM c, range(10) g(k)",
    "pad_mirror": _PADS + "SELECT c.series, c.n + k, round(s.v, 6) FROM c, range(10) g(k), s WHERE s.series = c.series AND s.i = c.n - 1 - k",
    "pad_periodic": _PADS + "SELECT c.series, c.n + k, round(s.v, 6) FROM c, range(10) g(k), s WHERE s.series = c.series AND s.i = k % c.n",
    "cosine_taper": _N + """, u AS (SELECT series, t, v, (i - 1) / (count(*) OVER (PARTITION BY series) - 1) AS u FROM n), w AS (SELECT *, CASE WHEN least(u, 1 - u) < 0.05 THEN 0.5 - 0.5 * cos(pi() * least(u, 1 - u) / 0.05) ELSE 1 END AS w FROM u)
SELECT series, t, round(w, 6) AS weight, round(w * v, 6) AS v FROM w""",
    "domain_transform_cumulative": _H + " SELECT series, t, round(sum(v * 0.5) OVER (PARTITION BY series ORDER BY t) + 1e-9, 5) AS v FROM h",
    "robust_linear_fit": _H + ", l0 AS (" + _FIT.format(x="h") + "), k1 AS (" + _KEEP.format(l="l0") + "), l1 AS (" + _FIT.format(x="k1") + "), k2 AS (" + _KEEP.format(l="l1") + "), l2 AS (" + _FIT.format(x="k2") + "), k3 AS (" + _KEEP.format(l="l2") + "), l3 AS (" + _FIT.format(x="k3") + ") SELECT series, n AS inliers, round(b, 8) AS slope, round(a, 6) AS intercept FROM l3",
    "polynomial_trend": _H + """, u AS (SELECT series, v, (t - avg(t) OVER (PARTITION BY series)) / stddev_pop(t) OVER (PARTITION BY series) AS u FROM h),
s AS (SELECT series, count(*) AS n, avg(v) AS y, avg(u * v) AS uy, avg(u * u * v) AS uuy, avg(u ** 3) AS k3, avg(u ** 4) AS k4 FROM u GROUP BY 1), c AS (SELECT *, (uuy - y - k3 * uy) / (k4 - 1 - k3 * k3) AS c2 FROM s)
SELECT series, n, round(y - c2, 6) AS c0, round(uy - k3 * c2, 6) AS c1, round(c2, 6) AS c2 FROM c""",
    "inverse_percentile": "WITH x AS (" + _POS.format(a="0.5", b="0") + """), q AS (SELECT unnest([0.001, 0.1, 0.5, 0.9, 0.999]) AS q),
s AS (SELECT grp, q, max(p) FILTER (p <= q) AS pa, max(v) FILTER (p <= q) AS va, min(p) FILTER (p >= q) AS pb, min(v) FILTER (p >= q) AS vb FROM x, q GROUP BY ALL)
SELECT grp, CAST(q AS DOUBLE) AS probability, round(CASE WHEN pa IS NULL THEN vb WHEN pb IS NULL THEN va ELSE coalesce(va + (q - pa) / nullif(pb - pa, 0) * (vb - va), va) END, 6) AS value FROM s""",
    "non_exceedance_probability": "WITH x AS (" + _POS.format(a="0", b="1") + ") SELECT grp, round(coalesce(max(p) FILTER (v <= 50), 0), 6) AS probability FROM x GROUP BY grp",
    "box_cox_power": """
WITH b AS (SELECT event_type AS grp, value AS v, k / 10 AS p FROM events, range(-20, 21) g(k) WHERE value > 0), l AS (SELECT grp, p, count(*) AS n, -count(*) / 2 * ln(var_pop(CASE WHEN p = 0 THEN ln(v) ELSE (power(v, p) - 1) / p END)) + (p - 1) * sum(ln(v)) AS l FROM b GROUP BY grp, p)
SELECT grp, n, p AS power, round(l, 3) AS likelihood FROM l QUALIFY row_number() OVER (PARTITION BY grp ORDER BY l DESC, p) = 1""",
    "box_cox_transform": _H + " SELECT series, t, round((sqrt(v) - 1) / 0.5, 6) AS v, round(v, 6) AS back FROM h",
    "test_uniform_sampling": _H + """, g AS (SELECT *, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS gap FROM h), m AS (SELECT series, median(gap) AS m, count(*) AS n, min(t) AS lo, max(t) AS hi, greatest(1, count(*) // 5) AS k FROM g GROUP BY 1),
d AS (SELECT series, max(abs(gap / m - 1)) AS dev FROM g JOIN m USING (series) GROUP BY 1), c AS (SELECT series, n, k, least(k - 1, floor((t - lo) / ((hi - lo) / k))) AS b, count(*) AS o FROM h JOIN m USING (series) GROUP BY ALL),
r AS (SELECT series, n, k, sum(o * o) * k / n - n AS x FROM c GROUP BY series, n, k),
-- tail of chi-square with k - 1 degrees of freedom by Simpson's rule over the body of the density
p AS (SELECT r.*, k - 1 AS df, 1 - (SELECT sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * CASE WHEN i = 0 THEN 0 ELSE exp((r.k - 3) / 2 * ln(i * r.x / 4000) - i * r.x / 8000 - (r.k - 1) / 2 * ln(2) - lgamma((r.k - 1) / 2)) END) * (r.x / 4000) / 3 FROM range(4001) t(i)) AS p FROM r)
SELECT series, n, k AS bins, round(dev, 6) AS deviation, round(x, 5) AS chi2, round(p, 6) AS p, dev <= 1e-5 AND p >= 0.05 AS uniform FROM p JOIN d USING (series)""",
    "apply_square": _H + " SELECT series, t, round(v * v, 6) AS v FROM h",
    "apply_sqrt": _H + " SELECT series, t, CASE WHEN v >= 0 THEN round(sqrt(v), 6) END AS v FROM h",
    "merge_series": _H + _WE + " SELECT series, t, round(arg_min(v, src), 6) AS v, count(*) AS sources FROM u GROUP BY ALL",
    "merge_series_mean": _H + _WE + " SELECT series, t, round(avg(v), 6) AS v, count(*) AS sources FROM u GROUP BY ALL",
    "remove_outliers_iqr": _H + ", q AS (SELECT series, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.75) AS b FROM h GROUP BY 1) SELECT series, t, round(v, 6) AS v FROM h JOIN q USING (series) WHERE v BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)",
    "remove_outliers_zscore": _H + " SELECT series, t, round(v, 6) AS v FROM h QUALIFY abs((v - avg(v) OVER (PARTITION BY series)) / stddev_pop(v) OVER (PARTITION BY series)) < 2",
    "lb_keogh": _N + """, r AS (SELECT i, max(v) OVER w AS hi, min(v) OVER w AS lo FROM n WHERE series = 'view' WINDOW w AS (ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT count(*) AS n, round(sqrt(sum(CASE WHEN v > hi THEN (v - hi) ** 2 WHEN v < lo THEN (v - lo) ** 2 ELSE 0 END)), 5) AS bound FROM n JOIN r USING (i) WHERE series = 'click'""",
    "pyper_peterman_correction": _H + """, s AS (SELECT a.t, a.v AS a, b.v AS b FROM h a JOIN h b ON a.t = b.t WHERE a.series = 'click' AND b.series = 'view'), d AS (SELECT row_number() OVER (ORDER BY t) AS i, a - avg(a) OVER () AS a, b - avg(b) OVER () AS b FROM s),
w AS (SELECT count(*) AS n, corr(a, b) AS r, sum(a * a) AS aa, sum(b * b) AS bb FROM d), p AS (SELECT k, sum(x.a * y.a) AS pa, sum(x.b * y.b) AS pb FROM range(1, 25) g(k), d x JOIN d y ON y.i = x.i + k GROUP BY k),
q AS (SELECT n, r, sum(pa / aa * pb / bb) AS s FROM p, w GROUP BY n, r), m AS (SELECT *, least(n, greatest(2, n * (1 - s) / (1 + s))) AS m FROM q) SELECT n, round(r, 6) AS r, round(m, 4) AS n_effective, round(r * sqrt((m - 2) / (1 - r * r)), 6) AS t FROM m""",
}
