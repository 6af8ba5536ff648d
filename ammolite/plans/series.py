"""Time-series queries: hourly means of events by type, and daily order totals by priority."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammolite.operators import series as o

_HOUR = "CAST(floor((unix_micros(ts) - 1704067200000000) / 3600000000) AS BIGINT)"


def hourly(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.col("ts").cast("timestamp")
    return o.series(e.groupBy("event_type", F.floor((F.unix_micros(ts) - 1704067200000000) / 3600000000).alias("h")).agg(F.avg("value").alias("m")), "event_type", "h", "m")


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _grid(spark, sf_dir):
    return hourly(spark, sf_dir).select("series").distinct().select("series", F.explode(F.sequence(F.lit(0), F.lit(719), F.lit(7))).alias("i")).select("series", (F.col("i") + 0.25).alias("t"))


def _intervals(spark):
    return spark.createDataFrame([(10.0, 40.0), (30.0, 60.0), (700.0, 800.0)], "lo double, hi double")


FREQUENCIES = [k / 100 for k in range(1, 21)]
H = hourly
QUERIES = {
    "acf": lambda s, d: o.autocorrelation(H(s, d), 24),
    "cross_correlation": lambda s, d: o.cross_correlation(H(s, d), "click", "view", 12),
    "lead_lag_rmse": lambda s, d: o.lead_lag_rmse(H(s, d), "click", "view", 12),
    "derivative": lambda s, d: o.derivative(H(s, d)),
    "fixed_count_summary": lambda s, d: o.fixed_count_summary(H(s, d), 5),
    "moving_median_even": lambda s, d: o.fixed_count_summary(H(s, d), 6).select("series", "t", "n", "median"),
    "fixed_bandwidth_summary": lambda s, d: o.fixed_bandwidth_summary(H(s, d), 7.0),
    "mann_kendall": lambda s, d: o.mann_kendall(H(s, d)),
    "runs_test": lambda s, d: o.runs_test(H(s, d)),
    "interpolate_series": lambda s, d: o.interpolate_linear(H(s, d), _grid(s, d)),
    "select_intervals": lambda s, d: o.select_intervals(H(s, d), _intervals(s)),
    "add_gaps": lambda s, d: o.add_gaps(H(s, d), 100.0, 200.0),
    "remove_part": lambda s, d: o.remove_part(H(s, d), 100.0, 200.0),
    "remove_range": lambda s, d: o.remove_range(H(s, d), 100.0, 200.0),
    "clip_values": lambda s, d: o.clip_values(H(s, d), 20.0, 60.0),
    "sort_unique": lambda s, d: o.sort_unique(_events(s, d), "user_id"),
    "standardize_zscore": lambda s, d: o.standardize(H(s, d)),
    "standardize_minmax": lambda s, d: o.standardize(H(s, d), "minmax"),
    "log_transform": lambda s, d: o.log_transform(H(s, d)),
    "detrend_linear": lambda s, d: o.detrend_linear(H(s, d)),
    "local_peaks": lambda s, d: o.local_peaks(H(s, d), 60.0),
    "excursions": lambda s, d: o.excursions(H(s, d), 1.5),
    "lomb_scargle": lambda s, d: o.lomb_scargle(H(s, d), FREQUENCIES),
    "circular_spectrum": lambda s, d: o.circular_spectrum(_events(s, d), "event_type", F.hour("ts") * 15.0, 6),
    "markov": lambda s, d: o.markov_chi_square(_events(s, d), "user_id", ["ts", "event_id"], "event_type"),
    "spearman": lambda s, d: o.spearman(s.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", "l_discount"),
}

_H = "WITH h AS (SELECT event_type AS series, CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000000.0) AS DOUBLE) AS t, avg(value) AS v FROM events GROUP BY 1, 2)"
_PLAIN = "SELECT series, t, {v} AS v FROM h{where}"
ORACLE_SQL = {
    "acf": _H + """, d AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) AS i, v - avg(v) OVER (PARTITION BY series) AS z FROM h), s AS (SELECT series, count(*) AS n, sum(z * z) AS s FROM d GROUP BY 1)
SELECT a.series, CAST(k AS INTEGER) AS lag, round(sum(a.z * b.z) / any_value(s.s), 6) AS r, round(1.96 / sqrt(any_value(s.n)), 6) AS band FROM range(0, 25) g(k), d a JOIN d b ON a.series = b.series AND b.i = a.i + k JOIN s ON s.series = a.series GROUP BY a.series, k""",
    "cross_correlation": _H + """ SELECT CAST(k AS INTEGER) AS lag, count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM range(-12, 13) g(k), h a JOIN h b ON b.t = a.t + k WHERE a.series = 'click' AND b.series = 'view' GROUP BY k""",
    "lead_lag_rmse": _H + """, z AS (SELECT series, t, (v - avg(v) OVER (PARTITION BY series)) / stddev_samp(v) OVER (PARTITION BY series) AS v FROM h)
SELECT CAST(k AS INTEGER) AS lag, count(*) AS n, round(sqrt(avg((a.v - b.v) ** 2)), 6) AS rmse FROM range(-12, 13) g(k), z a JOIN z b ON b.t = a.t + k WHERE a.series = 'click' AND b.series = 'view' GROUP BY k HAVING count(*) >= 3""",
    "derivative": _H + """, l AS (SELECT *, t - lag(t) OVER w AS a, lag(v) OVER w AS v0, lead(t) OVER w - t AS b, lead(v) OVER w AS v1 FROM h WINDOW w AS (PARTITION BY series ORDER BY t))
SELECT series, t, round(CASE WHEN a IS NULL THEN (v1 - v) / b WHEN b IS NULL THEN (v - v0) / a ELSE (a * a * v1 + (b * b - a * a) * v - b * b * v0) / (a * b * (a + b)) END, 6) AS dv FROM l""",
    "fixed_count_summary": _H + """ SELECT series, t, count(v) OVER w AS n, round(avg(v) OVER w, 6) AS mean, round(coalesce(stddev_samp(v) OVER w, 0), 6) AS sd, round(min(v) OVER w, 6) AS minimum, round(max(v) OVER w, 6) AS maximum, round(quantile_cont(v, 0.5) OVER w, 6) AS median
FROM h WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "moving_median_even": _H + " SELECT series, t, count(v) OVER w AS n, round(quantile_cont(v, 0.5) OVER w, 6) AS median FROM h WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 2 PRECEDING AND 3 FOLLOWING)",
    "fixed_bandwidth_summary": _H + """ SELECT series, t, count(v) OVER w AS n, round(avg(v) OVER w, 6) AS mean, round(coalesce(stddev_samp(v) OVER w, 0), 6) AS sd, round(min(v) OVER w, 6) AS minimum, round(max(v) OVER w, 6) AS maximum, round(coalesce(stddev_samp(v) OVER w, 0) / sqrt(count(v) OVER w), 6) AS se
FROM h WINDOW w AS (PARTITION BY series ORDER BY t RANGE BETWEEN 3.5 PRECEDING AND 3.5 FOLLOWING)""",
    "mann_kendall": _H + """, p AS (SELECT a.series, CAST(sum(sign(b.v - a.v)) AS BIGINT) AS s, quantile_cont((b.v - a.v) / (b.t - a.t), 0.5) AS slope FROM h a JOIN h b ON a.series = b.series AND a.t < b.t GROUP BY 1),
c AS (SELECT series, CAST(sum(c) AS BIGINT) AS n, sum(CAST(c AS DOUBLE) * (c - 1) * (2 * c + 5)) AS vt, sum(c * (c - 1) / 2) AS pt FROM (SELECT series, v, count(*) AS c FROM h GROUP BY ALL) GROUP BY 1),
x AS (SELECT *, CAST(n AS DOUBLE) * (n - 1) / 2 AS n0, (CAST(n AS DOUBLE) * (n - 1) * (2 * n + 5) - vt) / 18 AS var FROM p JOIN c USING (series))
SELECT series, n, s, round(s / sqrt(n0 * (n0 - pt)), 6) AS tau_b, round(var, 4) AS variance, round(CASE WHEN s = 0 THEN 0 ELSE (s - sign(s)) / sqrt(var) END, 6) AS z, round(slope, 8) AS sen_slope FROM x""",
    "runs_test": _H + """, m AS (SELECT series, quantile_cont(v, 0.5) AS m FROM h GROUP BY 1), s AS (SELECT series, t, CAST(v > m AS INTEGER) AS a FROM h JOIN m USING (series)),
r AS (SELECT series, a, CAST(a IS DISTINCT FROM lag(a) OVER (PARTITION BY series ORDER BY t) AS INTEGER) AS new FROM s), g AS (SELECT series, CAST(sum(new) AS BIGINT) AS runs, CAST(sum(a) AS BIGINT) AS n1, CAST(sum(1 - a) AS BIGINT) AS n2 FROM r GROUP BY 1)
SELECT *, round((runs - (2.0 * n1 * n2 / (n1 + n2) + 1)) / sqrt(2.0 * n1 * n2 * (2.0 * n1 * n2 - n1 - n2) / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2) * (n1 + n2 - 1))), 6) AS z FROM g""",
    "interpolate_series": _H + """, g AS (SELECT DISTINCT series, k + 0.25 AS t FROM h, range(0, 720, 7) r(k)),
x AS (SELECT g.series, g.t, (SELECT max(t) FROM h WHERE h.series = g.series AND h.t <= g.t) AS ta, (SELECT min(t) FROM h WHERE h.series = g.series AND h.t >= g.t) AS tb FROM g)
SELECT x.series, CAST(x.t AS DOUBLE) AS t, round(CASE WHEN ta = tb THEN a.v ELSE a.v + (x.t - ta) / (tb - ta) * (b.v - a.v) END, 6) AS v FROM x LEFT JOIN h a ON a.series = x.series AND a.t = ta LEFT JOIN h b ON b.series = x.series AND b.t = tb""",
    "select_intervals": _H + " SELECT series, t, round(v, 6) AS v, lo FROM h JOIN (VALUES (CAST(10 AS DOUBLE), 40), (30, 60), (700, 800)) i(lo, hi) ON t BETWEEN lo AND hi",
    "add_gaps": _H + " SELECT series, t, CASE WHEN NOT t BETWEEN 100 AND 200 THEN round(v, 6) END AS v FROM h",
    "remove_part": _H + " SELECT series, t, round(v, 6) AS v FROM h WHERE NOT t BETWEEN 100 AND 200",
    "remove_range": _H + " SELECT series, t, round(v, 6) AS v FROM h WHERE t BETWEEN 100 AND 200",
    "clip_values": _H + " SELECT series, t, round(least(greatest(v, 20), 60), 6) AS v FROM h",
    "sort_unique": "SELECT user_id AS value, count(*) - 1 AS removed FROM events WHERE user_id IS NOT NULL GROUP BY 1",
    "standardize_zscore": _H + " SELECT series, t, round((v - avg(v) OVER (PARTITION BY series)) / stddev_samp(v) OVER (PARTITION BY series), 6) AS v FROM h",
    "standardize_minmax": _H + " SELECT series, t, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS v FROM h WINDOW w AS (PARTITION BY series)",
    "log_transform": _H + " SELECT series, t, CASE WHEN v > 0 THEN round(ln(v) / ln(10), 6) END AS v FROM h",
    "detrend_linear": _H + ", f AS (SELECT series, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM h GROUP BY 1) SELECT series, t, round(v - a - b * t, 6) AS v FROM h JOIN f USING (series)",
    "local_peaks": _H + ", l AS (SELECT *, lag(v) OVER w AS v0, lead(v) OVER w AS v1 FROM h WINDOW w AS (PARTITION BY series ORDER BY t)) SELECT series, t, round(v, 6) AS v FROM l WHERE v > 60 AND v > v0 AND v > v1",
    "excursions": _H + """, z AS (SELECT series, t, row_number() OVER (PARTITION BY series ORDER BY t) AS i, (v - avg(v) OVER (PARTITION BY series)) / stddev_pop(v) OVER (PARTITION BY series) AS z FROM h),
s AS (SELECT *, CASE WHEN z > 1.5 THEN 1 ELSE -1 END AS side FROM z WHERE abs(z) > 1.5), k AS (SELECT *, i - row_number() OVER (PARTITION BY series, side ORDER BY t) AS k FROM s)
SELECT series, side, min(t) AS start, max(t) AS stop, count(*) AS n, round(max(abs(z)), 6) AS peak_z FROM k GROUP BY series, side, k""",
    "lomb_scargle": _H + """, s AS (SELECT series, t, v - avg(v) OVER (PARTITION BY series) AS z, var_pop(v) OVER (PARTITION BY series) AS var, k / 100 AS f, 2 * 3.141592653589793 * k / 100 AS w FROM h, range(1, 21) g(k)),
u AS (SELECT series, f, atan2(sum(sin(2 * w * t)), sum(cos(2 * w * t))) / (2 * any_value(w)) AS tau FROM s GROUP BY ALL), a AS (SELECT series, f, z, var, w * (t - tau) AS a FROM s JOIN u USING (series, f))
SELECT series, f, round((sum(z * cos(a)) ** 2 / sum(cos(a) ** 2) + sum(z * sin(a)) ** 2 / sum(sin(a) ** 2)) / (2 * any_value(var)), 5) AS power FROM a GROUP BY ALL""",
    "circular_spectrum": "SELECT event_type AS grp, CAST(k AS INTEGER) AS k, round(avg(cos(radians(hour(ts) * 15.0) * k)) ** 2 + avg(sin(radians(hour(ts) * 15.0) * k)) ** 2, 6) AS power FROM events, range(1, 7) g(k) GROUP BY ALL",
    "markov": """WITH p AS (SELECT event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), c AS (SELECT a, b, count(*) AS o FROM p WHERE b IS NOT NULL GROUP BY ALL),
e AS (SELECT *, CAST(sum(o) OVER (PARTITION BY a) AS DOUBLE) * sum(o) OVER (PARTITION BY b) / sum(o) OVER () AS e FROM c)
SELECT CAST(sum(o) AS BIGINT) AS n, round(sum((o - e) ** 2 / e), 5) AS chi2, (count(DISTINCT a) - 1) * (count(DISTINCT a) - 1) AS df FROM e""",
    "spearman": """WITH a AS (SELECT v, sum(c) OVER (ORDER BY v) - (c - 1) / 2 AS r FROM (SELECT l_quantity AS v, count(*) AS c FROM lineitem GROUP BY 1)), b AS (SELECT v, sum(c) OVER (ORDER BY v) - (c - 1) / 2 AS r FROM (SELECT l_discount AS v, count(*) AS c FROM lineitem GROUP BY 1))
SELECT count(*) AS n, round(corr(a.r, b.r), 6) AS rho FROM lineitem JOIN a ON a.v = l_quantity JOIN b ON b.v = l_discount""",
}
