"""Records and curves over hourly series, events, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammolite.functions import axes
from ammolite.operators import records as r
from ammolite.operators import timescales
from ammolite.operators.series import lomb_scargle
from ammolite.plans.series import _H, FREQUENCIES
from ammolite.plans.series import ORACLE_SQL as _SERIES
from ammolite.plans.series import _grid
from ammolite.plans.series import hourly as H

ANCHORS = [(900.0, 0.0), (1100.0, 50.0), (1500.0, 400.0), (1800.0, 420.0)]


def _dates(s, d):
    """Suppliers' balances as radiocarbon ages."""
    return s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), (F.abs("s_acctbal") / 4 + 200).alias("age"), (20.0 + F.col("s_nationkey")).alias("error"))


def _curve(s):
    """A curve that wiggles around the calendar age."""
    return s.range(0, 4001).select(F.col("id").alias("cal"), (F.col("id") * 0.95 + 30 * F.sin(F.col("id") / 50)).alias("mu"), (10 + F.col("id") / 400).alias("sigma"))


def _periods(s):
    return s.range(2, 26).select(F.col("id").cast("double").alias("period"))


QUERIES = {
    "interpolate_nearest": lambda s, d: r.interpolate_nearest(H(s, d), _grid(s, d)),
    "radiocarbon_calibration": lambda s, d: r.radiocarbon(_dates(s, d), _curve(s), 10.0, 5.0),
    "change_points": lambda s, d: r.change_points(H(s, d), 8, 0.05, 0.5),
    "recurrence_quantification": lambda s, d: r.recurrence(H(s, d), 2.0),
    "weedon_periodogram": lambda s, d: r.segment_spectrum(H(s, d), FREQUENCIES, 4),
    "swa_fdr": lambda s, d: r.false_discovery(lomb_scargle(H(s, d), FREQUENCIES), F.lit(1.0), 2, 0.3),
    "match_period_to_orbit": lambda s, d: r.match_periods(s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 2.5).alias("period")), timescales.milankovitch_periods(s), 0.1),
    "milankovitch_target_spectrum": lambda s, d: r.target_spectrum(s.range(1, 201).select((F.col("id") / 2500).alias("f")), timescales.milankovitch_periods(s)),
    "circular_strength_spectrum": lambda s, d: r.circular_strength(s.read.parquet(f"{d}/events.parquet").select((F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).alias("t")), _periods(s)),
    "block_bootstrap_ci": lambda s, d: r.block_bootstrap(H(s, d), 6),
    "age_depth_density": lambda s, d: r.density_grid(H(s, d), 24, 10),
    "hotelling_t2": lambda s, d: r.hotelling_t2(s.read.parquet(f"{d}/lineitem.parquet"), F.col("l_linestatus") == "F", "l_quantity", "l_extendedprice"),
    "age_model": lambda s, d: r.age_model(s.read.parquet(f"{d}/part.parquet").select(F.col("p_retailprice").alias("depth")).distinct(), s.createDataFrame(ANCHORS, "depth double, age double")),
    "lod_dimension": lambda s, d: r.day_length_scale(H(s, d), axes.day_length(F.col("t"))),
}

_DAY = "(23.934468 + (-t / 1000) * (7.432167 + (-t / 1000) * (-0.727046 + (-t / 1000) * (-0.409572 + (-t / 1000) * -0.0589692))))"
_MIL = "(VALUES ('eccentricity_100', 100.0), ('obliquity_41', 41.0), ('precession_21', 21.0), ('precession_19', 19.0), ('precession_23', 23.0)) m(name, k)"
_SEG = _H + ", r AS (SELECT *, least(3, floor((t - min(t) OVER (PARTITION BY series)) / ((max(t) OVER (PARTITION BY series) - min(t) OVER (PARTITION BY series)) / 4))) AS part FROM h)"

ORACLE_SQL = {
    "interpolate_nearest": _H + """, g AS (SELECT DISTINCT series, k + 0.25 AS t FROM h, range(0, 720, 7) a(k)), a AS (SELECT g.series, g.t, max(h.t) AS t0 FROM g LEFT JOIN h ON h.series = g.series AND h.t <= g.t GROUP BY ALL), b AS (SELECT g.series, g.t, min(h.t) AS t1 FROM g LEFT JOIN h ON h.series = g.series AND h.t >= g.t GROUP BY ALL)
SELECT a.series, CAST(a.t AS DOUBLE) AS t, CASE WHEN t0 IS NOT NULL AND t1 IS NOT NULL THEN round(h.v, 6) END AS v FROM a JOIN b ON a.series = b.series AND a.t = b.t LEFT JOIN h ON h.series = a.series AND h.t = CASE WHEN a.t - t0 <= t1 - a.t THEN t0 ELSE t1 END""",
    "radiocarbon_calibration": """
WITH c AS (SELECT k AS cal, k * 0.95 + 30 * sin(k / 50) AS mu, 10 + k / 400 AS sigma FROM range(0, 4001) g(k)), d AS (SELECT s_suppkey AS id, abs(s_acctbal) / 4 + 200 AS age, 20.0 + s_nationkey AS e FROM supplier),
w AS (SELECT id, cal, exp(-((age - 10 - mu) ** 2) / (e * e + sigma * sigma + 25) / 2) / sqrt(e * e + sigma * sigma + 25) AS w FROM d JOIN c ON abs(age - 10 - mu) <= 8 * (e + sigma + 5)), p AS (SELECT id, cal, w / sum(w) OVER (PARTITION BY id) AS p FROM w),
q AS (SELECT *, sum(p) OVER (PARTITION BY id ORDER BY cal) AS up, sum(p) OVER (PARTITION BY id ORDER BY p DESC, cal) - p < 0.95 AS i FROM p)
SELECT id, arg_min(cal, round(abs(up - 0.5), 12) * 1e6 + cal * 1e-9) AS median, arg_max(cal, round(p, 14) - cal * 1e-18) AS mode, count(*) FILTER (i) AS years, min(cal) FILTER (i) AS low, max(cal) FILTER (i) AS high FROM q GROUP BY id""",
    "change_points": _H + """, s AS (SELECT series, t, count(v) OVER a AS n0, count(v) OVER b AS n1, avg(v) OVER a AS m0, avg(v) OVER b AS m1, var_samp(v) OVER a AS s0, var_samp(v) OVER b AS s1 FROM h WINDOW a AS (PARTITION BY series ORDER BY t ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY series ORDER BY t ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
f AS (SELECT *, exp(least(700, (m1 - m0) ** 2 / (4 * (s0 + s1) / 2 / 8))) / sqrt(2) AS f FROM s WHERE n0 = 8 AND n1 = 8), p AS (SELECT *, 0.05 * f / (0.95 + 0.05 * f) AS p FROM f)
SELECT series, t, round(m1 - m0, 6) AS step, round(p, 6) AS posterior FROM p WHERE p >= 0.5""",
    "recurrence_quantification": _H + """, s AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) AS i, v FROM h), p AS (SELECT a.series, b.i - a.i AS lag, a.i FROM s a JOIN s b ON a.series = b.series AND b.i > a.i AND abs(a.v - b.v) <= 2),
g AS (SELECT series, lag, i - row_number() OVER (PARTITION BY series, lag ORDER BY i) AS run FROM p), l AS (SELECT series, lag, run, count(*) AS length FROM g GROUP BY ALL), n AS (SELECT series, count(*) AS n FROM s GROUP BY 1)
SELECT l.series, CAST(sum(length) AS BIGINT) AS points, round(sum(length) / ((any_value(n) - 1) * any_value(n) / 2), 6) AS rate, round(coalesce(sum(length) FILTER (length >= 2), 0) / sum(length), 6) AS determinism, max(length) AS longest, round(avg(length) FILTER (length >= 2), 6) AS mean_line FROM l JOIN n ON n.series = l.series GROUP BY l.series""",
    "weedon_periodogram": _SEG + """, s AS (SELECT series, part, t, v - avg(v) OVER w AS z, var_pop(v) OVER w AS var, k / 100 AS f, 2 * pi() * k / 100 AS w FROM r, range(1, 21) g(k) WINDOW w AS (PARTITION BY series, part)),
u AS (SELECT series, part, f, atan2(sum(sin(2 * w * t)), sum(cos(2 * w * t))) / (2 * any_value(w)) AS tau FROM s GROUP BY ALL), a AS (SELECT series, part, f, z, var, w * (t - tau) AS a FROM s JOIN u USING (series, part, f)),
p AS (SELECT series, part, f, round((sum(z * cos(a)) ** 2 / sum(cos(a) ** 2) + sum(z * sin(a)) ** 2 / sum(sin(a) ** 2)) / (2 * any_value(var)), 5) AS p FROM a GROUP BY ALL)
SELECT series, f, round(avg(p), 7) AS power, count(*) AS segments, 2 * count(*) AS dof FROM p GROUP BY series, f""",
    "swa_fdr": "WITH ls AS (" + _SERIES["lomb_scargle"] + """), p AS (SELECT series, f, exp(-power) AS p FROM ls), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY p, f) AS INTEGER) AS rank, count(*) OVER (PARTITION BY series) AS m FROM p), l AS (SELECT series, max(rank) FILTER (p <= 0.3 * rank / m) AS last FROM r GROUP BY 1)
SELECT series, f, round(p, 6) AS p, rank, coalesce(rank <= last, false) AS significant FROM r JOIN l USING (series)""",
    "match_period_to_orbit": "WITH o AS (SELECT p_partkey AS id, p_size * 2.5 AS period FROM part), n AS (SELECT id, name, k, row_number() OVER (PARTITION BY id ORDER BY round(abs(period - k) / k, 12), name) AS r FROM o, " + _MIL + " WHERE abs(period - k) / k <= 0.1) SELECT o.id, CAST(period AS DOUBLE) AS period, name, CAST(k AS DOUBLE) AS period_kyr FROM o LEFT JOIN n ON n.id = o.id AND r = 1",
    "milankovitch_target_spectrum": "SELECT i / 2500 AS f, round(sum(exp(-power((i / 2500 - 1 / k) / 0.002, 2) / 2)), 8) AS power FROM range(1, 201) g(i), " + _MIL + " GROUP BY i",
    "circular_strength_spectrum": "WITH e AS (SELECT epoch_us(ts) / 3600000000.0 AS t FROM events), s AS (SELECT p, count(*) AS n, avg(cos(2 * pi() * t / p)) AS c, avg(sin(2 * pi() * t / p)) AS s FROM e, range(2, 26) g(p) GROUP BY p) SELECT CAST(p AS DOUBLE) AS period, n, round(sqrt(c * c + s * s), 6) AS strength FROM s",
    "block_bootstrap_ci": _H + """, s AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) - 1 AS i, v FROM h), z AS (SELECT series, count(*) AS n, avg(v) AS mean FROM s GROUP BY 1),
d AS (SELECT series, n, rep, place, CAST('0x' || substr(md5(concat_ws(':', '1', CAST(rep AS VARCHAR), CAST(place AS VARCHAR))), 1, 12) AS BIGINT) % (n - 5) AS start FROM z, range(1, 201) a(rep), range(0, 10000) b(place) WHERE place < ceil(n / 6) AND n >= 6),
k AS (SELECT d.series, rep, avg(s.v) AS m FROM d JOIN range(6) c(k) ON place * 6 + k < n JOIN s ON s.series = d.series AND s.i = start + k GROUP BY ALL)
SELECT z.series, round(any_value(mean), 6) AS mean, round(stddev_samp(m), 6) AS se, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM z JOIN k ON k.series = z.series GROUP BY z.series""",
    "age_depth_density": _H + ", b AS (SELECT min(t) AS a, max(t) AS b, min(v) AS c, max(v) AS d FROM h) SELECT CAST(least(23, floor((t - a) / ((b - a) / 24))) AS INTEGER) AS i, CAST(least(9, floor((v - c) / ((d - c) / 10))) AS INTEGER) AS j, count(*) AS n FROM h, b GROUP BY 1, 2",
    "hotelling_t2": """
WITH g AS (SELECT l_linestatus = 'F' AS g, CAST(count(*) AS DOUBLE) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, var_samp(l_quantity) AS a, var_samp(l_extendedprice) AS b, covar_samp(l_extendedprice, l_quantity) AS c FROM lineitem GROUP BY 1),
t AS (SELECT p.n AS n1, q.n AS n2, p.mx - q.mx AS dx, p.my - q.my AS dy, ((p.n - 1) * p.a + (q.n - 1) * q.a) / (p.n + q.n - 2) AS a, ((p.n - 1) * p.b + (q.n - 1) * q.b) / (p.n + q.n - 2) AS b, ((p.n - 1) * p.c + (q.n - 1) * q.c) / (p.n + q.n - 2) AS c FROM g p, g q WHERE p.g AND NOT q.g),
s AS (SELECT *, n1 * n2 / (n1 + n2) * (dx * dx * b - 2 * dx * dy * c + dy * dy * a) / (a * b - c * c) AS t2, n1 + n2 - 3 AS df2 FROM t), f AS (SELECT *, t2 * df2 / (2 * (df2 + 1)) AS f FROM s)
SELECT round(t2, 5) AS t2, round(f, 5) AS f, CAST(df2 AS BIGINT) AS df2, round(power(df2 / (df2 + 2 * f), df2 / 2), 6) AS p FROM f""",
    "age_model": """WITH x AS (SELECT DISTINCT p_retailprice AS depth FROM part), r AS (SELECT depth, CASE WHEN depth < 1100 THEN 900 WHEN depth < 1500 THEN 1100 ELSE 1500 END AS d0, CASE WHEN depth < 1100 THEN 0 WHEN depth < 1500 THEN 50 ELSE 400 END AS a0, CASE WHEN depth < 1100 THEN 200 / 50 WHEN depth < 1500 THEN 400 / 350 ELSE 300 / 20 END AS rate FROM x)
SELECT depth, round(a0 + (depth - d0) / rate, 6) AS age, round(rate, 6) AS rate FROM r""",
    "lod_dimension": _H + ", m AS (SELECT series, v, " + _DAY + " AS m FROM h), s AS (SELECT series, count(*) AS n, sum(m * v) AS my, sum(m * m) AS mm, sum(v * v) AS yy FROM m GROUP BY 1) SELECT series, n, round(my / mm, 8) AS scale, round(sqrt(greatest(0, yy - my / mm * my) / (n - 1) / mm), 8) AS se FROM s",
}
