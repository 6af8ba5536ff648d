"""Univariate queries over customers, orders, line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammolite.operators import univariate as u


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lifetimes(spark, sf_dir):
    x = _read(spark, sf_dir, "lineitem")
    return x.select("l_returnflag", F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("days"), (F.col("l_linestatus") == "F").alias("ended"))


def _strata(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") > 25).alias("large"), (F.col("l_linestatus") == "F").alias("ended"))


QUERIES = {
    "summary_statistics": lambda s, d: u.summary_statistics(_read(s, d, "customer"), "c_mktsegment", "c_acctbal"),
    "one_way_anova": lambda s, d: u.one_way_anova(_read(s, d, "customer"), "c_mktsegment", "c_acctbal"),
    "two_sample_t": lambda s, d: u.two_sample_t(_read(s, d, "lineitem"), "l_linestatus", "l_extendedprice"),
    "kruskal_wallis": lambda s, d: u.kruskal_wallis(_read(s, d, "lineitem"), "l_returnflag", "l_quantity"),
    "mann_whitney": lambda s, d: u.mann_whitney(_read(s, d, "lineitem"), "l_linestatus", "l_quantity"),
    "ks_2samp": lambda s, d: u.ks_two_sample(_read(s, d, "lineitem"), "l_linestatus", "l_quantity"),
    "contingency_chi_square": lambda s, d: u.contingency_chi_square(_read(s, d, "orders"), "o_orderstatus", "o_orderpriority"),
    "mood_median": lambda s, d: u.mood_median(_read(s, d, "customer"), "c_mktsegment", "c_acctbal"),
    "cochran_mantel_haenszel": lambda s, d: u.cochran_mantel_haenszel(_strata(s, d), "l_returnflag", "large", "ended"),
    "directional": lambda s, d: u.directional(_read(s, d, "events"), "event_type", F.hour("ts") * 15.0),
    "kaplan_meier": lambda s, d: u.kaplan_meier(_lifetimes(s, d), "l_returnflag", "days", F.col("ended")),
    "survival_intervals": lambda s, d: u.survival_intervals(u.kaplan_meier(_lifetimes(s, d), "l_returnflag", "days", F.col("ended"))),
    "median_survival": lambda s, d: u.median_survival(u.kaplan_meier(_lifetimes(s, d), "l_returnflag", "days", F.col("ended"))),
}

_RANKS = """
x AS (SELECT {g} AS grp, CAST({v} AS DOUBLE) AS v FROM {t}),
c AS (SELECT v, count(*) AS n_ties FROM x GROUP BY v),
k AS (SELECT v, n_ties, sum(n_ties) OVER (ORDER BY v) - (n_ties - 1) / 2 AS avg_rank FROM c),
g AS (SELECT grp, count(*) AS n, sum(avg_rank) AS r, sum(CAST(n_ties AS DOUBLE) * n_ties - 1) AS ties FROM x JOIN k USING (v) GROUP BY grp)"""

ORACLE_SQL = {
    "summary_statistics": """
SELECT c_mktsegment AS grp, count(c_acctbal) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd, round(var_samp(c_acctbal), 4) AS variance, round(min(c_acctbal), 4) AS minimum,
 round(max(c_acctbal), 4) AS maximum, round(quantile_cont(c_acctbal, 0.5), 4) AS median,
 round((avg(c_acctbal ** 3) - 3 * avg(c_acctbal) * avg(c_acctbal ** 2) + 2 * avg(c_acctbal) ** 3) / stddev_pop(c_acctbal) ** 3, 4) AS skewness, round(kurtosis_pop(c_acctbal), 4) AS kurtosis,
 round(stddev_samp(c_acctbal) / sqrt(count(c_acctbal)), 4) AS se FROM customer GROUP BY c_mktsegment""",
    "one_way_anova": """
WITH g AS (SELECT c_mktsegment AS k, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS s2 FROM customer GROUP BY 1),
t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm, sum(n * s2) AS ssw, sum(n * m * m) AS nm2 FROM g)
SELECT CAST(k - 1 AS BIGINT) AS df_between, CAST(n - k AS BIGINT) AS df_within, round((nm2 - n * gm * gm) / ssw, 6) AS ss_ratio, round(((nm2 - n * gm * gm) / (k - 1)) / (ssw / (n - k)), 4) AS f FROM t""",
    "two_sample_t": """
WITH g AS (SELECT l_linestatus AS k, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1),
t AS (SELECT a.n AS n1, b.n AS n2, a.m - b.m AS d, a.v AS v1, b.v AS v2 FROM g a, g b WHERE a.k = 'F' AND b.k = 'O')
SELECT n1, n2, round(d / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t_pooled, round(d / sqrt(v1 / n1 + v2 / n2), 6) AS t_welch FROM t""",
    "kruskal_wallis": "WITH " + _RANKS.format(g="l_returnflag", v="l_quantity", t="lineitem") + """,
t AS (SELECT count(*) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(r * r / n) AS r2, sum(ties) AS ties FROM g)
SELECT k - 1 AS df, CAST(n AS BIGINT) AS n, round((12 / (n * (n + 1)) * r2 - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 5) AS h FROM t""",
    "mann_whitney": "WITH " + _RANKS.format(g="l_linestatus", v="l_quantity", t="lineitem") + """,
t AS (SELECT CAST(a.n AS DOUBLE) AS n1, CAST(b.n AS DOUBLE) AS n2, a.r - CAST(a.n AS DOUBLE) * (a.n + 1) / 2 AS u, a.ties + b.ties AS ties FROM g a, g b WHERE a.grp = 'F' AND b.grp = 'O')
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 1) AS u1, round(n1 * n2 - u, 1) AS u2, round((u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM t""",
    "ks_2samp": """
WITH n AS (SELECT count(*) FILTER (l_linestatus = 'F') AS a, count(*) FILTER (l_linestatus = 'O') AS b FROM lineitem),
c AS (SELECT l_quantity AS v, count(*) FILTER (l_linestatus = 'F') AS a, count(*) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY 1),
s AS (SELECT abs(sum(c.a) OVER (ORDER BY v) / n.a - sum(c.b) OVER (ORDER BY v) / n.b) AS d FROM c, n) SELECT round(max(d), 6) AS d FROM s""",
    "contingency_chi_square": """
WITH o AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS o FROM orders GROUP BY ALL), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, count(DISTINCT o_orderstatus) AS nr, count(DISTINCT o_orderpriority) AS nc FROM orders),
e AS (SELECT r.r, c.c, r.t * c.t / n.n AS e FROM (SELECT r, CAST(sum(o) AS DOUBLE) AS t FROM o GROUP BY r) r, (SELECT c, CAST(sum(o) AS DOUBLE) AS t FROM o GROUP BY c) c, n),
x AS (SELECT sum((coalesce(o, 0) - e) ** 2 / e) AS chi FROM e LEFT JOIN o ON o.r = e.r AND o.c = e.c)
SELECT CAST(n AS BIGINT) AS n, (nr - 1) * (nc - 1) AS df, round(chi, 5) AS chi2, round(sqrt(chi / (n * (least(nr, nc) - 1))), 6) AS cramers_v FROM x, n""",
    "mood_median": """
WITH m AS (SELECT quantile_cont(c_acctbal, 0.5) AS m FROM customer)
SELECT c_mktsegment AS grp, count(*) FILTER (c_acctbal > m) AS above, count(*) FILTER (c_acctbal < m) AS below FROM customer, m GROUP BY 1""",
    "cochran_mantel_haenszel": """
WITH x AS (SELECT l_returnflag AS s, l_quantity > 25 AS e, l_linestatus = 'F' AS o FROM lineitem),
t AS (SELECT s, CAST(count(*) FILTER (e AND o) AS DOUBLE) AS a, CAST(count(*) FILTER (e AND NOT o) AS DOUBLE) AS b, CAST(count(*) FILTER (NOT e AND o) AS DOUBLE) AS c, CAST(count(*) FILTER (NOT e AND NOT o) AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY s)
SELECT count(*) AS strata, round(sum(a - (a + b) * (a + c) / n) ** 2 / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))), 6) AS chi2, round(sum(a * d / n) / sum(b * c / n), 6) AS odds_ratio FROM t WHERE n > 1""",
    "directional": """
WITH s AS (SELECT event_type AS grp, count(*) AS n, avg(cos(radians(hour(ts) * 15.0))) AS c, avg(sin(radians(hour(ts) * 15.0))) AS s FROM events GROUP BY 1), r AS (SELECT *, sqrt(c * c + s * s) AS r FROM s)
SELECT grp, n, round(r, 6) AS r_bar, CASE WHEN n * r * r >= 1 THEN round((degrees(atan2(s, c)) + 360) % 360, 4) END AS mean_direction, round(1 - r, 6) AS circular_variance, round(n * r * r, 5) AS z, round(exp(-n * r * r), 6) AS p FROM r""",
    "kaplan_meier": """
WITH c AS (SELECT l_returnflag AS grp, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS t, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS d FROM lineitem GROUP BY ALL),
r AS (SELECT grp, t, d, sum(n) OVER (PARTITION BY grp ORDER BY t DESC) AS k FROM c),
x AS (SELECT *, max(CAST(d = k AS INTEGER)) OVER w AS gone, sum(CASE WHEN d < k THEN ln(1 - d / k) END) OVER w AS ls, sum(CASE WHEN d < k THEN d / (CAST(k AS DOUBLE) * (k - d)) END) OVER w AS g FROM r WHERE d > 0 WINDOW w AS (PARTITION BY grp ORDER BY t))
SELECT grp, t, CAST(k AS BIGINT) AS at_risk, d AS events, round(CASE WHEN gone = 1 THEN 0 ELSE exp(ls) END, 6) AS survival, CASE WHEN gone = 0 THEN round(exp(ls) * sqrt(g), 6) END AS se FROM x""",
}
ORACLE_SQL |= {
    "survival_intervals": f"""SELECT grp, t, survival, CASE WHEN survival > 0 AND survival < 1 THEN round(exp(-exp(ln(-ln(survival)) + 1.959964 * se / (survival * abs(ln(survival))))), 5) END AS lower,
CASE WHEN survival > 0 AND survival < 1 THEN round(exp(-exp(ln(-ln(survival)) - 1.959964 * se / (survival * abs(ln(survival))))), 5) END AS upper FROM ({ORACLE_SQL['kaplan_meier']})""",
    "median_survival": f"SELECT grp, min(CASE WHEN survival <= 0.5 THEN t END) AS median FROM ({ORACLE_SQL['kaplan_meier']}) GROUP BY grp",
}
