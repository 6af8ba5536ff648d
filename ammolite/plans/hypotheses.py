"""Tests over customers, orders and line items. SQL has no tails of t, F and chi-square: where a closed form exists for the degrees of freedom at hand it is used, else the density is integrated by Simpson's rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammolite.operators import hypotheses as h
from ammolite.plans import univariate
from ammolite.plans.univariate import _read, _strata


def _ships(s, d):
    """Line items with the days since the first of 1995, and whether the line is finished."""
    return _read(s, d, "lineitem").select((F.col("l_quantity") > 25).alias("large"), F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("days"), (F.col("l_linestatus") == "F").alias("ended"))


def _spending(s, d):
    """Order totals of customers by quarter of the year."""
    return _read(s, d, "orders").select("o_custkey", F.quarter(F.col("o_orderdate").cast("date")).alias("y"), "o_totalprice")


QUERIES = {
    "one_way_anova_test": lambda s, d: h.one_way_anova_test(_read(s, d, "customer"), "c_mktsegment", "c_acctbal"),
    "kruskal_wallis_test": lambda s, d: h.kruskal_wallis_test(_read(s, d, "lineitem"), "l_returnflag", "l_quantity"),
    "mann_whitney_test": lambda s, d: h.mann_whitney_test(_read(s, d, "lineitem"), "l_linestatus", "l_quantity"),
    "contingency_test": lambda s, d: h.contingency_test(_read(s, d, "orders"), "o_orderstatus", "o_orderpriority"),
    "standardized_residuals": lambda s, d: h.standardized_residuals(_read(s, d, "orders"), "o_orderstatus", "o_orderpriority"),
    "cochran_mantel_haenszel_test": lambda s, d: h.cochran_mantel_haenszel_test(_strata(s, d), "l_returnflag", "large", "ended", correction=True),
    "t_test": lambda s, d: h.t_test(_read(s, d, "lineitem"), "l_linestatus", "l_extendedprice"),
    "paired_t_test": lambda s, d: h.paired_t_test(_read(s, d, "lineitem"), F.col("l_discount"), F.col("l_tax")),
    "ks_test": lambda s, d: h.ks_test(_read(s, d, "lineitem"), "l_linestatus", "l_quantity"),
    "mood_median_test": lambda s, d: h.mood_median_test(_read(s, d, "customer"), F.col("c_nationkey") < 12, "c_acctbal"),
    "log_rank": lambda s, d: h.log_rank(_ships(s, d), F.col("large"), "days", F.col("ended")),
    "paired_rank_test": lambda s, d: h.paired_rank_test(_read(s, d, "lineitem"), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100)),
    "brunner_munzel": lambda s, d: h.brunner_munzel(_read(s, d, "lineitem"), F.col("l_linestatus") == "F", "l_quantity"),
    "fligner_killeen": lambda s, d: h.fligner_killeen(_read(s, d, "customer"), "c_mktsegment", "c_acctbal"),
    "outlier_screen": lambda s, d: h.outlier_screen(_read(s, d, "events"), "event_id", "value"),
    "proportion_test": lambda s, d: h.proportion_test(_read(s, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "O", 0.5),
    "multiple_proportions": lambda s, d: h.multiple_proportions(_read(s, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F"),
    "repeated_measures_anova": lambda s, d: h.repeated_measures_anova(_spending(s, d), "o_custkey", "y", "o_totalprice"),
    "intraclass_correlation": lambda s, d: h.intraclass_correlation(_spending(s, d), "o_custkey", "y", "o_totalprice"),
    "two_way_anova": lambda s, d: h.two_way_anova(_read(s, d, "lineitem"), "l_returnflag", F.col("l_linestatus") == "F", "l_extendedprice"),
    "dispersion_chi2": lambda s, d: h.dispersion_statistic(_read(s, d, "events"), "event_type"),
    "dispersion_g": lambda s, d: h.dispersion_statistic(_read(s, d, "events"), "event_type", "g_test"),
    "model_comparison": lambda s, d: h.model_comparison(h.gaussian_models(_read(s, d, "part"), "p_brand", "p_size", "p_retailprice")),
    "correlation_interval": lambda s, d: h.correlation_interval(_read(s, d, "lineitem"), "l_quantity", "l_extendedprice"),
}

#: 1 - the integral of a density from 0 to z (2000 steps), for a table r with column z: the two-sided tail of a density with the given constant.
_TWO_SIDED = "greatest(0.0, 1 - 2 * (SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {f}) * (abs(r.z) / 2000) / 3 * {c} FROM range(2001) t(i)))"
_NORMAL = _TWO_SIDED.format(f="exp(-power(i * abs(r.z) / 2000, 2) / 2)", c="(1 / sqrt(2 * pi()))")
_T = _TWO_SIDED.format(f="power(1 + power(i * abs(r.z) / 2000, 2) / r.df, -(r.df + 1) / 2)", c="exp(lgamma((r.df + 1) / 2) - lgamma(r.df / 2)) / sqrt(r.df * pi())")
_RANKS = univariate._RANKS
_BEFORE = univariate.ORACLE_SQL
_TABLE = """
WITH c AS (SELECT o_custkey AS s, quarter(CAST(o_orderdate AS DATE)) AS m, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
x AS (SELECT * FROM c WHERE s IN (SELECT s FROM c GROUP BY s HAVING count(*) = (SELECT count(DISTINCT m) FROM c))),
g AS (SELECT count(DISTINCT s) AS n, count(DISTINCT m) AS k, var_pop(v) * count(v) AS sst FROM x),
q AS (SELECT n, k, sst, k * (SELECT var_pop(a) * count(a) FROM (SELECT avg(v) AS a FROM x GROUP BY s)) AS ss, n * (SELECT var_pop(a) * count(a) FROM (SELECT avg(v) AS a FROM x GROUP BY m)) AS sm FROM g)"""
_LOGF = "(SELECT sum(CASE WHEN lp <= lk + 1e-7 THEN exp(lp) ELSE 0 END) FROM (SELECT lgamma(t.n + 1.0) - lgamma(i + 1.0) - lgamma(t.n - i + 1.0) + t.n * ln(0.5) AS lp, lgamma(t.n + 1.0) - lgamma(t.k + 1.0) - lgamma(t.n - t.k + 1.0) + t.n * ln(0.5) AS lk FROM (SELECT unnest(range(0, t.n + 1)) AS i)))"

# Wichura's rational approximations (algorithm AS 241) of the normal quantile, near the middle and in the tail down to 1e-11, highest power first.
_MIDDLE = ((2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457, 13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608), (5226.495278852854561, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867, 5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0))
_TAIL = ((7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734), (1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0))


def _ratio(terms: tuple, at: str) -> str:
    up, down = ("".join("(" for _ in t) + f"{t[0]!r}" + "".join(f") * {at} + {c!r}" for c in t[1:]) + ")" for t in terms)
    return f"({up}) / ({down})"


#: Normal scores of ranks folded upwards, q from a half to 1.
_SCORE = f"CASE WHEN q <= 0.925 THEN (q - 0.5) * {_ratio(_MIDDLE, '(0.180625 - (q - 0.5) ** 2)')} ELSE {_ratio(_TAIL, '(sqrt(-ln(1 - q)) - 1.6)')} END"

ORACLE_SQL = {
    "fligner_killeen": "WITH m AS (SELECT c_mktsegment AS g, median(CAST(c_acctbal AS DOUBLE)) AS m FROM customer GROUP BY 1), d AS (SELECT g, abs(CAST(c_acctbal AS DOUBLE) - m) AS v FROM customer JOIN m ON g = c_mktsegment), r AS (SELECT g, (1 + (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2) / (count(*) OVER () + 1)) / 2 AS q FROM d), a AS (SELECT g, " + _SCORE + """ AS a FROM r),
w AS (SELECT avg(a) AS m, var_samp(a) AS s, count(DISTINCT g) AS k FROM a), c AS (SELECT any_value(k) AS k, sum(n * (x - w.m) ** 2 / s) AS chi2 FROM (SELECT g, count(*) AS n, avg(a) AS x FROM a GROUP BY 1), w)
SELECT k - 1 AS df, round(chi2, 5) AS chi2, round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) AS p FROM c""",
    "one_way_anova_test": "WITH a AS (" + _BEFORE["one_way_anova"].replace("WITH g", "WITH g", 1) + """)
SELECT df_between, df_within, f, round(power(df_within / (df_within + 4 * f), df_within / 2) * (1 + df_within / 2 * (1 - df_within / (df_within + 4 * f))), 6) AS p, round(ss_ratio / (1 + ss_ratio), 6) AS eta_squared FROM a""",
    "kruskal_wallis_test": "WITH a AS (" + _BEFORE["kruskal_wallis"] + ") SELECT df, n, h, round(exp(-h / 2), 6) AS p FROM a",
    "mann_whitney_test": "WITH r AS (" + _BEFORE["mann_whitney"] + f") SELECT n1, n2, u1, u2, z, round({_NORMAL}, 6) AS p FROM r",
    "contingency_test": "WITH a AS (" + _BEFORE["contingency_chi_square"] + ") SELECT n, df, chi2, round(exp(-chi2 / 2) * (1 + chi2 / 2 + power(chi2 / 2, 2) / 2 + power(chi2 / 2, 3) / 6), 6) AS p, cramers_v FROM a",
    "standardized_residuals": """
WITH o AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS o FROM orders GROUP BY ALL), e AS (SELECT *, CAST(sum(o) OVER (PARTITION BY r) AS DOUBLE) * sum(o) OVER (PARTITION BY c) / sum(o) OVER () AS e FROM o)
SELECT r, c, o AS observed, round(e, 6) AS expected, round((o - e) / sqrt(e), 6) AS residual FROM e""",
    "cochran_mantel_haenszel_test": """
WITH x AS (SELECT l_returnflag AS s, l_quantity > 25 AS e, l_linestatus = 'F' AS o FROM lineitem),
t AS (SELECT s, CAST(count(*) FILTER (e AND o) AS DOUBLE) AS a, CAST(count(*) FILTER (e AND NOT o) AS DOUBLE) AS b, CAST(count(*) FILTER (NOT e AND o) AS DOUBLE) AS c, CAST(count(*) FILTER (NOT e AND NOT o) AS DOUBLE) AS d, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY s),
q AS (SELECT count(*) AS strata, power(greatest(0, abs(sum(a - (a + b) * (a + c) / n)) - 0.5), 2) / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) AS chi2, sum(a * d / n) / sum(b * c / n) AS odds FROM t WHERE n > 1),
r AS (SELECT *, sqrt(chi2) AS z FROM q) SELECT strata, round(chi2, 6) AS chi2, round(""" + _NORMAL + ", 6) AS p, round(odds, 6) AS odds_ratio FROM r",
    "t_test": """
WITH g AS (SELECT l_linestatus AS k, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v FROM lineitem GROUP BY 1),
q AS (SELECT a.n + b.n - 2 AS df, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS d, 1 / a.n + 1 / b.n AS w FROM g a, g b WHERE a.k = 'F' AND b.k = 'O'), r AS (SELECT *, d / sqrt(w) AS z FROM q)
SELECT df, round(z, 6) AS t, round(""" + _T + ", 6) AS p, round(d, 6) AS cohens_d FROM r",
    "paired_t_test": """
WITH q AS (SELECT count(*) AS n, avg(l_discount - l_tax) AS m, stddev_samp(l_discount - l_tax) AS s FROM lineitem), r AS (SELECT n, n - 1 AS df, m, m / (s / sqrt(n)) AS z FROM q)
SELECT n, df, round(m, 6) AS mean_difference, round(z, 6) AS t, round(CASE WHEN abs(z) > 40 THEN 0 ELSE """ + _T + " END, 6) AS p FROM r",
    "ks_test": """
WITH n AS (SELECT count(*) FILTER (l_linestatus = 'F') AS a, count(*) FILTER (l_linestatus = 'O') AS b FROM lineitem),
c AS (SELECT l_quantity AS v, count(*) FILTER (l_linestatus = 'F') AS a, count(*) FILTER (l_linestatus = 'O') AS b FROM lineitem GROUP BY 1),
s AS (SELECT v, sum(c.a) OVER (ORDER BY v) / n.a - sum(c.b) OVER (ORDER BY v) / n.b AS g FROM c, n), t AS (SELECT * FROM s ORDER BY round(abs(g), 12) DESC, v LIMIT 1)
SELECT round(abs(g), 6) AS d, CAST(sign(round(g, 12)) AS INTEGER) AS sign, v AS location, round(least(1, greatest(0, 2 * (SELECT sum(power(-1, k - 1) * exp(-2.0 * k * k * (n.a * n.b / (n.a + n.b)) * g * g)) FROM range(1, 101) k(k)))), 6) AS p FROM t, n""",
    "mood_median_test": """
WITH m AS (SELECT quantile_cont(c_acctbal, 0.5) AS m FROM customer), x AS (SELECT c_nationkey < 12 AS g, c_acctbal > m AS up FROM customer, m WHERE c_acctbal <> m),
t AS (SELECT count(*) FILTER (g AND up) AS a, count(*) FILTER (g AND NOT up) AS b, count(*) FILTER (NOT g AND up) AS c, count(*) FILTER (NOT g AND NOT up) AS d FROM x),
w AS (SELECT a, b, c, d, i, -(lgamma(i + 1.0) + lgamma(a + b - i + 1.0) + lgamma(a + c - i + 1.0) + lgamma(d - a + i + 1.0)) AS l FROM (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS i FROM t)),
v AS (SELECT *, exp(l - max(l) OVER ()) AS e, l - max(l) FILTER (i = a) OVER () AS gap FROM w)
SELECT a, b, c, d, round(least(1, sum(e) FILTER (gap <= 1e-7) / sum(e)), 6) AS p FROM v GROUP BY a, b, c, d""",
    "log_rank": """
WITH x AS (SELECT l_quantity > 25 AS g, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS t, l_linestatus = 'F' AS e FROM lineitem),
c AS (SELECT t, count(*) FILTER (g) AS n1, count(*) AS n, count(*) FILTER (g AND e) AS d1, count(*) FILTER (e) AS d FROM x GROUP BY t),
q AS (SELECT d1, d, CAST(sum(n1) OVER (ORDER BY t DESC) AS DOUBLE) AS r1, CAST(sum(n) OVER (ORDER BY t DESC) AS DOUBLE) AS r FROM c),
s AS (SELECT CAST(sum(d1) AS BIGINT) AS o, sum(d * r1 / r) AS ex, sum(CASE WHEN r > 1 THEN d * r1 / r * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END) AS v FROM q WHERE d > 0), r AS (SELECT *, (o - ex) ** 2 / v AS chi2, abs(o - ex) / sqrt(v) AS z FROM s)
SELECT o AS observed, round(ex, 5) AS expected, round(chi2, 5) AS chi2, round(""" + _NORMAL + ", 6) AS p FROM r",
    "paired_rank_test": """
WITH d AS (SELECT round(l_discount * 100) - round(l_tax * 100) AS d FROM lineitem), c AS (SELECT abs(d) AS v, count(*) AS n FROM d WHERE d <> 0 GROUP BY 1), k AS (SELECT v, n, sum(n) OVER (ORDER BY v) - (n - 1) / 2 AS r FROM c),
t AS (SELECT count(*) AS n, count(*) FILTER (d > 0) AS k, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS wp, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS wm, sum(CAST(n AS DOUBLE) * n - 1) AS ties FROM d JOIN k ON v = abs(d)),
r AS (SELECT *, (least(wp, wm) - CAST(n AS DOUBLE) * (n + 1) / 4) / sqrt(CAST(n AS DOUBLE) * (n + 1) * (2.0 * n + 1) / 24 - ties / 48) AS z FROM t)
SELECT n, k AS positive, round(wp, 1) AS w_plus, round(wm, 1) AS w_minus, round(z, 6) AS z, round(CASE WHEN abs(z) > 40 THEN 0 ELSE least(1, """ + _NORMAL + ") END, 6) AS p, round(least(1, " + _LOGF.replace("t.", "r.") + "), 6) AS sign_p FROM r",
    "brunner_munzel": """
WITH x AS (SELECT l_linestatus = 'F' AS g, l_quantity AS v FROM lineitem), c AS (SELECT v, count(*) AS n FROM x GROUP BY 1), k AS (SELECT v, sum(n) OVER (ORDER BY v) - (n - 1) / 2 AS r FROM c),
o AS (SELECT g, v, count(*) AS n FROM x GROUP BY ALL), w AS (SELECT g, v, sum(n) OVER (PARTITION BY g ORDER BY v) - (n - 1) / 2 AS r FROM o),
s AS (SELECT x.g, CAST(count(*) AS DOUBLE) AS n, avg(k.r) AS r, var_samp(k.r - w.r) AS s2 FROM x JOIN k USING (v) JOIN w ON w.g = x.g AND w.v = x.v GROUP BY x.g),
q AS (SELECT a.n AS n1, b.n AS n2, a.r AS r1, b.r AS r2, a.n * a.s2 AS a, b.n * b.s2 AS b FROM s a, s b WHERE a.g AND NOT b.g), r AS (SELECT *, n1 * n2 * (r1 - r2) / ((n1 + n2) * sqrt(a + b)) AS z, (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1)) AS df FROM q)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round((r1 - (n1 + 1) / 2) / n2, 6) AS win, round(z, 5) AS statistic, round(df, 4) AS df, round(""" + _T + ", 6) AS p FROM r",
    "outlier_screen": """
WITH m AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) SELECT event_id AS key, value AS v, round((value - m) / s, 6) AS z FROM events, m WHERE abs((value - m) / s) > 1.959963984540054""",
    "proportion_test": """
WITH t AS (SELECT o_orderpriority AS grp, count(*) FILTER (o_orderstatus = 'O') AS k, count(*) AS n FROM orders GROUP BY 1)
SELECT grp, k AS successes, n AS trials, round(k / n, 6) AS share, round(least(1, """ + _LOGF + "), 6) AS p FROM t",
    "multiple_proportions": """
WITH t AS (SELECT o_orderpriority AS grp, count(*) FILTER (o_orderstatus = 'F') AS k, count(*) AS n, 1.959963984540054 AS z FROM orders GROUP BY 1), q AS (SELECT *, k / n AS p FROM t)
SELECT grp, k AS successes, n AS trials, round(p, 6) AS share, round(greatest(0, (p + z * z / (2 * n)) / (1 + z * z / n) - z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))), 6) AS low,
 round(least(1, (p + z * z / (2 * n)) / (1 + z * z / n) + z / (1 + z * z / n) * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))), 6) AS high FROM q""",
    "repeated_measures_anova": _TABLE + """, f AS (SELECT *, sst - ss - sm AS se, k - 1 AS df1, (k - 1) * (n - 1) AS df2, (sm / (k - 1)) / ((sst - ss - sm) / ((k - 1) * (n - 1))) AS f FROM q),
-- tail of F with an odd df1: the Simpson integral of the beta density of x = df1 f / (df1 f + df2) after x = u^2
r AS (SELECT *, sqrt(df1 * f / (df1 * f + df2)) AS z FROM f)
SELECT n, df1, df2, round(ss / sst, 6) AS share_subjects, round(sm / sst, 6) AS share_measurements, round(se / sst, 6) AS share_error, round(f, 5) AS f,
 round(1 - (SELECT sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * 2 * power(i * r.z / 2000, r.df1 - 1) * power(1 - power(i * r.z / 2000, 2), r.df2 / 2 - 1)) * (r.z / 2000) / 3 * exp(lgamma((r.df1 + r.df2) / 2) - lgamma(r.df1 / 2) - lgamma(r.df2 / 2)) FROM range(2001) t(i)), 6) AS p FROM r""",
    "intraclass_correlation": _TABLE + """, m AS (SELECT n, k, ss / (n - 1) AS ms, sm / (k - 1) AS mm, (sst - ss - sm) / ((n - 1) * (k - 1)) AS me FROM q)
SELECT n, k, CASE WHEN me > 0 THEN round((ms - me) / (ms + (k - 1) * me + k * (mm - me) / n), 6) END AS icc_2_1, CASE WHEN me > 0 THEN round((ms - me) / (ms + (k - 1) * me), 6) END AS icc_3_1 FROM m""",
    "two_way_anova": """
WITH x AS (SELECT l_returnflag AS a, l_linestatus = 'F' AS b, l_extendedprice AS v FROM lineitem), g AS (SELECT count(*) AS n, var_pop(v) * count(v) AS sst FROM x),
l AS (SELECT a, count(*) AS m, avg(v) AS mean, count(*) FILTER (b) AS n1, count(*) FILTER (NOT b) AS n2, avg(v) FILTER (b) AS m1, avg(v) FILTER (NOT b) AS m2 FROM x GROUP BY a),
t AS (SELECT count(*) AS k, sum(m * mean * mean) - power(sum(m * mean), 2) / sum(m) AS sa, power(sum(n1 * n2 / (n1 + n2) * (m1 - m2)), 2) / sum(n1 * n2 / (n1 + n2)) AS sb, sum(n1 * n2 / (n1 + n2) * (m1 - m2) ** 2) AS sc FROM l),
q AS (SELECT t.*, g.*, sst - sa - sc AS se, n - 2 * k AS dfe FROM t, g),
y AS (SELECT 'a' AS term, k - 1 AS df, sa AS ss, se, dfe, sst FROM q UNION ALL SELECT 'b', 1, sb, se, dfe, sst FROM q UNION ALL SELECT 'a:b', k - 1, sc - sb, se, dfe, sst FROM q), f AS (SELECT *, (ss / df) / (se / dfe) AS f FROM y),
r AS (SELECT *, sqrt(f) AS z, dfe AS df_t FROM f)
SELECT term, df, dfe AS df_error, round(f, 5) AS f, round(CASE WHEN df = 2 THEN power(dfe / (dfe + 2 * f), dfe / 2) ELSE """ + _T.replace("r.df", "r.df_t") + " END, 6) AS p, round(ss / sst, 6) AS eta_squared, round(ss / (ss + se), 6) AS partial_eta_squared FROM r",
    "dispersion_chi2": """
WITH o AS (SELECT count(*) AS o FROM events GROUP BY event_type), t AS (SELECT count(*) AS k, CAST(sum(o) AS BIGINT) AS n FROM o), x AS (SELECT sum((o - n / k) ** 2 / (n / k)) AS x FROM o, t)
SELECT k - 1 AS df, n, round(x, 5) AS statistic, round(exp(-x / 2) * (1 + x / 2), 6) AS p FROM t, x""",
    "dispersion_g": """
WITH o AS (SELECT count(*) AS o FROM events GROUP BY event_type), t AS (SELECT count(*) AS k, CAST(sum(o) AS BIGINT) AS n FROM o), x AS (SELECT sum(2 * o * ln(o / (n / k))) AS x FROM o, t)
SELECT k - 1 AS df, n, round(x, 5) AS statistic, round(exp(-x / 2) * (1 + x / 2), 6) AS p FROM t, x""",
    "model_comparison": """
WITH s AS (SELECT p_brand AS g, CAST(count(*) AS DOUBLE) AS n, regr_syy(p_retailprice, p_size) AS syy, regr_syy(p_retailprice, p_size) - regr_sxy(p_retailprice, p_size) ** 2 / regr_sxx(p_retailprice, p_size) AS rss FROM part GROUP BY 1),
m AS (SELECT 'constant:' || g AS model, -n / 2 * (ln(2 * pi() * syy / n) + 1) AS ll, 2 AS k, n FROM s UNION ALL SELECT 'line:' || g, -n / 2 * (ln(2 * pi() * rss / n) + 1), 3, n FROM s),
a AS (SELECT model, 2 * k - 2 * ll AS aic, CASE WHEN n > k + 1 THEN 2 * k - 2 * ll + 2.0 * k * (k + 1) / (n - k - 1) END AS aicc FROM m)
SELECT model, round(aic, 4) AS aic, round(aicc, 4) AS aicc, round(aicc - min(aicc) OVER (), 4) AS delta, round(exp(-(aicc - (SELECT min(aicc) FROM a)) / 2) / sum(exp(-(aicc - (SELECT min(aicc) FROM a)) / 2)) OVER (), 6) AS weight FROM a""",
    "correlation_interval": """
WITH t AS (SELECT count(*) AS n, corr(l_extendedprice, l_quantity) AS r FROM lineitem)
SELECT n, round(r, 6) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM t""",
}
