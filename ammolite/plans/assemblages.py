"""Rarefaction and its kin: priorities are taxa and customers' nations are samples in the small community, nations and parts in the large one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammolite.operators import assemblages as a
from ammolite.operators import communities as c
from ammolite.plans.ecology import _C, _community, _present


def _brands(s, d):
    """Line items by nation of the supplier and brand of the part."""
    i, u, p = (s.read.parquet(f"{d}/{t}.parquet") for t in ("lineitem", "supplier", "part"))
    return c.communities(i.join(u, F.col("l_suppkey") == F.col("s_suppkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).withColumn("one", F.lit(1)), "s_nationkey", "p_brand", "one")


QUERIES = {
    "rarefaction": lambda s, d: a.rarefaction(_brands(s, d)),
    "sample_based_rarefaction": lambda s, d: a.sample_rarefaction(_community(s, d)),
    "sqs_subsample": lambda s, d: a.sqs_subsample(_brands(s, d), 100),
    "diversity_profile": lambda s, d: a.diversity_profile(_brands(s, d)),
    "sample_rarefaction_tao": lambda s, d: a.sample_accumulation(_community(s, d), 40),
    "chao1_confidence_interval": lambda s, d: a.chao1_interval(_community(s, d)),
    "broken_stick": lambda s, d: a.broken_stick(_brands(s, d)),
    "geometric_series": lambda s, d: a.geometric_series(_brands(s, d)),
    "log_normal": lambda s, d: a.log_normal(_community(s, d)),
    "fisher_alpha": lambda s, d: a.fisher_alpha(_brands(s, d)),
    "c_score": lambda s, d: a.c_score(_brands(s, d), 3),
    "diversity_t_test": lambda s, d: a.group_diversity(_community(s, d), _present(s, d)),
}

_B = "WITH c AS (SELECT s_nationkey AS sample, p_brand AS taxon, CAST(count(*) AS DOUBLE) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
_CH = "exp(lgamma({a} + 1) - lgamma({a} - m + 1) - lgamma({b} + 1) + lgamma({b} - m + 1))"
_E = "sum(CASE WHEN t - n < m THEN 1 ELSE 1 - " + _CH.format(a="(t - n)", b="t") + " END)"
#: The round robin as it is told: every individual of a taxon is in a cycle, and individuals go by cycle, then by abundance.
_RR = """, u AS (SELECT sample, taxon, n, unnest(range(1, CAST(n AS BIGINT) + 1)) AS cycle FROM c), o AS (SELECT sample, taxon, row_number() OVER (PARTITION BY sample ORDER BY cycle, n DESC, taxon) AS k FROM u),
z AS (SELECT o.sample, q.quorum, taxon, CAST(count(*) AS DOUBLE) AS n FROM o JOIN q ON q.sample = o.sample AND o.k <= q.quorum GROUP BY ALL), i AS (SELECT sample, quorum, count(*) AS richness, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h, 1 - sum(n * n) / (sum(n) * sum(n)) AS d FROM z GROUP BY ALL)
SELECT sample, CAST(quorum AS DOUBLE) AS quorum, richness, abs(round(h, 6)) AS shannon, round(d, 6) AS simpson, CASE WHEN richness > 1 THEN round(h / ln(richness), 6) END AS pielou FROM i"""
_K = ", r AS (SELECT sample, n, row_number() OVER (PARTITION BY sample ORDER BY n DESC, taxon) AS k, count(*) OVER (PARTITION BY sample) AS s, sum(n) OVER (PARTITION BY sample) AS t FROM c)"

ORACLE_SQL = {
    "rarefaction": _B + """, x AS (SELECT *, sum(n) OVER (PARTITION BY sample) AS t FROM c), m AS (SELECT DISTINCT sample, floor(1 + k * (least(floor(t / 2), t - 1) - 1) / 49 + 1e-9) AS m FROM x, range(50) g(k) WHERE t >= 2)
SELECT x.sample, CAST(m AS BIGINT) AS m, round(""" + _E + ", 4) AS expected FROM x JOIN m ON m.sample = x.sample GROUP BY ALL",
    "sample_based_rarefaction": _C + ", x AS (SELECT CAST(count(*) AS DOUBLE) AS n, (SELECT CAST(count(DISTINCT sample) AS DOUBLE) FROM c) AS t FROM c GROUP BY taxon), m AS (SELECT unnest(range(1, CAST((SELECT any_value(t) FROM x) AS BIGINT) + 1)) AS m) SELECT m, round(" + _E + ", 4) AS expected FROM x, m GROUP BY m",
    "sqs_subsample": _B + ", q AS (SELECT sample, 100 AS quorum FROM c GROUP BY 1 HAVING sum(n) >= 100)" + _RR,
    "diversity_profile": _B + ", t AS (SELECT sample, sum(n) AS t FROM c GROUP BY 1), q AS (SELECT DISTINCT sample, floor(1 + k * (t - 1) / greatest(least(20, t) - 1, 1) + 1e-9) AS quorum FROM t, range(20) g(k) WHERE k < least(20, t))" + _RR,
    "sample_rarefaction_tao": _C + """, k AS (SELECT taxon, count(*) AS k FROM c GROUP BY 1), f AS (SELECT (SELECT count(DISTINCT sample) FROM c) AS m0, count(*) AS s, count(*) FILTER (k = 1) AS f1, count(*) FILTER (k = 2) AS f2 FROM k),
z AS (SELECT *, least(1.0, greatest(0.0, CASE WHEN f1 = 0 THEN 1 WHEN m0 < 3 THEN 1 - f1 / m0 ELSE 1 - f1 / m0 * ((1 - f2 / (f1 + 1)) * (m0 - 1) / (m0 - 2) + f2 / ((f1 + 1) * (m0 - 2))) END)) AS c FROM f),
e AS (SELECT m, m > m0 AS x, greatest(s + (m - m0) / m0 * CASE WHEN m <= m0 THEN f1 WHEN c > 0 THEN f1 / c ELSE 0 END, least(1, s)) AS e FROM z, range(1, 41) g(m)) SELECT m, round(max(e) OVER (ORDER BY m), 6) AS expected, x AS extrapolated FROM e""",
    "chao1_confidence_interval": _C + """, g AS (SELECT sample, count(*) AS s, sum(n) AS n, CAST(count(*) FILTER (n = 1) AS DOUBLE) AS f1, CAST(count(*) FILTER (n = 2) AS DOUBLE) AS f2 FROM c GROUP BY 1),
h AS (SELECT *, s + CASE WHEN f2 > 0 THEN f1 * f1 / (2 * f2) ELSE f1 * (f1 - 1) / 2 END AS chao, 2 * f2 / nullif((n - 1) * f1 + 2 * f2, 0) AS a, f1 / nullif(f2, 0) AS r FROM g),
v AS (SELECT *, CASE WHEN f2 > 0 AND f1 > 0 THEN f2 * (a / 4 * r ** 4 + a * a / 2 * r ** 3 + a * a / 2 * r * r + a * a / 4 * r) WHEN f1 > 1 THEN f1 * (f1 - 1) / 2 ELSE 0 END AS v FROM h), k AS (SELECT *, exp(1.959963984540054 * sqrt(ln(1 + v / (chao * chao)))) AS k FROM v)
SELECT sample, round(chao, 4) AS chao1, round(chao / k, 4) AS low, round(chao * k, 4) AS high FROM k""",
    "broken_stick": _B + _K + ", p AS (SELECT *, n - t / s * sum(1 / k) OVER (PARTITION BY sample ORDER BY k DESC) AS e FROM r), g AS (SELECT sample, count(*) AS taxa, sum(e * e) AS rss, var_pop(n) * count(n) AS sst FROM p GROUP BY 1) SELECT sample, taxa, round(1 - rss / nullif(sst, 0), 5) AS r_squared, round(taxa * ln(rss / taxa) + 2, 3) AS aic FROM g",
    "geometric_series": _B + _K + ", p AS (SELECT sample, round(0.01 + i * (0.98 / 98), 6) AS c, n - t * power(round(0.01 + i * (0.98 / 98), 6), k - 1) * (1 - round(0.01 + i * (0.98 / 98), 6)) / (1 - power(round(0.01 + i * (0.98 / 98), 6), s)) AS e FROM r, range(99) g(i)), g AS (SELECT sample, c, count(*) AS taxa, sum(e * e) AS rss FROM p GROUP BY ALL) SELECT sample, CAST(c AS DOUBLE) AS ratio, taxa, round(taxa * ln(rss / taxa) + 2, 3) AS aic FROM g QUALIFY row_number() OVER (PARTITION BY sample ORDER BY round(rss, 6), c) = 1",
    "log_normal": _C + ", o AS (SELECT sample, CAST(floor(log2(n + 1) + 1e-12) AS BIGINT) AS r, count(*) AS c FROM c GROUP BY ALL), g AS (SELECT sample, count(*) AS o, regr_slope(ln(c), r * r) AS b, regr_intercept(ln(c), r * r) AS a FROM o GROUP BY 1) SELECT sample, o AS octaves, CASE WHEN o >= 3 THEN round(exp(a), 5) END AS s0, CASE WHEN o >= 3 THEN round(-b, 6) END AS a FROM g",
    "fisher_alpha": _B.replace("WITH c", "WITH RECURSIVE c") + """, g AS (SELECT sample, count(*) AS s, sum(n) AS n FROM c GROUP BY 1 HAVING sum(n) > count(*)),
b AS (SELECT sample, s, n, 0 AS i, ln(1e-12) AS lo, ln(1 - 1e-9) AS hi FROM g UNION ALL SELECT sample, s, n, i + 1, CASE WHEN (1 - exp((lo + hi) / 2)) / (exp((lo + hi) / 2) * -((lo + hi) / 2)) > n / s THEN (lo + hi) / 2 ELSE lo END, CASE WHEN (1 - exp((lo + hi) / 2)) / (exp((lo + hi) / 2) * -((lo + hi) / 2)) > n / s THEN hi ELSE (lo + hi) / 2 END FROM b WHERE i < 60)
SELECT sample, s, CAST(n AS BIGINT) AS n, round(s / -lo, 4) AS alpha, round(1 - exp(lo), 6) AS x FROM b WHERE i = 60""",
    "c_score": _B + ", h AS (SELECT sample, taxon FROM c WHERE n >= 3), t AS (SELECT taxon, count(*) AS r FROM h GROUP BY 1), p AS (SELECT a.r AS ra, b.r AS rb, (SELECT count(*) FROM h x JOIN h y ON x.sample = y.sample WHERE x.taxon = a.taxon AND y.taxon = b.taxon) AS s FROM t a JOIN t b ON a.taxon < b.taxon) SELECT (SELECT count(*) FROM t) AS taxa, round(avg((ra - s) * (rb - s)), 6) AS c_score, round(avg(CASE WHEN s = 0 THEN 1.0 ELSE 0 END), 6) AS checkerboard FROM p",
    "diversity_t_test": _C + """, i AS (SELECT sample, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) AS shannon, round(1 - sum(n * n) / (sum(n) * sum(n)), 6) AS simpson FROM c GROUP BY 1), d AS (SELECT n_regionkey AS grp, 'shannon' AS index, shannon AS v FROM i JOIN nation ON n_nationkey = sample UNION ALL SELECT n_regionkey, 'simpson', simpson FROM i JOIN nation ON n_nationkey = sample),
g AS (SELECT index, grp, count(*) AS n, avg(v) AS m, var_samp(v) AS s2, row_number() OVER (PARTITION BY index ORDER BY grp) AS k FROM d GROUP BY index, grp)
SELECT a.index, a.n AS n1, b.n AS n2, round((a.m - b.m) / sqrt(a.s2 / a.n + b.s2 / b.n), 5) AS t_welch, round((a.m - b.m) / sqrt(((a.n - 1) * a.s2 + (b.n - 1) * b.s2) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)), 5) AS t_pooled FROM g a JOIN g b ON a.index = b.index AND a.k = 1 AND b.k = 2""",
}
