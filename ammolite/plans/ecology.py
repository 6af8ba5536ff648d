"""Community queries: suppliers are samples, parts are taxa, quantities are counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ammolite.operators import communities as c
from ammolite.operators.diversity import alpha_diversity


def _alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alpha_diversity(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey", "l_partkey", "l_quantity")


def _community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by nation of the supplier: 25 samples whose number does not grow with the tables."""
    items, suppliers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "supplier"))
    return c.communities(items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")), "s_nationkey", "l_partkey", "l_quantity")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("sample"), F.col("n_regionkey").alias("grp"))


def _present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the samples that exist."""
    return _groups(spark, sf_dir).join(_community(spark, sf_dir).select("sample").distinct(), "sample")


QUERIES = {
    "alpha_diversity": _alpha,
    "pair_distances": lambda s, d: c.pair_distances(_community(s, d)),
    "beta_diversity": lambda s, d: c.beta_diversity(_community(s, d)),
    "permanova": lambda s, d: c.permanova(c.pair_distances(_community(s, d)), "bray_curtis", _present(s, d)),
    "anosim": lambda s, d: c.anosim(c.pair_distances(_community(s, d)), "bray_curtis", _present(s, d)),
    "simper": lambda s, d: c.simper(_community(s, d), _present(s, d), 0, 1),
    "mantel": lambda s, d: c.mantel(c.pair_distances(_community(s, d)), "bray_curtis", "jaccard"),
    "morphospace_disparity": lambda s, d: c.disparity(c.pair_distances(_community(s, d)), "euclidean"),
    "sample_coverage": lambda s, d: c.sample_coverage(_community(s, d)),
    "she": lambda s, d: c.she(_community(s, d)),
}
_C = "WITH c AS (SELECT s_nationkey AS sample, l_partkey AS taxon, sum(l_quantity) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"
_P = _C + """, x AS (SELECT s.sample, t.taxon, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT sample FROM c) s CROSS JOIN (SELECT DISTINCT taxon FROM c) t LEFT JOIN c ON c.sample = s.sample AND c.taxon = t.taxon),
d AS (SELECT a.sample AS i, b.sample AS j, round(sum(abs(a.n - b.n)) / sum(a.n + b.n), 6) AS bray_curtis, round(1 - count(*) FILTER (a.n > 0 AND b.n > 0) / count(*) FILTER (a.n > 0 OR b.n > 0), 6) AS jaccard,
 round(sqrt(sum((a.n - b.n) ** 2)), 6) AS euclidean, round(sum(abs(a.n - b.n)), 6) AS manhattan, round(sum(abs(a.n - b.n) / (a.n + b.n)) FILTER (a.n + b.n > 0), 6) AS canberra, round(1 - sum(a.n * b.n) / sqrt(sum(a.n ** 2) * sum(b.n ** 2)), 6) AS cosine
 FROM x a JOIN x b ON a.taxon = b.taxon AND a.sample < b.sample GROUP BY ALL)"""
_G = _P + """, g AS (SELECT DISTINCT sample, n_regionkey AS grp FROM c JOIN nation ON n_nationkey = sample),
q AS (SELECT d.bray_curtis AS d, a.grp AS gi, b.grp AS gj FROM d JOIN g a ON a.sample = i JOIN g b ON b.sample = j)"""
ORACLE_SQL = {
    "pair_distances": _P + " SELECT * FROM d",
    "beta_diversity": _P + """, k AS (SELECT a.sample AS i, b.sample AS j, count(*) FILTER (a.n > 0 AND b.n > 0) AS a, count(*) FILTER (a.n > 0 AND b.n = 0) AS b, count(*) FILTER (a.n = 0 AND b.n > 0) AS c FROM x a JOIN x b ON a.taxon = b.taxon AND a.sample < b.sample GROUP BY ALL)
SELECT *, round((b + c) / (a + b + c), 6) AS beta_jac, round(coalesce(2 * least(b, c) / nullif(a + 2 * least(b, c), 0), 0), 6) AS beta_jtu, round(coalesce(a * abs(b - c) / nullif((a + b + c) * (a + 2 * least(b, c)), 0), 0), 6) AS beta_jne,
 round((b + c) / (2 * a + b + c), 6) AS beta_sor, round(coalesce(least(b, c) / nullif(2 * a + least(b, c), 0), 0), 6) AS beta_sim, round(coalesce(2 * a * greatest(b, c) / nullif((2 * a + b + c) * (2 * a + least(b, c)), 0), 0), 6) AS beta_sne FROM k""",
    "permanova": _G + """, z AS (SELECT grp, count(*) AS m FROM g GROUP BY 1), w AS (SELECT sum(s / m) AS ssw FROM (SELECT gi, sum(d * d) AS s FROM q WHERE gi = gj GROUP BY 1) JOIN z ON gi = grp),
t AS (SELECT CAST(sum(m) AS BIGINT) AS n, count(*) AS g FROM z), s AS (SELECT (SELECT sum(d * d) FROM q) / n AS sst, ssw, n, g FROM t, w) SELECT n, g, round(((sst - ssw) / (g - 1)) / (ssw / (n - g)), 5) AS f, round(1 - ssw / sst, 6) AS r2 FROM s""",
    "anosim": _G + """, r AS (SELECT gi = gj AS same, rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2 AS r FROM q)
SELECT count(*) AS pairs, round((avg(r) FILTER (NOT same) - avg(r) FILTER (same)) / (count(*) / 2), 6) AS r FROM r""",
    "simper": _C + """, g AS (SELECT DISTINCT sample, n_regionkey AS grp FROM c JOIN nation ON n_nationkey = sample), t AS (SELECT sample, sum(n) AS t FROM c GROUP BY 1),
p AS (SELECT a.sample AS i, b.sample AS j, ta.t + tb.t AS tot FROM g a JOIN g b ON a.grp = 0 AND b.grp = 1 JOIN t ta ON ta.sample = a.sample JOIN t tb ON tb.sample = b.sample),
v AS (SELECT p.i, p.j, tot, x.taxon FROM p CROSS JOIN (SELECT DISTINCT taxon FROM c JOIN g USING (sample) WHERE grp IN (0, 1)) x),
s AS (SELECT v.taxon, sum(abs(coalesce(a.n, 0) - coalesce(b.n, 0)) / tot) / (SELECT count(*) FROM p) AS average FROM v LEFT JOIN c a ON a.sample = v.i AND a.taxon = v.taxon LEFT JOIN c b ON b.sample = v.j AND b.taxon = v.taxon GROUP BY 1)
SELECT taxon, round(average, 8) AS average, round(average / (SELECT sum(average) FROM s), 8) AS share FROM s""",
    "mantel": _P + " SELECT count(*) AS pairs, round(corr(bray_curtis, jaccard), 6) AS r FROM d",
    "morphospace_disparity": _P + " SELECT round(avg(euclidean), 6) AS dispersion, round(max(euclidean), 6) AS rng, round(var_pop(euclidean), 6) AS variance, round(quantile_cont(euclidean, 0.5), 6) AS median FROM d",
    "sample_coverage": _C + """, k AS (SELECT taxon, count(*) AS k FROM c GROUP BY 1), f AS (SELECT (SELECT count(DISTINCT sample) FROM c) AS m, count(*) AS s_obs, count(*) FILTER (k = 1) AS f1, count(*) FILTER (k = 2) AS f2 FROM k),
z AS (SELECT *, least(1.0, greatest(0.0, CASE WHEN f1 = 0 THEN 1 WHEN m < 3 THEN 1 - f1 / m ELSE 1 - f1 / m * ((1 - f2 / (f1 + 1)) * (m - 1) / (m - 2) + f2 / ((f1 + 1) * (m - 2))) END)) AS c FROM f)
SELECT m, s_obs, f1, f2, round(c, 6) AS coverage, round(m * (1 - c), 6) AS tau, CASE WHEN c > 0 THEN round(f1 * (1 - c) / c, 6) END AS unseen FROM z""",
    "she": _C + """, r AS (SELECT sample, row_number() OVER (ORDER BY sample) AS k FROM (SELECT DISTINCT sample FROM c)), p AS (SELECT a.k, c.taxon, sum(c.n) AS n FROM r a JOIN r b ON b.k <= a.k JOIN c ON c.sample = b.sample GROUP BY ALL),
h AS (SELECT k, count(*) AS s, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM p GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, s, round(h, 6) AS h, CASE WHEN s = 1 THEN 1 ELSE round(exp(h) / s, 6) END AS exp_evenness, CASE WHEN s = 1 THEN 1 ELSE round(h / ln(s), 6) END AS evenness FROM h""",
    "alpha_diversity": """
WITH c AS (SELECT l_suppkey AS sample, l_partkey AS taxon, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 0),
s AS (SELECT sample, count(*) AS s_obs, CAST(sum(n) AS BIGINT) AS n_total, sum(n * ln(n)) AS nl, sum(CAST(n AS DOUBLE) * n) AS n2,
  count(*) FILTER (n = 1) AS f1, count(*) FILTER (n = 2) AS f2 FROM c GROUP BY sample)
SELECT sample, s_obs, n_total, round(ln(n_total) - nl / n_total, 6) AS shannon, round(1 - n2 / (CAST(n_total AS DOUBLE) * n_total), 6) AS simpson,
  CASE WHEN s_obs > 1 THEN round((ln(n_total) - nl / n_total) / ln(s_obs), 6) END AS pielou,
  CASE WHEN s_obs > 1 THEN round((s_obs - 1) / ln(n_total), 6) END AS margalef,
  round(s_obs + CASE WHEN f2 > 0 THEN f1 * f1 / (2.0 * f2) ELSE f1 * (f1 - 1) / 2.0 END, 6) AS chao1
FROM s""",
}
