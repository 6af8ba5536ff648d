"""Matrix queries: parts as rows with size and price, suppliers by return flag as a table of counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammolite.operators import matrix as m


def _table(spark, sf_dir):
    """Suppliers by order lines of each return flag; a flag that a supplier lacks is missing."""
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("row_id"), F.col("l_returnflag").alias("var")).agg(F.sum("l_quantity").alias("value"))
    wide = x.groupBy("row_id").pivot("var", ["A", "N", "R"]).agg(F.first("value"))
    return m.melt(wide, "row_id", list("ANR"))


def _wide(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")


QUERIES = {
    "matrix_log": lambda s, d: m.log_transform(_table(s, d)),
    "matrix_sqrt": lambda s, d: m.sqrt_transform(_table(s, d)),
    "matrix_zscore": lambda s, d: m.zscore(_table(s, d)),
    "matrix_percent": lambda s, d: m.percent(_table(s, d)),
    "matrix_hellinger": lambda s, d: m.hellinger(_table(s, d)),
    "matrix_wisconsin": lambda s, d: m.wisconsin(_table(s, d)),
    "impute_mean": lambda s, d: m.impute(_table(s, d)),
    "impute_median": lambda s, d: m.impute(_table(s, d), "median"),
    "missing_info": lambda s, d: m.missing_info(_table(s, d)),
    "remove_rows_with_missing": lambda s, d: m.complete_rows(_table(s, d)),
    "covariance_matrix": lambda s, d: m.covariance(_wide(s, d), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "effect_sizes": lambda s, d: m.effect_sizes(s.read.parquet(f"{d}/customer.parquet"), "c_mktsegment", "c_acctbal"),
}

_T = """WITH f AS (SELECT * FROM (VALUES ('A'), ('N'), ('R')) v(var)), r AS (SELECT DISTINCT l_suppkey AS row_id FROM lineitem), q AS (SELECT l_suppkey AS row_id, l_returnflag AS var, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
c AS (SELECT r.row_id, f.var, q.value FROM r CROSS JOIN f LEFT JOIN q ON q.row_id = r.row_id AND q.var = f.var)"""
_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORACLE_SQL = {
    "matrix_log": _T + " SELECT row_id, var, round(ln(value + 1) / ln(10), 6) AS value FROM c",
    "matrix_sqrt": _T + " SELECT row_id, var, round(sqrt(value), 6) AS value FROM c",
    "matrix_zscore": _T + " SELECT row_id, var, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS value FROM c WINDOW w AS (PARTITION BY var)",
    "matrix_percent": _T + " SELECT row_id, var, round(100 * value / sum(value) OVER (PARTITION BY row_id), 6) AS value FROM c",
    "matrix_hellinger": _T + " SELECT row_id, var, round(sqrt(value / sum(value) OVER (PARTITION BY row_id)), 6) AS value FROM c",
    "matrix_wisconsin": _T + ", m AS (SELECT row_id, var, value / max(value) OVER (PARTITION BY var) AS value FROM c) SELECT row_id, var, round(value / sum(value) OVER (PARTITION BY row_id), 6) AS value FROM m",
    "impute_mean": _T + " SELECT row_id, var, round(coalesce(value, avg(value) OVER (PARTITION BY var)), 6) AS value FROM c",
    "impute_median": _T + ", m AS (SELECT var, quantile_cont(value, 0.5) AS f FROM c GROUP BY 1) SELECT row_id, var, round(coalesce(value, f), 6) AS value FROM c JOIN m USING (var)",
    "missing_info": _T + " SELECT var, count(*) FILTER (value IS NULL) AS n_missing, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(sum(value), 2) AS total FROM c GROUP BY var",
    "remove_rows_with_missing": _T + " SELECT row_id, count(*) FILTER (value IS NULL) AS n_missing FROM c GROUP BY 1 HAVING count(*) FILTER (value IS NULL) = 0",
    "covariance_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) + 0.0 AS covariance, round(corr({a}, {b}), 6) + 0.0 AS correlation FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i:]),
    "effect_sizes": """WITH g AS (SELECT count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS s2 FROM customer GROUP BY c_mktsegment), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm, sum(n * m * m) AS q, sum(n * s2) AS ssw FROM g),
x AS (SELECT q - n * gm * gm AS ssb, ssw, k - 1 AS a, n - k AS b FROM t), y AS (SELECT *, (ssb / a) / (ssw / b) AS f FROM x)
SELECT round(ssb / (ssb + ssw), 8) AS eta_squared, round(least(1.0, greatest(0.0, (f * a - a) / (f * a + b + 1))), 8) AS omega_squared FROM y""",
}
