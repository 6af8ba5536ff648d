"""Data of plots over customers, orders, parts and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammolite.operators import plots as p


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark, sf_dir):
    return _read(spark, sf_dir, "orders").withColumn("y", F.year(F.col("o_orderdate").cast("date")))


def _flows(spark, sf_dir):
    """Trade between the nations of customers and of suppliers."""
    o = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return _read(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(_read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))


QUERIES = {
    "xy_plot": lambda s, d: p.xy_plot(_read(s, d, "part"), "p_size", "p_retailprice", "p_brand"),
    "xy_error_bars": lambda s, d: p.xy_error_bars(_read(s, d, "part"), "p_brand", "p_size", "p_retailprice"),
    "histogram": lambda s, d: p.histogram(_read(s, d, "events"), "value"),
    "bar_chart": lambda s, d: p.bar_chart(_read(s, d, "orders"), "o_orderpriority", "o_totalprice"),
    "bar_chart_counts": lambda s, d: p.bar_chart(_read(s, d, "orders"), "o_orderstatus"),
    "box_plot": lambda s, d: p.box_plot(_read(s, d, "events"), "event_type", "value"),
    "percentiles": lambda s, d: p.percentiles(_read(s, d, "customer"), "c_mktsegment", "c_acctbal"),
    "pie_chart": lambda s, d: p.pie_chart(_read(s, d, "orders"), "o_orderstatus", "o_totalprice"),
    "stacked_chart": lambda s, d: p.stacked_chart(_orders(s, d), "y", "o_orderpriority", "o_totalprice"),
    "matrix_plot": lambda s, d: p.matrix_plot(_orders(s, d), "y", "o_orderpriority", "o_totalprice"),
    "surface_plot": lambda s, d: p.surface_plot(_orders(s, d), "y", "o_orderpriority", "o_totalprice"),
    "mosaic_plot": lambda s, d: p.mosaic_plot(_read(s, d, "orders"), "o_orderstatus", "o_orderpriority"),
    "venn_diagram": lambda s, d: p.venn_diagram(_read(s, d, "orders"), "o_custkey", open=F.col("o_orderstatus") == "O", urgent=F.col("o_orderpriority") == "1-URGENT", large=F.col("o_totalprice") > 200000),
    "ternary_plot": lambda s, d: p.ternary_plot(_read(s, d, "embeddings"), "vec_id", *(F.abs(F.col("embedding")[k]) for k in range(3))),
    "bubble_plot": lambda s, d: p.bubble_plot(_read(s, d, "part"), "p_partkey", "p_partkey", "p_retailprice", "p_size"),
    "radar_chart": lambda s, d: p.radar_chart(_orders(s, d), "o_orderstatus", "o_orderpriority", "o_totalprice"),
    "polar_plot": lambda s, d: p.polar_plot(_read(s, d, "customer"), "c_mktsegment", "c_custkey", "c_acctbal"),
    "vector_plot": lambda s, d: p.vector_plot(_read(s, d, "supplier"), "s_suppkey", "s_suppkey", "s_acctbal", F.col("s_nationkey") - 12.0, F.col("s_acctbal") / 1000),
    "network_plot": lambda s, d: p.network_plot(_flows(s, d), "c_nationkey", "s_nationkey", "l_quantity"),
    "plot_3d": lambda s, d: p.plot_3d(_read(s, d, "embeddings"), "vec_id", *(F.col("embedding")[k] for k in range(3))),
}

_ORDERS = "o AS (SELECT year(CAST(o_orderdate AS DATE)) AS r, o_orderpriority AS c, sum(o_totalprice) AS v FROM orders GROUP BY ALL)"

ORACLE_SQL = {
    "xy_plot": """
WITH g AS (SELECT p_brand AS grp, count(*) AS n, regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY 1)
SELECT grp, n, round(b, 6) AS slope, round(a, 4) AS intercept, CAST(lo AS DOUBLE) AS x_min, CAST(hi AS DOUBLE) AS x_max, round(a + b * lo, 4) AS y_at_min, round(a + b * hi, 4) AS y_at_max FROM g""",
    "xy_error_bars": """
SELECT p_brand AS grp, round(avg(p_size), 4) AS x, round(avg(p_retailprice), 4) AS y, round(stddev_samp(p_size) / sqrt(count(*)), 4) AS x_error, round(stddev_samp(p_retailprice) / sqrt(count(*)), 4) AS y_error FROM part GROUP BY 1""",
    "histogram": """
WITH e AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT least(19, CAST(floor((value - lo) / ((hi - lo) / 20)) AS INTEGER)) AS bin, count(*) AS c FROM events, e WHERE value IS NOT NULL GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * ((hi - lo) / 20), 6) AS lower, round(lo + (b.bin + 1) * ((hi - lo) / 20), 6) AS upper, coalesce(c.c, 0) AS count, round(coalesce(c.c, 0) / (n * ((hi - lo) / 20)), 9) AS density
FROM (SELECT unnest(range(20)) AS bin) b LEFT JOIN c ON c.bin = b.bin, e""",
    "bar_chart": "SELECT o_orderpriority AS category, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "bar_chart_counts": "SELECT o_orderstatus AS category, CAST(count(*) AS DOUBLE) AS total FROM orders GROUP BY 1",
    "box_plot": """
WITH q AS (SELECT event_type AS grp, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
x AS (SELECT q.*, value AS v, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS i FROM q JOIN events ON event_type = grp WHERE value IS NOT NULL)
SELECT grp, n, round(q1, 4) AS q1, round(m, 4) AS median, round(q3, 4) AS q3, round(min(v) FILTER (i), 4) AS whisker_low, round(max(v) FILTER (i), 4) AS whisker_high, count(*) FILTER (NOT i) AS outliers FROM x GROUP BY grp, n, q1, m, q3""",
    "percentiles": """
SELECT c_mktsegment AS grp, p AS share, round(quantile_cont(c_acctbal, [0.05, 0.25, 0.5, 0.75, 0.95])[i], 4) AS value
FROM customer, (VALUES (1, 0.05), (2, 0.25), (3, 0.5), (4, 0.75), (5, 0.95)) t(i, p) GROUP BY c_mktsegment, i, p""",
    "pie_chart": """
WITH t AS (SELECT o_orderstatus AS category, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT category, round(s, 2) AS total, round(s / sum(s) OVER (), 6) AS share FROM t""",
    "stacked_chart": "WITH " + _ORDERS + """, x AS (SELECT *, v / sum(v) OVER (PARTITION BY r) * 100 AS p FROM o)
SELECT CAST(r AS INTEGER) AS r, c, round(v, 2) AS value, round(p, 6) AS percent, abs(round(sum(p) OVER (PARTITION BY r ORDER BY c) - p, 6)) AS start FROM x""",
    "matrix_plot": "WITH " + _ORDERS + " SELECT CAST(r AS INTEGER) AS r, c, round(v, 2) AS value, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS scaled FROM o",
    "surface_plot": "WITH " + _ORDERS + " SELECT CAST(dense_rank() OVER (ORDER BY r) - 1 AS INTEGER) AS i, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS j, round(v, 2) AS z FROM o",
    "mosaic_plot": """
WITH x AS (SELECT o_orderstatus AS r, o_orderpriority AS c, count(*) AS o FROM orders GROUP BY ALL), y AS (SELECT *, sum(o) OVER (PARTITION BY r) / sum(o) OVER () AS h, o / sum(o) OVER (PARTITION BY c) AS w FROM x)
SELECT r, c, o AS count, round(h, 6) AS height, abs(round(sum(w) OVER (PARTITION BY r ORDER BY c) - w, 6)) AS x, round(w, 6) AS width FROM y""",
    "venn_diagram": """
WITH k AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'O') AS a, bool_or(o_orderpriority = '1-URGENT') AS b, bool_or(o_totalprice > 200000) AS c FROM orders GROUP BY 1)
SELECT concat_ws('+', CASE WHEN a THEN 'open' END, CASE WHEN b THEN 'urgent' END, CASE WHEN c THEN 'large' END) AS region, count(*) AS keys FROM k WHERE a OR b OR c GROUP BY 1""",
    "ternary_plot": """
WITH e AS (SELECT vec_id AS key, abs(CAST(embedding[1] AS DOUBLE)) AS a, abs(CAST(embedding[2] AS DOUBLE)) AS b, abs(CAST(embedding[3] AS DOUBLE)) AS c FROM embeddings)
SELECT key, round(b / (a + b + c) + 0.5 * c / (a + b + c), 6) AS x, round(c / (a + b + c) * sqrt(3) / 2, 6) AS y FROM e WHERE a + b + c <> 0""",
    "bubble_plot": "SELECT p_partkey AS key, CAST(p_partkey AS DOUBLE) AS x, p_retailprice AS y, round(p_size / max(p_size) OVER (), 6) AS area FROM part",
    "radar_chart": """
WITH o AS (SELECT o_orderstatus AS r, o_orderpriority AS axis, sum(o_totalprice) AS v FROM orders GROUP BY ALL), a AS (SELECT axis, 2 * pi() * (row_number() OVER (ORDER BY axis) - 1) / count(*) OVER () AS t FROM (SELECT DISTINCT axis FROM o))
SELECT r, axis, round(t, 6) AS angle, round(v, 2) AS radius, round(v * cos(t), 2) AS x, round(v * sin(t), 2) AS y FROM o JOIN a USING (axis)""",
    "polar_plot": """
SELECT c_mktsegment AS grp, c_custkey AS key, round(2 * pi() * (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) / count(*) OVER (PARTITION BY c_mktsegment), 6) AS angle, round(c_acctbal, 4) AS radius FROM customer""",
    "vector_plot": """
WITH p AS (SELECT s_suppkey AS key, s_suppkey AS x, s_acctbal AS y, s_nationkey - 12.0 AS u, s_acctbal / 1000 AS v FROM supplier),
s AS (SELECT greatest(max(x) - min(x), max(y) - min(y)) * 0.25 / max(sqrt(u * u + v * v)) AS k FROM p) SELECT key, CAST(x AS DOUBLE) AS x, round(y, 4) AS y, round(u * k, 4) AS u, round(v * k, 4) AS v FROM p, s""",
    "network_plot": """
WITH e AS (SELECT c_nationkey AS a, s_nationkey AS b, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
s AS (SELECT greatest(max(a), max(b)) + 1 AS n, max(w) AS m FROM e)
SELECT CAST(a AS BIGINT) AS source, CAST(b AS BIGINT) AS target, round(cos(2 * pi() * a / n), 6) AS source_x, round(sin(2 * pi() * a / n), 6) AS source_y, round(cos(2 * pi() * b / n), 6) AS target_x, round(sin(2 * pi() * b / n), 6) AS target_y, round(0.8 + 3.0 * w / m, 6) AS width FROM e, s""",
    "plot_3d": "SELECT vec_id AS key, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings",
}
