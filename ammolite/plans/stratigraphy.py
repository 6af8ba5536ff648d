"""Occurrence queries: an order is an occurrence of its customer, its age the days before 2002; bins are years."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammolite.operators import stratigraphy as o


def occurrences(spark, sf_dir):
    age = F.date_diff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")).cast("double")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("taxon"), age.alias("min_ma"), (age + F.col("o_orderkey") % 200).alias("max_ma"))


def bins(spark):
    return spark.createDataFrame([(k, 365.0 * k, 365.0 * (k + 1)) for k in range(9)], "bin int, min_ma double, max_ma double")


def _depths(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_retailprice").cast("double").alias("depth")).distinct()


def _lifetimes(spark, sf_dir):
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.select("l_returnflag", F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("days"), (F.col("l_linestatus") == "F").alias("ended"))


ANCHORS = [(900.0, 0.0), (1100.0, 50.0), (1500.0, 400.0), (1800.0, 420.0)]
QUERIES = {
    "bin_time_mid": lambda s, d: o.bin_time(occurrences(s, d), bins(s)).groupBy("bin").agg(F.count("*").alias("n"), F.count_distinct("taxon").alias("taxa")),
    "bin_time_all": lambda s, d: o.bin_time(occurrences(s, d), bins(s), "all"),
    "bin_time_majority": lambda s, d: o.bin_time(occurrences(s, d), bins(s), "majority"),
    "range_through_diversity": lambda s, d: o.range_through(o.ranges(occurrences(s, d)), bins(s)),
    "range_extension": lambda s, d: o.strauss_sadler(o.ranges(occurrences(s, d))),
    "depth_to_time": lambda s, d: o.depth_to_time(_depths(s, d), s.createDataFrame(ANCHORS, "depth double, age double")),
    "date_to_day_number": lambda s, d: o.day_numbers(s.read.parquet(f"{d}/orders.parquet"), "o_orderdate"),
    "log_rank_test": lambda s, d: o.log_rank(_lifetimes(s, d), "l_returnflag", "days", F.col("ended"), ("A", "N")),
}

_O = """WITH o AS (SELECT o_orderkey AS id, o_custkey AS taxon, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS DOUBLE) AS lo, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS DOUBLE) + o_orderkey % 200 AS hi FROM orders),
b AS (SELECT CAST(k AS INTEGER) AS bin, 365.0 * k AS bl, 365.0 * (k + 1) AS bh FROM range(0, 9) g(k))"""
_R = _O + ", r AS (SELECT taxon, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM o GROUP BY 1)"
ORACLE_SQL = {
    "bin_time_mid": _O + " SELECT bin, count(*) AS n, count(DISTINCT taxon) AS taxa FROM o LEFT JOIN b ON (lo + hi) / 2 > bl AND (lo + hi) / 2 < bh GROUP BY bin",
    "bin_time_all": _O + " SELECT taxon, lo AS min_ma, hi AS max_ma, bin FROM o JOIN b ON lo < bh AND hi > bl",
    "bin_time_majority": _O + ", j AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY least(hi, bh) - greatest(lo, bl) DESC, bin) AS k FROM o JOIN b ON lo < bh AND hi > bl) SELECT taxon, lo AS min_ma, hi AS max_ma, bin FROM j WHERE k = 1",
    "range_through_diversity": _R + """ SELECT bin, count(taxon) AS richness, count(taxon) FILTER (NOT EXISTS (SELECT 1 FROM b o2 WHERE r.lo < o2.bh AND r.hi > o2.bl AND o2.bh > b.bh)) AS origination,
count(taxon) FILTER (lo > 0 AND NOT EXISTS (SELECT 1 FROM b o2 WHERE r.lo < o2.bh AND r.hi > o2.bl AND o2.bl < b.bl)) AS extinction FROM b LEFT JOIN r ON lo < bh AND hi > bl GROUP BY bin""",
    "range_extension": _R + " SELECT taxon, n, round(hi - lo, 6) AS range, CASE WHEN n > 1 THEN round((hi - lo) * (pow(1 - 0.95, -1.0 / (n - 1)) - 1), 6) END AS extension FROM r",
    "depth_to_time": """WITH x AS (SELECT DISTINCT CAST(p_retailprice AS DOUBLE) AS depth FROM part)
SELECT depth, round(CASE WHEN depth < 1100 THEN (depth - 900) / 200 * 50 WHEN depth < 1500 THEN 50 + (depth - 1100) / 400 * 350 ELSE 400 + (depth - 1500) / 300 * 20 END, 6) AS age FROM x""",
    "date_to_day_number": "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS d, CAST(date_diff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1 AS INTEGER) AS ordinal, CAST(dayofyear(o_orderdate) AS INTEGER) AS day_of_year, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 2440588 AS INTEGER) AS julian_day FROM orders",
    "log_rank_test": """
WITH c AS (SELECT date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS t, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_linestatus = 'F') AS d, count(*) FILTER (l_linestatus = 'F' AND l_returnflag = 'A') AS d1 FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1),
r AS (SELECT d, d1, CAST(sum(n) OVER w AS DOUBLE) AS r, CAST(sum(n1) OVER w AS DOUBLE) AS r1 FROM c WINDOW w AS (ORDER BY t DESC)), s AS (SELECT CAST(sum(d1) AS BIGINT) AS o, sum(d * r1 / r) AS e, sum(CASE WHEN r > 1 THEN d * (r1 / r) * (1 - r1 / r) * (r - d) / (r - 1) ELSE 0 END) AS v FROM r WHERE d > 0)
SELECT o AS observed, round(e, 5) AS expected, round(v, 5) AS variance, round((o - e) ** 2 / v, 5) AS chi2 FROM s""",
}
