"""Round trips through the text formats: tables of the driver are written by the sinks and read back by the readers, in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ammolite.functions.storage import shared_folder
from ammolite.operators import trees as t
from ammolite.sources import sinks, text


def _written(lines, tag: str, files: int | None = None) -> str:
    """The path of lines (value, and k to order by if one file is to hold them) written as text."""
    path = f"{shared_folder(lines.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    if files:
        # small tables of the driver, in order: one file a format's grammar needs whole
        lines = lines.repartitionByRange(files, "k").sortWithinPartitions("k")
    lines.select("value").write.text(path)
    return path


def _customers(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"), F.concat("c_mktsegment", F.lit(', "x"')).alias("segment"))


def delimited(s, d):
    path = _written(sinks.delimited(_customers(s, d)), "csv")
    x = s.read.csv(path, escape='"').toDF("c_custkey", "c_name", "c_acctbal", "segment")
    return x.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", text.number(F.col("c_acctbal")).alias("c_acctbal"), "segment")


def missing_tokens(s, d):
    """Cells of every seventh kind: what stands for a missing value, and what doesn't."""
    cells = s.range(40).select(F.col("id"), F.element_at(F.array(*map(F.lit, ["?", " na ", "N/A", "-", "", "1.5", "x", "NULL", "-2", "1e3"])), (F.col("id") % 10 + 1).cast("int")).alias("cell"))
    return cells.select("id", "cell", text.is_missing_token(F.col("cell")).alias("missing"), text.number(F.col("cell")).alias("value"))


def grouped(s, d):
    """Nations by region as a .dat file with decimal commas."""
    n, r = s.read.parquet(f"{d}/nation.parquet"), s.read.parquet(f"{d}/region.parquet")
    head = r.select((F.col("r_regionkey") * 1000).alias("k"), F.format_string("{%s}", "r_name").alias("value"))
    rows = n.select((F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).alias("k"), F.concat_ws("\t", "n_name", F.replace((F.col("n_nationkey") / 4).cast("string"), F.lit("."), F.lit(",")), F.when(F.col("n_nationkey") % 3 == 0, "?").otherwise("7")).alias("value"))
    path = _written(head.unionByName(rows).unionByName(s.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit("# a comment").alias("value"))), "dat", 1)
    return text.read_grouped(s, path, decimal=",").select("grp", "label", F.col("values")[0].alias("first"), F.col("values")[1].alias("second"))


def landmarks(s, d):
    """Vectors as .tps specimens of three landmarks with a scale."""
    v = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    lines = v.select("vec_id", F.posexplode(F.concat(F.array(F.lit("LM=3")), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.concat_ws(" ", F.round(F.get("e", 2 * k), 4), F.round(F.get("e", 2 * k + 1), 4))), F.array(F.concat(F.lit("ID=v"), F.col("vec_id").cast("string")), F.lit("SCALE=2"))))).select((F.col("vec_id") * 10 + F.col("pos")).alias("k"), F.col("col").alias("value"))
    x = text.read_landmarks(s, _written(lines, "tps", 1))
    return x.select("id", "lm", F.round(F.col("coords")[0], 4).alias("x"), F.round(F.col("coords")[1], 4).alias("y"))


def columns(s, d):
    """Hourly events as commented columns."""
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("k"), F.concat_ws("   ", F.col("event_id").cast("string"), F.round("value", 2).cast("string"), F.lit("*")).alias("value"))
    path = _written(e.unionByName(s.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit("# id value flag").alias("value"))), "columns", 4)
    return text.read_columns(s, path, ["id", "value", "flag"]).select("id", "value", "flag")


def _newick(s, d):
    n = s.read.parquet(f"{d}/nation.parquet").join(s.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey"))
    child = F.concat(F.lit("'"), "n_name", F.lit("':"), (F.col("n_nationkey") / 4 + 1).cast("string"))
    g = n.groupBy("r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", child.alias("c")))), lambda x: x["c"]), ",").alias("kids"))
    return g.select("r_name", F.concat(F.lit("("), "kids", F.lit(")"), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit(":2.5[a comment];")).alias("text"))


def newick(s, d):
    x = text.parse_newick(_newick(s, d), "r_name", "text")
    return x.select("tree_id", "node_id", "parent_id", "name", "length")


def newick_depths(s, d):
    """Trees read from text through the tree operators."""
    x = text.parse_newick(_newick(s, d), "r_name", "text").select("tree_id", "node_id", "parent_id", "name", "length")
    return t.node_table(x, t.ancestors(x)).select("tree_id", "name", "depth", "root_distance", "leaves")


def nexus(s, d):
    """A matrix of the customers' order statuses by year as NEXUS lines."""
    o = s.read.parquet(f"{d}/orders.parquet").select("o_custkey", F.year(F.col("o_orderdate").cast("date")).alias("y"), "o_orderstatus").groupBy("o_custkey", "y").agg(F.max("o_orderstatus").alias("state"))
    grid = o.select("o_custkey").distinct().select("o_custkey", F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("y"))
    return sinks.nexus_matrix(grid.join(o, ["o_custkey", "y"], "left").select(F.concat(F.lit("C "), F.col("o_custkey").cast("string")).alias("taxon"), F.col("y").alias("pos"), "state"))


def latex(s, d):
    return sinks.latex(s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.concat("n_name", F.lit(" & 5%")).alias("n_name")))


QUERIES = {"csv_round_trip": delimited, "missing_tokens": missing_tokens, "dat_round_trip": grouped, "tps_round_trip": landmarks, "columns_round_trip": columns, "newick": newick, "newick_depths": newick_depths, "nexus_matrix": nexus, "latex_rows": latex}

_T = "WITH n AS (SELECT r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS k, count(*) OVER (PARTITION BY r_name) AS c FROM nation JOIN region ON n_regionkey = r_regionkey)"
ORACLE_SQL = {
    "csv_round_trip": "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, c_mktsegment || ', \"x\"' AS segment FROM customer",
    "missing_tokens": """
WITH c AS (SELECT id, ['?', ' na ', 'N/A', '-', '', '1.5', 'x', 'NULL', '-2', '1e3'][id % 10 + 1] AS cell FROM range(40) t(id)) SELECT id, cell, upper(trim(cell)) IN ('?', '*', '-', 'NA', 'N/A', 'NAN', 'NONE', 'NULL') AS missing, TRY_CAST(cell AS DOUBLE) AS value FROM c""",
    "dat_round_trip": "SELECT r_name AS grp, n_name AS label, n_nationkey / 4 AS first, CASE WHEN n_nationkey % 3 <> 0 THEN 7.0 END AS second FROM nation JOIN region ON n_regionkey = r_regionkey",
    "tps_round_trip": "SELECT 'v' || vec_id AS id, CAST(k + 1 AS INTEGER) AS lm, round(2 * round(CAST(embedding[2 * k + 1] AS DOUBLE), 4), 4) AS x, round(2 * round(CAST(embedding[2 * k + 2] AS DOUBLE), 4), 4) AS y FROM embeddings, range(3) g(k)",
    "columns_round_trip": "SELECT CAST(event_id AS DOUBLE) AS id, round(value, 2) AS value, CAST(NULL AS DOUBLE) AS flag FROM events",
    "newick": _T + " SELECT r_name AS tree_id, 0 AS node_id, NULL AS parent_id, r_name AS name, 2.5 AS length FROM region UNION ALL SELECT r_name, k, 0, n_name, n_nationkey / 4 + 1 FROM n",
    "newick_depths": _T + " SELECT r_name AS tree_id, r_name AS name, 0 AS depth, 0.0 AS root_distance, any_value(c) AS leaves FROM n GROUP BY r_name UNION ALL SELECT r_name, n_name, 1, n_nationkey / 4 + 1, 1 FROM n",
    "nexus_matrix": """
WITH o AS (SELECT o_custkey, year(CAST(o_orderdate AS DATE)) AS y, max(o_orderstatus) AS s FROM orders GROUP BY ALL), g AS (SELECT o_custkey, y FROM (SELECT DISTINCT o_custkey FROM o), range(1995, 2002) t(y))
SELECT '    ''C ' || g.o_custkey || '''  ' || string_agg(coalesce(s, '?'), '' ORDER BY g.y) AS value FROM g LEFT JOIN o ON o.o_custkey = g.o_custkey AND o.y = g.y GROUP BY g.o_custkey""",
    "latex_rows": "SELECT n_nationkey || ' & ' || replace(n_name, '_', '\\_') || ' \\& 5\\% \\\\' AS value FROM nation",
}
