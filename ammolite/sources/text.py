"""Readers of the text formats: delimited tables, grouped tables (.dat), landmark files (.tps), Newick trees, commented columns.

Files are read whole, a row each, and cut into numbered lines by Spark; what depends on earlier lines (a group's name, a
specimen's block) is a window over one file's lines. Only Newick's grammar runs in Python, a small recursive reader a tree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What stands for a missing cell, trimmed and in any case. A blank cell is not among them.
MISSING_TOKENS = ["?", "*", "-", "NA", "N/A", "NAN", "NONE", "NULL"]


def is_missing_token(c: Column) -> Column:
    return F.upper(F.trim(c)).isin(MISSING_TOKENS)


def number(c: Column, decimal: str = ".") -> Column:
    """A cell as a double: null if it is missing, blank or no number."""
    text = F.trim(c)
    text = F.replace(text, F.lit(decimal), F.lit(".")) if decimal != "." else text
    return F.when(~is_missing_token(c), text.try_cast("double"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of every file, without byte order marks and carriage returns."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return files.select("path", F.posexplode(F.split("value", "\r?\n"))).select("path", (F.col("pos") + 1).alias("line_no"), F.col("col").alias("line"))


def read_table(spark: SparkSession, path: str, label: str | None = None, sep: str = ",", header: bool = True) -> DataFrame:
    """A delimited table with every column but the label a double; what is no number is null. The schema needs no pass over the data but the header's."""
    raw = spark.read.csv(path, sep=sep, header=header, inferSchema=False)
    return raw.select(*(F.col(f"`{c}`") if c == label else number(F.col(f"`{c}`")).alias(c) for c in raw.columns))


def read_grouped(spark: SparkSession, path: str, sep: str = "\t", decimal: str = ".") -> DataFrame:
    """(path, row_id, grp, label, values) of .dat files: `#` and `[..]` lines are comments, `{Group}` names the rows after it, the first cell is the label."""
    x = lines(spark, path).where(~F.col("line").rlike(r"^\s*(#.*|\[.*\]\s*)?$"))
    named = x.withColumn("grp", F.last(F.nullif(F.regexp_extract("line", r"^\s*\{(.*)\}\s*$", 1), F.lit("")), ignorenulls=True).over(W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)))
    cells = F.split("line", sep)
    rows = named.where(~F.col("line").rlike(r"^\s*\{.*\}\s*$"))
    return rows.select("path", F.col("line_no").alias("row_id"), "grp", F.trim(cells[0]).alias("label"), F.transform(F.slice(cells, 2, F.size(cells) - 1), lambda c: number(c, decimal)).alias("values"))


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """(path, specimen, id, scale, lm, coords) of .tps files: `LM=` begins a specimen, its coordinates follow; a scale multiplies them."""
    x = lines(spark, path).where(F.trim("line") != "")
    key, value = F.upper(F.trim(F.regexp_extract("line", r"^\s*(\w+)\s*=", 1))), F.trim(F.regexp_extract("line", r"=(.*)$", 1))
    x = x.select("path", "line_no", "line", F.nullif(key, F.lit("")).alias("key"), value.alias("value"))
    begins = F.col("key").isin("LM", "LM3")
    x = x.withColumn("specimen", F.sum(F.coalesce(begins.cast("int"), F.lit(0))).over(W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow))).where("specimen > 0")
    about = x.where(F.col("key").isNotNull()).groupBy("path", "specimen").agg(F.max(F.when(F.col("key") == "ID", F.col("value"))).alias("id"), F.max(F.when(F.col("key") == "SCALE", F.col("value").try_cast("double"))).alias("scale"), F.max(F.when(begins, F.col("value").cast("int"))).alias("n"))
    points = x.where(F.col("key").isNull()).select("path", "specimen", F.row_number().over(W.partitionBy("path", "specimen").orderBy("line_no")).alias("lm"), F.transform(F.split(F.trim("line"), r"\s+"), lambda c: c.try_cast("double")).alias("coords"))
    s = points.join(about, ["path", "specimen"]).where(F.col("lm") <= F.col("n"))
    return s.select("path", "specimen", "id", "scale", "lm", F.transform("coords", lambda c: c * F.coalesce("scale", F.lit(1.0))).alias("coords"))


def read_columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """White-space separated columns of numbers with `#` comments, in file order (row_id)."""
    x = lines(spark, path).where(~F.col("line").rlike(r"^\s*(#.*)?$"))
    cells = F.split(F.trim("line"), r"\s+")
    return x.select("path", F.col("line_no").alias("row_id"), *(number(F.get(cells, F.lit(k))).alias(n) for k, n in enumerate(names)))


def newick_nodes(text: str) -> list[tuple[int, int | None, str | None, float | None]]:
    """(node, parent, name, length) in order of opening; quoted names keep their signs, [..] comments are skipped (nested ones too)."""
    nodes: list[list] = [[0, None, None, None]]
    here, at = 0, 0
    while at < len(text):
        c = text[at]
        if c == "[":
            depth = 0
            while True:
                if at == len(text):
                    raise ValueError("a comment is not closed")
                depth += {"[": 1, "]": -1}.get(text[at], 0)
                at += 1
                if not depth:
                    break
        elif c == "(":
            nodes.append([len(nodes), here, None, None])
            here, at = len(nodes) - 1, at + 1
        elif c in "),":
            if nodes[here][1] is None:
                raise ValueError("brackets do not match")
            here = nodes[here][1]
            at += 1
            if c == ",":
                nodes.append([len(nodes), here, None, None])
                here = len(nodes) - 1
        elif c == ";":
            break
        elif c == "'":
            end, name = at + 1, ""
            while True:
                stop = text.index("'", end)
                name += text[end:stop]
                end = stop + 1
                if text[end : end + 1] != "'":
                    break
                name, end = name + "'", end + 1
            nodes[here][2], at = name, end
        else:
            end = at
            while end < len(text) and text[end] not in "(),:;[":
                end += 1
            if c == ":":
                end = at + 1
                while end < len(text) and text[end] not in "(),;[":
                    end += 1
                nodes[here][3] = float(text[at + 1 : end])
            elif name := text[at:end].strip():
                nodes[here][2] = name.replace("_", " ")
            at = max(end, at + 1)
    if here:
        raise ValueError("brackets do not match")
    return [tuple(n) for n in nodes]


def parse_newick(trees: DataFrame, tree_id: str, text: str) -> DataFrame:
    """(tree_id, node_id, parent_id, name, length) of every tree; a tree that cannot be read has one row with its error."""

    def run(batches):
        for b in batches:
            rows = []
            for key, t in zip(b["tree_id"], b["text"]):
                try:
                    rows += [(key, *n, None) for n in newick_nodes(t or "")]
                except ValueError as e:
                    rows.append((key, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["tree_id", "node_id", "parent_id", "name", "length", "error"])

    return trees.select(F.col(tree_id).cast("string").alias("tree_id"), F.col(text).cast("string").alias("text")).mapInPandas(run, "tree_id string, node_id long, parent_id long, name string, length double, error string")
