"""Tables as rows and columns: selection by place or label, transposition, sorting, scaling by row, and principal components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions.columns import missing
from ammolite.functions.scans import numbered


def subset_rows(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in `wanted` (key, place), numbered by the place asked for."""
    w = wanted.select(F.col("key").alias("_k"), "place")
    return df.join(w, F.col(key) == F.col("_k")).drop("_k")


def subset_columns(df: DataFrame, key: str, places: list[int]) -> DataFrame:
    """The key and the columns at the given places among the others, from 0."""
    rest = [c for c in df.columns if c != key]
    return df.select(key, *(rest[k] for k in places))


def get_row(df: DataFrame, key: str, label) -> DataFrame:
    """One row, by its label, as (var, value); all other columns must be numbers."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key) == label).select(F.explode(F.array(*(F.struct(F.lit(c).alias("var"), missing(c).alias("value")) for c in rest))).alias("x")).select("x.var", "x.value")


def transpose(cells: DataFrame) -> DataFrame:
    """Long cells (row_id, var, value) with rows and variables changed over: each variable a row of values by row_id."""
    return cells.select(F.col("var").alias("row_id"), F.col("row_id").cast("string").alias("var"), "value")


def row_summary(cells: DataFrame) -> DataFrame:
    """Mean, sum and missing cells of each row; missing ones don't count."""
    return cells.groupBy("row_id").agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 4).alias("total"))


def complete_columns(cells: DataFrame) -> DataFrame:
    """Cells of the variables that miss no value."""
    full = cells.groupBy("var").agg(F.count_if(F.col("value").isNull()).alias("gaps")).where("gaps = 0").select("var")
    return cells.join(full, "var").select("row_id", "var", F.round("value", 6).alias("value"))


def sort_rows(df: DataFrame, key: str, by: str, ascending: bool = True) -> DataFrame:
    """(key, value, place): places from 0 in a stable order; descending is the ascending order reversed, missing values come last in both. Rows are numbered range by range."""
    v = missing(by)
    order = [F.col("value").asc_nulls_last(), F.col(key).asc()] if ascending else [F.col("value").desc_nulls_last(), F.col(key).desc()]
    return numbered(df.select(key, v.alias("value")), *order)


def column_transform(cells: DataFrame, how: str) -> DataFrame:
    """log1p (null unless over -1), zscore and scale (population sd), center; by variable, missing cells stay."""
    w = W.partitionBy("var")
    v, sd = F.col("value"), F.stddev_pop("value").over(w)
    out = {"log1p": F.when(v > -1, F.log1p(v)), "zscore": F.when(sd > 0, (v - F.avg("value").over(w)) / sd), "scale": F.when(sd > 0, v / sd), "center": v - F.avg("value").over(w)}[how]
    return cells.select("row_id", "var", F.round(out, 6).alias("value"))


def standardize_rows(cells: DataFrame) -> DataFrame:
    """Each row centred and divided by its sd (n - 1); constant rows are only centred."""
    w = W.partitionBy("row_id")
    sd = F.stddev_samp("value").over(w)
    return cells.select("row_id", "var", F.round((F.col("value") - F.avg("value").over(w)) / F.when(sd > 0, sd).otherwise(1.0), 6).alias("value"))


def principal_components(df: DataFrame, key: str, columns: list[str], n: int = 2, standardize: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Eigenvalues with their shares, loadings (vector times sqrt of the eigenvalue), and scores.

    Covariances are one aggregate over the rows; only their matrix, as wide as there are columns, is decomposed on the
    driver. Missing values count as the column's mean. Signs: the largest weight of a component, the first of equal ones, is positive.
    """
    x = df.select(F.col(key).alias("key"), *(missing(c).alias(c) for c in columns))
    means = x.agg(*(F.avg(c).alias(c) for c in columns)).first()
    x = x.select("key", *((F.coalesce(F.col(c), F.lit(means[c])) - means[c]).alias(c) for c in columns))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    found = x.agg(F.count("*").alias("n"), *(F.sum(F.col(a) * F.col(b)).alias(f"{k}") for k, (a, b) in enumerate(pairs))).first()
    c = np.zeros((len(columns), len(columns)))
    for k, (a, b) in enumerate(pairs):
        i, j = columns.index(a), columns.index(b)
        c[i, j] = c[j, i] = (found[str(k)] or 0.0) / max(1, found["n"] - 1)
    sd = np.sqrt(np.diag(c))
    scale = np.where(sd > 0, sd, 1.0) if standardize else np.ones(len(columns))
    values, vectors = np.linalg.eigh(c / np.outer(scale, scale))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.round(np.abs(vectors), 9).argmax(0), np.arange(len(columns))])
    spark = df.sparkSession
    total = values.sum() or 1.0
    eigen = spark.createDataFrame([(k + 1, round(float(values[k]), 6), round(float(values[k] / total), 6)) for k in range(n)], "component int, eigenvalue double, share double")
    loads = spark.createDataFrame([(columns[i], k + 1, round(float(vectors[i, k] * np.sqrt(values[k])), 6) + 0.0) for k in range(n) for i in range(len(columns))], "var string, component int, loading double")
    score = lambda k: F.round(sum((F.col(c) * float(vectors[i, k] / scale[i]) for i, c in enumerate(columns)), F.lit(0.0)), 5) + 0.0
    return eigen, loads, x.select("key", *(score(k).alias(f"pc{k + 1}") for k in range(n)))
