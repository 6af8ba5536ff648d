"""Transforms, imputation and matrices over the canonical long form cell(row_id, var, value). Missing is null (NaN becomes null)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions.columns import missing


def _row():
    return W.partitionBy("row_id")


def _var():
    return W.partitionBy("var")


def melt(df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Wide to long: a row for every cell, one pass, no shuffle."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("var"), missing(c).alias("value")) for c in columns)))
    return df.select(F.col(row_id).alias("row_id"), cells.alias("c")).select("row_id", "c.var", "c.value")


def spread(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Long to wide. Naming the columns saves the pass that would find them."""
    return cells.groupBy("row_id").pivot("var", columns).agg(F.first("value", ignorenulls=True))


def log_transform(cells: DataFrame, base: float = 10.0, offset: float = 1.0) -> DataFrame:
    """log of value + offset; null where that is not positive."""
    x = F.col("value") + offset
    return cells.select("row_id", "var", F.round(F.when(x > 0, F.log(x) / F.log(F.lit(base))), 6).alias("value"))


def sqrt_transform(cells: DataFrame) -> DataFrame:
    """Square root; null for negative values."""
    return cells.select("row_id", "var", F.round(F.when(F.col("value") >= 0, F.sqrt("value")), 6).alias("value"))


def zscore(cells: DataFrame) -> DataFrame:
    """By variable with n - 1; a constant variable is left as it is."""
    sd = F.stddev_samp("value").over(_var())
    return cells.select("row_id", "var", F.round(F.when(sd > 0, (F.col("value") - F.avg("value").over(_var())) / sd).otherwise(F.col("value")), 6).alias("value"))


def percent(cells: DataFrame, by: str = "row_id") -> DataFrame:
    """Share of the row's or the variable's total, in percent; a total of 0 counts as 1."""
    t = F.sum("value").over(W.partitionBy(by))
    return cells.select("row_id", "var", F.round(100 * F.col("value") / F.when(t == 0, 1.0).otherwise(t), 6).alias("value"))


def hellinger(cells: DataFrame) -> DataFrame:
    """Square root of the share of the row's total."""
    t = F.sum("value").over(_row())
    return cells.select("row_id", "var", F.round(F.sqrt(F.col("value") / F.when(t == 0, 1.0).otherwise(t)), 6).alias("value"))


def wisconsin(cells: DataFrame) -> DataFrame:
    """By the variable's maximum, then by the row's total."""
    m = F.max("value").over(_var())
    x = cells.select("row_id", "var", (F.col("value") / F.when(m == 0, 1.0).otherwise(m)).alias("value"))
    t = F.sum("value").over(_row())
    return x.select("row_id", "var", F.round(F.col("value") / F.when(t == 0, 1.0).otherwise(t), 6).alias("value"))


def impute(cells: DataFrame, how: str = "mean") -> DataFrame:
    """Fill missing cells with the variable's mean or median; a variable that is missing throughout stays so."""
    fill = F.avg("value") if how == "mean" else F.expr("percentile(value, 0.5)")
    f = cells.groupBy("var").agg(fill.alias("f"))
    return cells.join(f, "var").select("row_id", "var", F.round(F.coalesce("value", "f"), 6).alias("value"))


def missing_info(cells: DataFrame) -> DataFrame:
    """Missing and present cells by variable, with mean, sd and sum."""
    return cells.groupBy("var").agg(F.count_if(F.col("value").isNull()).alias("n_missing"), F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("sd"), F.round(F.sum("value"), 2).alias("total"))


def complete_rows(cells: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Rows with at most int(threshold * variables) missing cells, and how many."""
    x = cells.groupBy("row_id").agg(F.count("*").alias("p"), F.count_if(F.col("value").isNull()).alias("n_missing"))
    return x.where(F.col("n_missing") <= F.floor(F.col("p") * threshold)).select("row_id", "n_missing")


def varying(cells: DataFrame, least: float = 1e-10) -> DataFrame:
    """Variables to keep: population variance over `least`, or fewer than two values."""
    return cells.groupBy("var").agg(F.count("value").alias("n"), F.var_pop("value").alias("v")).where((F.col("n") < 2) | (F.col("v") > least)).select("var")


def covariance(df: DataFrame, columns: list[str]) -> DataFrame:
    """Covariance (n - 1) and correlation of every pair of columns, in one aggregate over the wide rows: no join of rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = [(missing(a), missing(b)) for a, b in pairs]
    one = df.agg(*(F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(both)), *(F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(both)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("c"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("x")).select("x.a", "x.b", (F.round("x.c", 4) + 0.0).alias("covariance"), (F.round("x.r", 6) + 0.0).alias("correlation"))


def effect_sizes(df: DataFrame, group: str, value: str) -> DataFrame:
    """Eta squared and omega squared of a grouping."""
    g = df.select(F.col(group).alias("g"), missing(value).alias("v")).where("v is not null").groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2"))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("s2")).alias("ssw"))
    ssb, dfb, dfw = F.col("q") - F.col("n") * F.col("gm") * F.col("gm"), F.col("k") - 1, F.col("n") - F.col("k")
    f = (ssb / dfb) / (F.col("ssw") / dfw)
    omega = (f * dfb - dfb) / (f * dfb + dfw + 1)
    return t.select(F.round(ssb / (ssb + F.col("ssw")), 8).alias("eta_squared"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), omega)), 8).alias("omega_squared"))
