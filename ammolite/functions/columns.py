"""Column helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions.scans import running_sums


def missing(column: str | Column) -> Column:
    """NaN and null as null: aggregates then skip both."""
    c = F.col(column) if isinstance(column, str) else column
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def rounded(column: str | Column, digits: int) -> Column:
    """Half away from zero of the product with 10 ** digits, as the registered SQL rounds; `round` takes the shortest decimal of the number and turns other ties up."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c * 10.0**digits) / 10.0**digits


def ratio(up: Column, down: Column) -> Column:
    """up / down of doubles where a zero divisor gives an infinity of the sign of `up`, or NaN for 0 / 0, instead of an error."""
    return F.when(down != 0, up / F.nullif(down, F.lit(0.0))).when(down == 0, F.signum(up) * F.lit(float("inf")))


def long_form(df: DataFrame, group: str | Column, value: str | Column, names: tuple[str, str] = ("grp", "v")) -> DataFrame:
    """(grp, v) rows with a value; other columns are dropped first, so names can't clash."""
    g = F.col(group) if isinstance(group, str) else group
    return df.select(g.alias(names[0]), missing(value).alias(names[1])).where(F.col(names[1]).isNotNull())


def two_groups(x: DataFrame, groups: tuple | None = None) -> DataFrame:
    """Rows of two groups (grp) with k, 1 or 2: of those named, or of the only two that there are, in order; with more than two they must be named."""
    found = list(groups) if groups else [r.grp for r in x.where("grp is not null").select("grp").distinct().orderBy("grp").limit(3).collect()]
    if len(found) > 2:
        raise ValueError("more than two groups: name the two to compare")
    return x.where(F.col("grp").isin(found)).withColumn("k", F.when(F.col("grp") == F.lit(found[0] if found else None), 1).otherwise(2))


def average_ranks(df: DataFrame, value: str = "v", within: str | None = None) -> DataFrame:
    """`df` with avg_rank (ties share the mean of their ranks) and n_ties.

    Equal values are counted first and ranked as distinct values, one row each; without groups these are numbered range by range,
    so that no task sees all of them.
    """
    keys = [within] if within else []
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n_ties"))
    if within:
        before = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
        upto = counts.withColumn("_upto", F.sum("n_ties").over(before))
    else:
        upto = running_sums(counts, (value,), _upto="n_ties")
    return df.join(upto.withColumn("avg_rank", F.col("_upto") - (F.col("n_ties") - 1) / 2).drop("_upto"), [*keys, value])
