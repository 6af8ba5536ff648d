"""Row numbers and running sums over a whole table, without one task that sees all rows.

Rows are range-partitioned in the wanted order and written; partitions know their sizes and sums, one row each, and what
lies before a partition is added to what is counted inside it. Equal rows may come in any order among themselves, so an
order that decides results should end in a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions.storage import cut


def _dealt(df: DataFrame, order: tuple) -> DataFrame:
    """`df` by ranges of the order, with _part and _at: partition and place, both ascending in the order."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return cut(placed, "ranges").withColumn("_part", F.shiftright("_at", 33))


def numbered(df: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """`df` with the place of each row in the order, from 0."""
    placed = _dealt(df, order)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    found = placed.join(F.broadcast(sizes.select("_part", "_first", "_before")), "_part")
    return found.withColumn(name, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def running_sums(df: DataFrame, order: tuple, **sums: str | Column) -> DataFrame:
    """`df` with, for each name, the sum of a column over this row and all before it in the order."""
    held = df.withColumns({f"_v_{k}": (F.col(c) if isinstance(c, str) else c) for k, c in sums.items()})
    placed = _dealt(held, order)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row a partition
    totals = placed.groupBy("_part").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums))
    inside = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = placed.withColumns({f"_s_{k}": F.sum(f"_v_{k}").over(inside) for k in sums}).join(F.broadcast(totals), "_part")
    out = out.withColumns({k: F.coalesce(F.col(f"_s_{k}"), F.lit(0)) + F.col(f"_b_{k}") for k in sums})
    return out.drop("_part", "_at", *(f"_{p}_{k}" for k in sums for p in "vsb"))
