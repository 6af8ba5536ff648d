"""The data behind plots: what is drawn, as rows. Drawing itself is not done here.

Missing values (null, NaN) are dropped first; groups may be null. Where a plot depends on an order, a column gives it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions.columns import long_form, missing


def _points(df: DataFrame, keep: dict[str, str | Column], **values: str | Column) -> DataFrame:
    x = df.select(*((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in keep.items()), *(missing(c).alias(n) for n, c in values.items()))
    return x.dropna(subset=list(values))


def xy_plot(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Least-squares line of each group, with its count and ranges: the line's two ends."""
    p = _points(df, {"grp": group}, x=x, y=y)
    g = p.groupBy("grp").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.min("x").alias("x_min"), F.max("x").alias("x_max"))
    end = lambda c: F.round(F.col("intercept") + F.col("slope") * F.col(c), 4)
    return g.select("grp", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "x_min", "x_max", end("x_min").alias("y_at_min"), end("x_max").alias("y_at_max"))


def xy_error_bars(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Means of x and y of each group with the standard errors that make its bars."""
    p = _points(df, {"grp": group}, x=x, y=y)
    se = lambda c: F.stddev_samp(c) / F.sqrt(F.count("*"))
    return p.groupBy("grp").agg(F.round(F.avg("x"), 4).alias("x"), F.round(F.avg("y"), 4).alias("y"), F.round(se("x"), 4).alias("x_error"), F.round(se("y"), 4).alias("y_error"))


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Counts and densities of equal-width bins from the least to the greatest value; the last bin is closed, empty bins are kept.

    If all values are equal, the bins span half a unit to either side.
    """
    x = df.select(missing(value).alias("v")).where("v is not null")
    ends = x.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n")).where("n > 0")
    ends = ends.select("n", F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("lo"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    # the extremes are one row, so this join only adds columns
    counts = x.join(F.broadcast(ends)).groupBy(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width)).cast("int").alias("bin")).agg(F.count("*").alias("c"))
    grid = ends.select("n", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, "bin", "left").withColumn("count", F.coalesce("c", F.lit(0)).cast("long"))
    return out.select("bin", F.round(F.col("lo") + F.col("bin") * width, 6).alias("lower"), F.round(F.col("lo") + (F.col("bin") + 1) * width, 6).alias("upper"), "count", F.round(F.col("count") / (F.col("n") * width), 9).alias("density"))


def bar_chart(df: DataFrame, category: str, value: str | None = None) -> DataFrame:
    """Sum of the values of each category, or how often each category comes where no value is given."""
    if value is None:
        return df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).agg(F.count("*").cast("double").alias("total"))
    return long_form(df, category, value).groupBy(F.col("grp").alias("category")).agg(F.round(F.sum("v"), 2).alias("total"))


def _quartiles(x: DataFrame) -> DataFrame:
    return x.groupBy("grp").agg(F.count("v").alias("n"), F.expr("percentile(v, array(0.25, 0.5, 0.75))").alias("q")).select("grp", "n", *(F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))))


def box_plot(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers (the outermost values within 1.5 IQR of the box) and outliers of each group of two values or more."""
    x = long_form(df, group, value)
    q = _quartiles(x).where("n >= 2").withColumn("lo", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("hi", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    q = q.withColumnRenamed("grp", "g")
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    w = x.join(q, F.col("grp").eqNullSafe(F.col("g"))).groupBy("grp", "n", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"), F.count_if(~inside).alias("outliers"))
    return w.select("grp", "n", *(F.round(c, 4).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")), "outliers")


def percentiles(df: DataFrame, group: str, value: str, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(grp, share, value): the asked percentiles of each group, interpolated linearly."""
    p = long_form(df, group, value).groupBy("grp").agg(F.expr(f"percentile(v, array({', '.join(map(str, shares))}))").alias("q"))
    return p.select("grp", F.posexplode("q").alias("i", "value")).select("grp", F.element_at(F.array(*map(F.lit, shares)), F.col("i") + 1).alias("share"), F.round("value", 4).alias("value"))


def pie_chart(df: DataFrame, category: str, value: str) -> DataFrame:
    """Each category's sum and share of the whole; a negative sum is an error in the caller's data: its share is null."""
    t = long_form(df, category, value).groupBy(F.col("grp").alias("category")).agg(F.sum("v").alias("s"))
    whole = t.agg(F.sum("s").alias("whole"))
    return t.join(F.broadcast(whole)).select("category", F.round("s", 2).alias("total"), F.when(F.col("s") >= 0, F.round(F.col("s") / F.col("whole"), 6)).alias("share"))


def _cells(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    x = df.select(F.col(row).alias("r"), F.col(column).alias("c"), missing(value).alias("v")).where("v is not null")
    return x.groupBy("r", "c").agg(F.sum("v").alias("v"))


def stacked_chart(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Cells of a matrix as shares of their row in percent, and where each starts on the row's bar. A row that sums to 0 has null shares."""
    w = W.partitionBy("r")
    x = _cells(df, row, column, value).withColumn("percent", F.col("v") / F.nullif(F.sum("v").over(w), F.lit(0.0)) * 100)
    start = F.sum("percent").over(w.orderBy("c").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("percent")
    return x.select("r", "c", F.round("v", 2).alias("value"), F.round("percent", 6).alias("percent"), F.abs(F.round(start, 6)).alias("start"))


def matrix_plot(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Cells of a matrix with their value scaled to 0..1 over all cells."""
    x = _cells(df, row, column, value)
    ends = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return x.join(F.broadcast(ends)).select("r", "c", F.round("v", 2).alias("value"), F.round((F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), 6).alias("scaled"))


def surface_plot(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Grid points (i, j, z): rows and columns numbered in order from 0, cells without a value left out."""
    x = _cells(df, row, column, value)
    number = lambda c, n: x.select(c).distinct().select(c, (F.row_number().over(W.orderBy(c)) - 1).alias(n))
    return x.join(number("r", "i"), "r").join(number("c", "j"), "c").select("i", "j", F.round("v", 2).alias("z"))


def mosaic_plot(df: DataFrame, row: str, column: str) -> DataFrame:
    """Rectangles of a table of counts: a row's height is its share of all; a cell's width is its share of its column, side by side along the row."""
    x = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count("*").alias("o"))
    rows, cols, whole = x.groupBy("r").agg(F.sum("o").alias("rt")), x.groupBy("c").agg(F.sum("o").alias("ct")), x.agg(F.sum("o").alias("n"))
    y = x.join(rows, "r").join(cols, "c").join(F.broadcast(whole)).withColumn("w", F.col("o") / F.col("ct"))
    left = F.sum("w").over(W.partitionBy("r").orderBy("c").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("w")
    return y.select("r", "c", F.col("o").alias("count"), F.round(F.col("rt") / F.col("n"), 6).alias("height"), F.abs(F.round(left, 6)).alias("x"), F.round("w", 6).alias("width"))


def venn_diagram(df: DataFrame, key: str, **sets: Column) -> DataFrame:
    """How many distinct keys lie in each region of two or three sets, given as conditions on rows; empty regions are left out."""
    flags = df.groupBy(F.col(key)).agg(*(F.max(c.cast("int")).alias(n) for n, c in sets.items()))
    region = F.concat_ws("+", *(F.when(F.col(n) == 1, F.lit(n)) for n in sets))
    return flags.groupBy(region.alias("region")).agg(F.count("*").alias("keys")).where("region != ''")


def ternary_plot(df: DataFrame, key: str, a: str | Column, b: str | Column, c: str | Column) -> DataFrame:
    """Places in the triangle of points with three parts; parts that sum to 0 have none."""
    p = _points(df, {"key": key}, a=a, b=b, c=c)
    s = F.col("a") + F.col("b") + F.col("c")
    return p.where(s != 0).select("key", F.round(F.col("b") / s + 0.5 * F.col("c") / s, 6).alias("x"), F.round(F.col("c") / s * math.sqrt(3.0) / 2.0, 6).alias("y"))


def bubble_plot(df: DataFrame, key: str, x: str, y: str, size: str) -> DataFrame:
    """Points with areas from 0 to 1: the size over the largest size."""
    p = _points(df, {"key": key}, x=x, y=y, s=size)
    most = p.agg(F.max("s").alias("most"))
    return p.join(F.broadcast(most)).select("key", "x", "y", F.round(F.col("s") / F.col("most"), 6).alias("area"))


def radar_chart(df: DataFrame, row: str, axis: str, value: str) -> DataFrame:
    """Corners of each row's polygon: axes in order at even angles from 0, with plane coordinates."""
    x = _cells(df, row, axis, value).select("r", F.col("c").alias("axis"), "v")
    axes = x.select("axis").distinct()
    place = axes.select("axis", (F.row_number().over(W.orderBy("axis")) - 1).alias("k")).join(F.broadcast(axes.agg(F.count("*").alias("n"))))
    angle = 2 * math.pi * F.col("k") / F.col("n")
    return x.join(place, "axis").select("r", "axis", F.round(angle, 6).alias("angle"), F.round("v", 2).alias("radius"), F.round(F.col("v") * F.cos(angle), 2).alias("x"), F.round(F.col("v") * F.sin(angle), 2).alias("y"))


def polar_plot(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Values of each group at even angles, in the order given."""
    w = W.partitionBy("grp")
    p = _points(df, {"grp": group, "key": order}, v=value).withColumn("k", F.row_number().over(w.orderBy("key")) - 1).withColumn("n", F.count("*").over(w))
    return p.select("grp", "key", F.round(2 * math.pi * F.col("k") / F.col("n"), 6).alias("angle"), F.round("v", 4).alias("radius"))


def vector_plot(df: DataFrame, key: str, x: str, y: str, u: str | Column, v: str | Column) -> DataFrame:
    """Arrows scaled so that the longest is a quarter of the larger span of the positions."""
    p = _points(df, {"key": key}, x=x, y=y, u=u, v=v)
    length = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    s = p.agg(F.max(length).alias("longest"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-12)).alias("span"))
    scale = F.when(F.col("longest") > 0, F.col("span") * 0.25 / F.col("longest")).otherwise(1.0)
    return p.join(F.broadcast(s)).select("key", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(F.col("u") * scale, 4).alias("u"), F.round(F.col("v") * scale, 4).alias("v"))


def network_plot(edges: DataFrame, source: str, target: str, weight: str) -> DataFrame:
    """Edges between nodes numbered from 0 with both ends on the unit circle and a line width of 0.8 to 3.8 by weight. Weights of repeated edges add up."""
    e = edges.groupBy(F.col(source).cast("long").alias("source"), F.col(target).cast("long").alias("target")).agg(F.sum(missing(weight)).alias("w"))
    s = e.agg((F.max(F.greatest("source", "target")) + 1).alias("n"), F.max("w").alias("most"))
    angle = lambda c: 2 * math.pi * F.col(c) / F.col("n")
    at = lambda c: (F.round(F.cos(angle(c)), 6).alias(f"{c}_x"), F.round(F.sin(angle(c)), 6).alias(f"{c}_y"))
    return e.join(F.broadcast(s)).select("source", "target", *at("source"), *at("target"), F.round(F.when(F.col("most") > 0, 0.8 + 3.0 * F.col("w") / F.col("most")).otherwise(1.5), 6).alias("width"))


def plot_3d(df: DataFrame, key: str, x: str | Column, y: str | Column, z: str | Column) -> DataFrame:
    """Points that have all three coordinates."""
    return _points(df, {"key": key}, x=x, y=y, z=z)
