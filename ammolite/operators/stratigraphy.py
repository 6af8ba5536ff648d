"""Occurrences with age intervals, time bins, range-through counts and range extensions. Ages grow into the past.

Bins are a small table (a time scale): Spark broadcasts it while it is, no hint forces it. Everything else is grouped before it is joined.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions.columns import two_groups
from ammolite.functions.scans import running_sums


def bin_time(occurrences: DataFrame, bins: DataFrame, method: str = "mid") -> DataFrame:
    """Assign occurrences (taxon, min_ma, max_ma) to bins (bin, min_ma, max_ma).

    mid: the bin that holds the midpoint strictly inside, null on a boundary or outside; all: a row for each bin that the
    interval overlaps; majority: the bin that holds most of the interval, the first of equals.
    """
    o = occurrences.select(F.monotonically_increasing_id().alias("id"), "taxon", "min_ma", "max_ma")
    b = bins.select("bin", F.col("min_ma").alias("lo"), F.col("max_ma").alias("hi"))
    if method == "mid":
        mid = (F.col("min_ma") + F.col("max_ma")) / 2
        return o.join(b, (mid > F.col("lo")) & (mid < F.col("hi")), "left").select("taxon", "min_ma", "max_ma", "bin")
    both = o.join(b, (F.col("min_ma") < F.col("hi")) & (F.col("max_ma") > F.col("lo")))
    if method == "all":
        return both.select("taxon", "min_ma", "max_ma", "bin")
    share = F.least("max_ma", "hi") - F.greatest("min_ma", "lo")
    best = both.groupBy("id").agg(F.first("taxon").alias("taxon"), F.first("min_ma").alias("min_ma"), F.first("max_ma").alias("max_ma"), F.min_by("bin", F.struct(-share, F.col("bin"))).alias("bin"))
    return best.drop("id")


def ranges(occurrences: DataFrame) -> DataFrame:
    """First and last appearance of each taxon."""
    return occurrences.groupBy("taxon").agg(F.min("min_ma").alias("min_ma"), F.max("max_ma").alias("max_ma"), F.count("*").alias("n"))


def range_through(taxa: DataFrame, bins: DataFrame) -> DataFrame:
    """Richness, originations and extinctions by bin; overlap is strict at both ends, a last appearance at 0 is no extinction."""
    b = bins.select("bin", F.col("min_ma").alias("lo"), F.col("max_ma").alias("hi"))
    inside = taxa.select("taxon", "min_ma", "max_ma").join(b, (F.col("min_ma") < F.col("hi")) & (F.col("max_ma") > F.col("lo")))
    # bins that an interval overlaps run on, so the oldest and the youngest of them are its first and last
    w = W.partitionBy("taxon")
    s = inside.select("bin", (F.max("hi").over(w) == F.col("hi")).alias("first"), ((F.min("lo").over(w) == F.col("lo")) & (F.col("min_ma") > 0)).alias("last"))
    counted = s.groupBy("bin").agg(F.count("*").alias("richness"), F.count_if("first").alias("origination"), F.count_if("last").alias("extinction"))
    return b.select("bin").join(counted, "bin", "left").fillna(0, ["richness", "origination", "extinction"])


def strauss_sadler(taxa: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Extension of each range at the given confidence: range * ((1 - c)^(-1 / (n - 1)) - 1); null for a single occurrence."""
    r = F.col("max_ma") - F.col("min_ma")
    gap = r * (F.pow(F.lit(1 - confidence), -1 / (F.col("n") - 1)) - 1)
    return taxa.select("taxon", "n", F.round(r, 6).alias("range"), F.when(F.col("n") > 1, F.round(gap, 6)).alias("extension"))


def depth_to_time(x: DataFrame, anchors: DataFrame) -> DataFrame:
    """Ages of depths, linear between anchors (depth, age), beyond them by the end segments."""
    w = W.orderBy("depth")
    a = anchors.select(F.col("depth").alias("d0"), F.col("age").alias("a0"), F.lead("depth").over(w).alias("d1"), F.lead("age").over(w).alias("a1"), F.row_number().over(w).alias("k")).where("d1 is not null")
    n = a.agg(F.max("k").alias("n"))
    seg = a.join(n)
    here = ((F.col("k") == 1) | (F.col("depth") >= F.col("d0"))) & ((F.col("k") == F.col("n")) | (F.col("depth") < F.col("d1")))
    return x.join(seg, here).select("depth", F.round(F.col("a0") + (F.col("depth") - F.col("d0")) / (F.col("d1") - F.col("d0")) * (F.col("a1") - F.col("a0")), 6).alias("age"))


def day_numbers(df: DataFrame, date: str) -> DataFrame:
    """Proleptic ordinal day, day of the year and Julian day number (at noon) of distinct dates."""
    d = df.where(F.col(date).isNotNull()).select(F.col(date).cast("date").alias("d")).distinct()
    n = F.date_diff("d", F.lit("1970-01-01").cast("date"))
    return d.select(F.date_format("d", "yyyy-MM-dd").alias("d"), (n + 719163).alias("ordinal"), F.dayofyear("d").alias("day_of_year"), (n + 2440588).alias("julian_day"))


def log_rank(df: DataFrame, group: str, time: str, event, groups: tuple | None = None) -> DataFrame:
    """Observed and expected events of the first of two groups, which must be named where there are more, the variance and chi-square."""
    x = two_groups(df.where(F.col(time).isNotNull()).select(F.col(group).alias("grp"), F.col(time).alias("t"), event.alias("e")), groups)
    c = x.groupBy("t").agg(F.count("*").alias("n"), F.count_if(F.col("k") == 1).alias("n1"), F.count_if("e").alias("d"), F.count_if(F.col("e") & (F.col("k") == 1)).alias("d1"))
    later = running_sums(c, (F.desc("t"),), r="n", r1="n1")
    r = later.select("d", "d1", F.col("r").cast("double").alias("r"), F.col("r1").cast("double").alias("r1")).where("d > 0")
    var = F.when(F.col("r") > 1, F.col("d") * (F.col("r1") / F.col("r")) * (1 - F.col("r1") / F.col("r")) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    s = r.agg(F.sum("d1").alias("observed"), F.sum(F.col("d") * F.col("r1") / F.col("r")).alias("e"), F.sum(var).alias("v"))
    return s.select("observed", F.round("e", 5).alias("expected"), F.round("v", 5).alias("variance"), F.round((F.col("observed") - F.col("e")) * (F.col("observed") - F.col("e")) / F.col("v"), 5).alias("chi2"))


def tax_expand_time(taxa: DataFrame, bins: DataFrame) -> DataFrame:
    """A row for each bin that a range (taxon, min_ma, max_ma) strictly overlaps: whether it originates there, and whether it ends there (never at 0)."""
    b = bins.select("bin", F.col("min_ma").alias("lo"), F.col("max_ma").alias("hi"))
    x = taxa.select("taxon", "min_ma", "max_ma").join(b, (F.col("min_ma") < F.col("hi")) & (F.col("max_ma") > F.col("lo")))
    return x.select("taxon", "min_ma", "max_ma", "bin", (F.col("max_ma") <= F.col("hi")).alias("orig"), ((F.col("min_ma") >= F.col("lo")) & (F.col("min_ma") > 0)).alias("ext"))


def interval_count(binned: DataFrame, bins: DataFrame) -> DataFrame:
    """Distinct taxa of each bin; empty bins have 0."""
    c = binned.groupBy("bin").agg(F.count_distinct("taxon").alias("taxa"))
    return bins.select("bin").join(c, "bin", "left").select("bin", F.coalesce("taxa", F.lit(0)).cast("long").alias("taxa"))


def diversity_dynamics(taxa: DataFrame, bins: DataFrame) -> DataFrame:
    """Richness and per-capita rates by bin, numbered from the youngest: origination from the taxa shared with the next older bin, extinction from those shared with the next younger.

    A rate is infinite where nothing is shared and null where there is no neighbour or no taxon. `bins` is a few rows.
    """
    b = bins.select("bin", F.col("min_ma").alias("lo"), F.col("max_ma").alias("hi"), F.row_number().over(W.orderBy("min_ma")).alias("k"))
    x = taxa.select("taxon", "min_ma", "max_ma").join(b, (F.col("min_ma") < F.col("hi")) & (F.col("max_ma") > F.col("lo"))).select("taxon", "k")
    w = W.partitionBy("taxon").orderBy("k")
    s = x.select("k", (F.lead("k").over(w) == F.col("k") + 1).alias("older"), (F.lag("k").over(w) == F.col("k") - 1).alias("younger")).groupBy("k").agg(F.count("*").alias("n"), F.count_if("older").alias("o"), F.count_if("younger").alias("y"))
    last = b.agg(F.max("k").alias("last"))
    t = b.join(s, "k", "left").join(last).na.fill(0, ["n", "o", "y"])
    rate = lambda shared, has: F.when(has & (F.col("n") > 0), F.when(F.col(shared) > 0, F.abs(F.log(F.col(shared) / F.col("n"))) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(float("inf"))))
    return t.select("bin", ((F.col("lo") + F.col("hi")) / 2).alias("t"), F.col("n").alias("richness"), F.round(rate("o", F.col("k") < F.col("last")), 8).alias("origination_rate"), F.round(rate("y", F.col("k") > 1), 8).alias("extinction_rate"))


def exponential_growth(dynamics: DataFrame) -> DataFrame:
    """Rate and start of exponential growth: the line of the logarithm of richness (plus 1e-10) over t."""
    y = F.log(F.col("richness") + 1e-10)
    return dynamics.agg(F.count("*").alias("n"), F.round(F.regr_slope(y, F.col("t")), 8).alias("rate"), F.round(F.exp(F.regr_intercept(y, F.col("t"))), 4).alias("start"))


def cohorts(taxa: DataFrame, bins: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """Of the taxa that originate in each bin, those that survive it: share, Wilson's interval, -ln(1 - p) / dt and -ln(p) / dt. Bins without originations are left out."""
    b = bins.select("bin", F.col("min_ma").alias("lo"), F.col("max_ma").alias("hi"))
    c = taxa.select("min_ma", "max_ma").join(b, (F.col("max_ma") > F.col("lo")) & (F.col("max_ma") <= F.col("hi"))).groupBy("bin", "lo", "hi").agg(F.count("*").alias("total"), F.count_if(F.col("min_ma") < F.col("lo")).alias("survivors"))
    p, n, dt = F.col("survivors") / F.col("total"), F.col("total").cast("double"), F.col("hi") - F.col("lo")
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    end = lambda s: F.round((p + z * z / (2 * n) + s * half) / (1 + z * z / n), 6)
    rate = lambda q: F.round(F.when(q > 0, F.abs(F.log(q)) / dt).otherwise(F.lit(float("inf"))), 8)
    return c.select("bin", "total", "survivors", F.round(p, 6).alias("survival"), end(-1).alias("low"), end(1).alias("high"), rate(1 - p).alias("origination_rate"), rate(p).alias("extinction_rate"))


def extinction_intervals(taxa: DataFrame, detection: float | None, confidence: float = 0.95) -> DataFrame:
    """Interval in which each last appearance (taxon, lad; larger is older) may truly end: [max(0, lad - gap), lad].

    With a detection probability the gap is -ln(q) / -ln(1 - p), q = 1 - confidence; without one it is the distance to the
    next younger last appearance times (q^(-1/2) - 1) / 2, and 0 for the youngest.
    """
    q = 1 - confidence
    if detection is not None:
        gapped = taxa.withColumn("gap", F.lit(math.log(q) / math.log(1 - detection)))
    else:
        steps = taxa.select("lad").distinct().select("lad", (F.col("lad") - F.lag("lad").over(W.orderBy("lad"))).alias("step"))
        gapped = taxa.join(steps, "lad").withColumn("gap", F.coalesce("step", F.lit(0.0)) * (q**-0.5 - 1) / 2)
    return gapped.select("taxon", "lad", F.round(F.greatest(F.lit(0.0), F.col("lad") - F.col("gap")), 6).alias("low"), F.col("lad").alias("high"))


def filter_endemics(occurrences: DataFrame, least: int = 2) -> DataFrame:
    """Taxa found in at least `least` sections (taxon, section); where none are, the most widespread ones stay."""
    s = occurrences.groupBy("taxon").agg(F.count_distinct("section").alias("sections"), F.count("*").alias("n"))
    most = s.agg(F.max("sections").alias("most"))
    return s.join(F.broadcast(most)).where(F.col("sections") >= F.least(F.lit(least), F.col("most"))).select("taxon", "sections", "n")
