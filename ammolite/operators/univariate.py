"""Statistics of one variable by group, in long form. Missing values (null, NaN) are skipped; groups may be null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions.columns import average_ranks, long_form, two_groups
from ammolite.functions.scans import running_sums


def summary_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """Count, moments, extremes and median of each group; sd and variance with n - 1, skewness and excess kurtosis of the population."""
    x = long_form(df, group, value)
    s = x.groupBy("grp").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), F.var_samp("v").alias("variance"), F.min("v").alias("minimum"), F.max("v").alias("maximum"),
        F.expr("percentile(v, 0.5)").alias("median"), F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"),
    )
    return s.select("grp", "n", *(F.round(c, 4).alias(c) for c in ("mean", "sd", "variance", "minimum", "maximum", "median", "skewness", "kurtosis")), F.round(F.col("sd") / F.sqrt("n"), 4).alias("se"))


def _group_moments(x: DataFrame) -> DataFrame:
    return x.groupBy("grp").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2"))


def one_way_anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """Sums of squares, degrees of freedom and F. Groups of fewer than two values are an error in the caller's data: F is null then."""
    g = _group_moments(long_form(df, group, value))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), F.sum(F.col("n") * F.col("s2")).alias("ssw"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nm2"), F.min("n").alias("least"))
    ssb = F.col("nm2") - F.col("n") * F.col("grand") * F.col("grand")
    f = (ssb / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))
    return t.select((F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"), F.round(ssb / F.col("ssw"), 6).alias("ss_ratio"), F.when((F.col("least") >= 2) & (F.col("ssw") > 0), F.round(f, 4)).alias("f"))


def two_sample_t(df: DataFrame, group: str, value: str, groups: tuple | None = None) -> DataFrame:
    """Pooled and Welch t between two groups, which must be named where there are more."""
    g = two_groups(_group_moments(long_form(df, group, value)), groups).withColumnRenamed("k", "rank")
    one = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c)))
    t = g.agg(*(one(c, k).alias(f"{c}{k}") for c in ("n", "m", "s2") for k in (1, 2)))
    v1, v2 = F.col("s21") * F.col("n1") / (F.col("n1") - 1), F.col("s22") * F.col("n2") / (F.col("n2") - 1)
    pooled = ((F.col("n1") - 1) * v1 + (F.col("n2") - 1) * v2) / (F.col("n1") + F.col("n2") - 2)
    diff = F.col("m1") - F.col("m2")
    return t.select("n1", "n2", F.round(diff / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))), 6).alias("t_pooled"), F.round(diff / F.sqrt(v1 / F.col("n1") + v2 / F.col("n2")), 6).alias("t_welch"))


def kruskal_wallis(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with the correction for ties, and its degrees of freedom."""
    r = average_ranks(long_form(df, group, value))
    g = r.groupBy("grp").agg(F.count("*").alias("n"), F.sum("avg_rank").alias("r"), F.sum(F.col("n_ties").cast("double") * F.col("n_ties") - 1).alias("ties"))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("r2"), F.sum("ties").alias("ties"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("r2") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return t.select((F.col("k") - 1).alias("df"), F.col("n"), F.round(h, 5).alias("h"))


def mann_whitney(df: DataFrame, group: str, value: str, groups: tuple | None = None) -> DataFrame:
    """U of two groups, which must be named where there are more, with the tie-corrected normal z (no continuity correction)."""
    r = average_ranks(two_groups(long_form(df, group, value), groups))
    g = r.groupBy("grp", "k").agg(F.count("*").alias("n"), F.sum("avg_rank").alias("r"), F.sum(F.col("n_ties").cast("double") * F.col("n_ties") - 1).alias("ties"))
    one = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))
    t = g.agg(one("n", 1).alias("n1"), one("n", 2).alias("n2"), one("r", 1).alias("r1"), F.sum("ties").alias("ties"))
    n1, n2, n = F.col("n1").cast("double"), F.col("n2").cast("double"), (F.col("n1") + F.col("n2")).cast("double")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return t.select("n1", "n2", F.round(u, 1).alias("u1"), F.round(n1 * n2 - u, 1).alias("u2"), F.round((u - n1 * n2 / 2) / sd, 6).alias("z"))


def ks_two_sample(df: DataFrame, group: str, value: str, groups: tuple | None = None) -> DataFrame:
    """Largest distance of the empirical distributions of two groups, which must be named where there are more, at distinct pooled values."""
    x = two_groups(long_form(df, group, value), groups)
    at = x.join(F.broadcast(x.groupBy("grp").agg(F.count("*").alias("n"))), "grp").groupBy("v").agg(F.sum(F.when(F.col("k") == 1, 1 / F.col("n")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("k") == 2, 1 / F.col("n")).otherwise(0.0)).alias("b"))
    steps = running_sums(at, ("v",), upto_a="a", upto_b="b")
    return steps.select(F.abs(F.col("upto_a") - F.col("upto_b")).alias("d")).agg(F.round(F.max("d"), 6).alias("d"))


def contingency_chi_square(df: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-square of independence, degrees of freedom and Cramér's V of the table of counts."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count("*").alias("o"))
    rows, columns = cells.groupBy("r").agg(F.sum("o").alias("rt")), cells.groupBy("c").agg(F.sum("o").alias("ct"))
    # sum of (o - e)^2 / e over all cells is n (sum of o^2 / (rt ct) - 1), so empty cells need no rows
    s = cells.join(rows, "r").join(columns, "c").agg(F.sum("o").alias("n"), F.sum(F.col("o").cast("double") * F.col("o") / (F.col("rt").cast("double") * F.col("ct"))).alias("q"), F.count_distinct("r").alias("nr"), F.count_distinct("c").alias("nc"))
    chi = F.col("n") * (F.col("q") - 1)
    return s.select("n", ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("df"), F.round(chi, 5).alias("chi2"), F.round(F.sqrt(chi / (F.col("n") * (F.least("nr", "nc") - 1))), 6).alias("cramers_v"))


def mood_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Values above and below the pooled median by group; those equal to it are dropped."""
    x = long_form(df, group, value)
    m = x.agg(F.expr("percentile(v, 0.5)").alias("m"))
    return x.join(F.broadcast(m)).groupBy("grp").agg(F.count_if(F.col("v") > F.col("m")).alias("above"), F.count_if(F.col("v") < F.col("m")).alias("below"))


def cochran_mantel_haenszel(df: DataFrame, stratum: str, exposed: str, outcome: str) -> DataFrame:
    """Mantel-Haenszel odds ratio and statistic (no continuity correction) over 2 x 2 strata; `exposed` and `outcome` are booleans."""
    e, o = F.col(exposed), F.col(outcome)
    s = df.groupBy(F.col(stratum).alias("s")).agg(F.count_if(e & o).alias("a"), F.count_if(e & ~o).alias("b"), F.count_if(~e & o).alias("c"), F.count_if(~e & ~o).alias("d"))
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    variance = (a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))
    t = s.where(n > 1).agg(F.sum(a - (a + b) * (a + c) / n).alias("x"), F.sum(variance).alias("v"), F.sum(a * d / n).alias("p"), F.sum(b * c / n).alias("q"), F.count("*").alias("strata"))
    return t.select("strata", F.round(F.col("x") * F.col("x") / F.col("v"), 6).alias("chi2"), F.round(F.col("p") / F.col("q"), 6).alias("odds_ratio"))


def directional(df: DataFrame, group: str, degrees, axial: bool = False) -> DataFrame:
    """Resultant length, mean direction (null where Rayleigh's Z is under 1), circular variance, Z and its p by group."""
    k = 2 if axial else 1
    x = long_form(df, group, degrees).select("grp", F.radians(F.col("v") * k).alias("a"))
    s = x.groupBy("grp").agg(F.count("*").alias("n"), F.avg(F.cos("a")).alias("c"), F.avg(F.sin("a")).alias("s"))
    r = F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))
    z = F.col("n") * r * r
    mean = F.pmod(F.degrees(F.atan2("s", "c")), F.lit(360.0)) / k
    return s.select("grp", "n", F.round(r, 6).alias("r_bar"), F.when(z >= 1, F.round(mean, 4)).alias("mean_direction"), F.round(1 - r, 6).alias("circular_variance"), F.round(z, 5).alias("z"), F.round(F.exp(-z), 6).alias("p"))


def kaplan_meier(df: DataFrame, group: str, time: str, event) -> DataFrame:
    """Product-limit estimate at each event time, by group. At risk are all with a time of at least t, so those censored at t count.

    Times are counted first; windows then run over distinct times. Survival of 0 ends a curve; Greenwood's error is null there.
    """
    at = df.where(F.col(time).isNotNull()).groupBy(F.col(group).alias("grp"), F.col(time).alias("t")).agg(F.count("*").alias("n"), F.count_if(event).alias("d"))
    later = W.partitionBy("grp").orderBy(F.col("t").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    so_far = W.partitionBy("grp").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = at.withColumn("at_risk", F.sum("n").over(later)).where("d > 0")
    gone = F.max((F.col("d") == F.col("at_risk")).cast("int")).over(so_far)
    step = F.when(F.col("d") < F.col("at_risk"), F.log(1 - F.col("d") / F.col("at_risk")))
    green = F.when(F.col("d") < F.col("at_risk"), F.col("d") / (F.col("at_risk").cast("double") * (F.col("at_risk") - F.col("d"))))
    s = F.when(gone == 1, F.lit(0.0)).otherwise(F.exp(F.sum(step).over(so_far)))
    return x.select("grp", "t", "at_risk", F.col("d").alias("events"), F.round(s, 6).alias("survival"), F.when(gone == 0, F.round(s * F.sqrt(F.sum(green).over(so_far)), 6)).alias("se"))


def survival_intervals(curve: DataFrame, z: float = 1.959964) -> DataFrame:
    """(grp, t, survival, lower, upper): intervals of kaplan_meier()'s curve on the log-log scale; null where survival is 1 or 0."""
    s = F.col("survival")
    inside = (s > 0) & (s < 1) & F.col("se").isNotNull()
    theta, wide = F.log(-F.log(s)), F.lit(z) * F.col("se") / (s * F.abs(F.log(s)))
    bound = lambda sign: F.when(inside, F.round(F.exp(-F.exp(theta + sign * wide)), 5))
    return curve.select("grp", "t", "survival", bound(1).alias("lower"), bound(-1).alias("upper"))


def median_survival(curve: DataFrame) -> DataFrame:
    """(grp, median): the first time at which a curve has come down to a half; null where it never does."""
    return curve.groupBy("grp").agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("median"))
