"""Tests with their tail probabilities, intervals and effect sizes. Each result is a row or a few, so tails are made on results.

Missing values (null, NaN) are skipped; undefined statistics and their p are null.
"""

from __future__ import annotations

import math
import statistics

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions import special
from ammolite.functions.columns import average_ranks, long_form, missing, two_groups
from ammolite.functions.scans import running_sums
from ammolite.operators import univariate as u


def _p(column: Column, digits: int = 6) -> Column:
    return F.round(column, digits).alias("p")


def one_way_anova_test(df: DataFrame, group: str, value: str) -> DataFrame:
    """F, its p, and the share of the variance between groups."""
    t = u.one_way_anova(df, group, value)
    return t.select("df_between", "df_within", "f", _p(special.f_sf("f", "df_between", "df_within")), F.round(F.col("ss_ratio") / (1 + F.col("ss_ratio")), 6).alias("eta_squared"))


def kruskal_wallis_test(df: DataFrame, group: str, value: str) -> DataFrame:
    t = u.kruskal_wallis(df, group, value)
    return t.select("df", "n", "h", _p(special.chi2_sf("h", "df")))


def mann_whitney_test(df: DataFrame, group: str, value: str, groups: tuple | None = None) -> DataFrame:
    """U of both groups, which must be named where there are more, and the two-sided p of the tie-corrected z."""
    t = u.mann_whitney(df, group, value, groups)
    return t.select("n1", "n2", "u1", "u2", "z", _p(2 * special.normal_sf(F.abs("z"))))


def contingency_test(df: DataFrame, row: str, column: str) -> DataFrame:
    t = u.contingency_chi_square(df, row, column)
    return t.select("n", "df", "chi2", _p(special.chi2_sf("chi2", "df")), "cramers_v")


def standardized_residuals(df: DataFrame, row: str, column: str) -> DataFrame:
    """(o - e) / sqrt(e) of the cells of a table that hold anything."""
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(row).alias("r"), F.col(column).alias("c")).agg(F.count("*").alias("o"))
    whole = cells.agg(F.sum("o").alias("n"))
    x = cells.join(cells.groupBy("r").agg(F.sum("o").alias("rt")), "r").join(cells.groupBy("c").agg(F.sum("o").alias("ct")), "c").join(F.broadcast(whole))
    e = F.col("rt").cast("double") * F.col("ct") / F.col("n")
    return x.select("r", "c", F.col("o").alias("observed"), F.round(e, 6).alias("expected"), F.round((F.col("o") - e) / F.sqrt(e), 6).alias("residual"))


def cochran_mantel_haenszel_test(df: DataFrame, stratum: str, exposed: str, outcome: str, correction: bool = False) -> DataFrame:
    """As cochran_mantel_haenszel with p; the correction takes 0.5 once off the total."""
    e, o = F.col(exposed), F.col(outcome)
    s = df.groupBy(F.col(stratum).alias("s")).agg(*(F.count_if(x).cast("double").alias(n) for n, x in (("a", e & o), ("b", e & ~o), ("c", ~e & o), ("d", ~e & ~o)))).withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("d"))
    expect = (F.col("a") + F.col("b")) * (F.col("a") + F.col("c")) / F.col("n")
    variance = expect * (F.col("c") + F.col("d")) * (F.col("b") + F.col("d")) / (F.col("n") * (F.col("n") - 1))
    t = s.where("n > 1").agg(F.count("*").alias("strata"), F.sum(F.col("a") - expect).alias("x"), F.sum(variance).alias("v"), F.sum(F.col("a") * F.col("d") / F.col("n")).alias("up"), F.sum(F.col("b") * F.col("c") / F.col("n")).alias("down"))
    x = F.greatest(F.lit(0.0), F.abs("x") - (0.5 if correction else 0.0))
    t = t.select("strata", (x * x / F.col("v")).alias("chi2"), (F.col("up") / F.nullif(F.col("down"), F.lit(0.0))).alias("odds_ratio")).withColumn("df", F.lit(1))
    return t.select("strata", F.round("chi2", 6).alias("chi2"), _p(special.chi2_sf("chi2", "df")), F.round("odds_ratio", 6).alias("odds_ratio"))


def t_test(df: DataFrame, group: str, value: str, groups: tuple | None = None) -> DataFrame:
    """Pooled t of two groups, which must be named where there are more, its two-sided p and Cohen's d (pooled)."""
    g = two_groups(long_form(df, group, value).groupBy("grp").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s2")), groups)
    t = g.agg(*(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}") for c in ("n", "m", "s2") for k in (1, 2))).withColumn("df", F.col("n_1") + F.col("n_2") - 2)
    pooled = ((F.col("n_1") - 1) * F.col("s2_1") + (F.col("n_2") - 1) * F.col("s2_2")) / F.col("df")
    t = t.withColumn("d", (F.col("m_1") - F.col("m_2")) / F.sqrt(pooled)).withColumn("t", F.col("d") / F.sqrt(1 / F.col("n_1") + 1 / F.col("n_2")))
    return t.select("df", F.round("t", 6).alias("t"), _p(2 * special.t_sf(F.abs("t"), "df")), F.round("d", 6).alias("cohens_d"))


def paired_t_test(df: DataFrame, first: str | Column, second: str | Column) -> DataFrame:
    """t of the mean difference of two columns, with its two-sided p."""
    x = df.select((missing(first) - missing(second)).alias("d")).where("d is not null")
    t = x.agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s")).withColumn("df", F.col("n") - 1).withColumn("t", F.col("m") / (F.col("s") / F.sqrt("n")))
    return t.select("n", "df", F.round("m", 6).alias("mean_difference"), F.round("t", 6).alias("t"), _p(2 * special.t_sf(F.abs("t"), "df")))


def ks_test(df: DataFrame, group: str, value: str, groups: tuple | None = None) -> DataFrame:
    """Largest distance of the empirical distributions of two groups, which must be named where there are more, the value where it lies (the least of equals), its sign, and the limit's p."""
    x = two_groups(long_form(df, group, value), groups)
    two = x.groupBy("grp").agg(F.count("*").alias("n"), F.max("k").alias("k"))
    at = x.drop("k").join(F.broadcast(two), "grp").groupBy("v").agg(*(F.sum(F.when(F.col("k") == k, 1 / F.col("n")).otherwise(0.0)).alias(c) for k, c in ((1, "a"), (2, "b"))))
    steps = running_sums(at, ("v",), upto_a="a", upto_b="b").select("v", (F.col("upto_a") - F.col("upto_b")).alias("gap"))
    top = steps.agg(F.max_by(F.struct("v", "gap"), F.struct(F.round(F.abs("gap"), 12), -F.col("v"))).alias("s")).select("s.*")
    sizes = two.agg((F.product(F.col("n").cast("double")) / F.sum("n")).alias("m"), F.max("k").alias("groups"))
    t = top.join(sizes).where("groups = 2").withColumn("x", F.sqrt("m") * F.abs("gap"))
    return t.select(F.round(F.abs("gap"), 6).alias("d"), F.signum(F.round("gap", 12)).cast("int").alias("sign"), F.col("v").alias("location"), _p(special.kolmogorov_sf("x")))


def mood_median_test(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Fisher's exact p of the counts above and below the pooled median in two groups, given as a boolean; values equal to the median are dropped."""
    x = df.select(group.alias("g"), missing(value).alias("v")).where("g is not null and v is not null")
    m = x.agg(F.expr("percentile(v, 0.5)").alias("m"))
    t = x.join(F.broadcast(m)).where("v != m").agg(*(F.count_if(c).alias(n) for n, c in (("a", F.expr("g and v > m")), ("b", F.expr("g and v < m")), ("c", F.expr("not g and v > m")), ("d", F.expr("not g and v < m")))))
    return t.select("a", "b", "c", "d", _p(special.fisher_p("a", "b", "c", "d")))


def log_rank(df: DataFrame, group: Column, time: str | Column, event: Column) -> DataFrame:
    """Log-rank chi-square and p of two groups, given as a boolean: at each event time observed against expected, tied events by the hypergeometric variance."""
    x = df.select(group.alias("g"), missing(time).alias("t"), event.alias("e")).where("g is not null and t is not null")
    at = x.groupBy("t").agg(F.count_if("g").alias("n1"), F.count("*").alias("n"), F.count_if(F.col("g") & F.col("e")).alias("d1"), F.count_if("e").alias("d"))
    later = running_sums(at, (F.desc("t"),), r1="n1", r="n")
    r = later.select("d1", "d", "r1", F.col("r").cast("double").alias("r")).where("d > 0")
    expect = F.col("d") * F.col("r1") / F.col("r")
    variance = F.when(F.col("r") > 1, expect * (1 - F.col("r1") / F.col("r")) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    s = r.agg(F.sum("d1").alias("observed"), F.sum(expect).alias("expected"), F.sum(variance).alias("v"))
    s = s.withColumn("chi2", F.pow(F.col("observed") - F.col("expected"), 2) / F.nullif(F.col("v"), F.lit(0.0))).withColumn("df", F.lit(1))
    return s.select("observed", F.round("expected", 5).alias("expected"), F.round("chi2", 5).alias("chi2"), _p(special.chi2_sf("chi2", "df")))


def paired_rank_test(df: DataFrame, first: str | Column, second: str | Column) -> DataFrame:
    """Signed ranks of the differences of two columns that are not zero: sums by sign, the smaller W, the normal z with ties, its p, and the sign test's exact p."""
    d = df.select((missing(first) - missing(second)).alias("d")).where("d is not null")
    x = average_ranks(d.where("d != 0").select("d", F.abs("d").alias("v")))
    t = x.agg(F.count("*").alias("n"), F.count_if(F.col("d") > 0).alias("positive"), F.sum(F.when(F.col("d") > 0, F.col("avg_rank")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("avg_rank")).otherwise(0.0)).alias("w_minus"), F.sum(F.col("n_ties").cast("double") * F.col("n_ties") - 1).alias("ties"))
    n = F.col("n").cast("double")
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    t = t.withColumn("z", z).withColumn("half", F.lit(0.5))
    return t.select("n", "positive", F.round("w_plus", 1).alias("w_plus"), F.round("w_minus", 1).alias("w_minus"), F.round("z", 6).alias("z"), _p(F.least(F.lit(1.0), 2 * special.normal_sf(F.abs("z")))), F.round(special.binomial_p("positive", "n", "half"), 6).alias("sign_p"))


def brunner_munzel(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Chance that a value of the first group (true) exceeds one of the second, the statistic, its degrees of freedom and two-sided p."""
    x = df.select(group.alias("g"), missing(value).alias("v")).where("g is not null and v is not null")
    # the mean rank against the other group is the pooled rank less the rank within one's own
    pooled = average_ranks(x).select("g", "v", "avg_rank")
    own = average_ranks(x, within="g").select("g", "v", F.col("avg_rank").alias("own")).distinct()
    s = pooled.join(own, ["g", "v"]).withColumn("placed", F.col("avg_rank") - F.col("own"))
    k = s.groupBy("g").agg(F.count("*").cast("double").alias("n"), F.avg("avg_rank").alias("r"), F.var_samp("placed").alias("s2"))
    t = k.agg(*(F.max(F.when(F.col("g") == flag, F.col(c))).alias(f"{c}{i}") for c in ("n", "r", "s2") for i, flag in ((1, True), (2, False))))
    n1, n2 = F.col("n1"), F.col("n2")
    a, b = n1 * F.col("s21"), n2 * F.col("s22")
    t = t.withColumn("statistic", n1 * n2 * (F.col("r1") - F.col("r2")) / ((n1 + n2) * F.sqrt(F.nullif(a + b, F.lit(0.0)))))
    t = t.withColumn("df", F.pow(a + b, 2) / (a * a / (n1 - 1) + b * b / (n2 - 1))).withColumn("win", (F.col("r1") - (n1 + 1) / 2) / n2)
    return t.select(n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), F.round("win", 6).alias("win"), F.round("statistic", 5).alias("statistic"), F.round("df", 4).alias("df"), _p(2 * special.t_sf(F.abs("statistic"), "df")))


def fligner_killeen(df: DataFrame, group: str, value: str) -> DataFrame:
    """Homogeneity of spread from normal scores of the ranked distances to each group's median, against chi-square."""
    x = long_form(df, group, value)
    centre = x.groupBy("grp").agg(F.expr("percentile(v, 0.5)").alias("m"))
    d = x.join(centre, "grp").select("grp", F.abs(F.col("v") - F.col("m")).alias("v"))
    n = d.agg(F.count("*").alias("all"))
    scored = average_ranks(d).join(F.broadcast(n)).withColumn("q", (1 + F.col("avg_rank") / (F.col("all") + 1)) / 2).withColumn("a", special.normal_quantile("q"))
    whole = scored.agg(F.avg("a").alias("mean"), F.var_samp("a").alias("s2"), F.count_distinct("grp").alias("k"))
    g = scored.groupBy("grp").agg(F.count("*").alias("n"), F.avg("a").alias("m")).join(F.broadcast(whole))
    t = g.groupBy("k").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2) / F.col("s2")).alias("chi2")).withColumn("df", F.col("k") - 1)
    return t.select("df", F.round("chi2", 5).alias("chi2"), _p(special.chi2_sf("chi2", "df")))


def outlier_screen(df: DataFrame, key: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Rows whose |z| (n - 1) exceeds the two-sided normal quantile."""
    x = df.select(F.col(key).alias("key"), missing(value).alias("v")).where("v is not null")
    m = x.agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"))
    limit = statistics.NormalDist().inv_cdf(1 - alpha / 2)
    return x.join(F.broadcast(m)).withColumn("z", (F.col("v") - F.col("m")) / F.col("s")).where(F.abs("z") > limit).select("key", "v", F.round("z", 6).alias("z"))


def proportion_test(df: DataFrame, group: str, success: Column, p0: float = 0.5) -> DataFrame:
    """Exact two-sided binomial p of each group's share of successes against p0."""
    t = df.groupBy(F.col(group).alias("grp")).agg(F.count_if(success).alias("successes"), F.count(success).alias("trials")).withColumn("p0", F.lit(p0))
    return t.select("grp", "successes", "trials", F.round(F.col("successes") / F.col("trials"), 6).alias("share"), _p(special.binomial_p("successes", "trials", "p0")))


def multiple_proportions(df: DataFrame, group: str, success: Column, confidence: float = 0.95) -> DataFrame:
    """Wilson's interval of each group's share."""
    z = statistics.NormalDist().inv_cdf(0.5 + confidence / 2)
    t = df.groupBy(F.col(group).alias("grp")).agg(F.count_if(success).alias("successes"), F.count(success).alias("trials"))
    n, p = F.col("trials").cast("double"), F.col("successes") / F.col("trials")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z / (1 + z * z / n) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return t.select("grp", "successes", "trials", F.round(p, 6).alias("share"), F.round(F.greatest(F.lit(0.0), mid - half), 6).alias("low"), F.round(F.least(F.lit(1.0), mid + half), 6).alias("high"))


def _table_means(df: DataFrame, subject: str, measurement: str, value: str | Column) -> DataFrame:
    """(s, m, v): the mean of each cell, of subjects that have every measurement."""
    x = df.select(F.col(subject).alias("s"), F.col(measurement).alias("m"), missing(value).alias("v")).where("v is not null").groupBy("s", "m").agg(F.avg("v").alias("v"))
    whole = x.agg(F.count_distinct("m").alias("k"))
    return x.withColumn("has", F.count("*").over(W.partitionBy("s"))).join(F.broadcast(whole)).where("has = k").select("s", "m", "v")


def _two_way_squares(x: DataFrame) -> DataFrame:
    """One row: subjects n, measurements k, sums of squares of subjects, measurements and the rest of a complete table (s, m, v)."""
    grand = x.agg(F.count_distinct("s").alias("n"), F.count_distinct("m").alias("k"), F.avg("v").alias("g"), (F.var_pop("v") * F.count("v")).alias("sst"))
    by = lambda c: x.groupBy(c).agg(F.avg("v").alias("a")).agg((F.var_pop("a") * F.count("a")).alias(f"q_{c}"))
    t = grand.join(by("s")).join(by("m"))
    ss, sm = F.col("q_s") * F.col("k"), F.col("q_m") * F.col("n")
    return t.select("n", "k", "sst", ss.alias("ss_subjects"), sm.alias("ss_measurements"), (F.col("sst") - ss - sm).alias("ss_error"))


def repeated_measures_anova(df: DataFrame, subject: str, measurement: str, value: str | Column) -> DataFrame:
    """F of the measurements within subjects over a complete table, and shares of the sum of squares; subjects that lack one are left out."""
    t = _two_way_squares(_table_means(df, subject, measurement, value))
    t = t.withColumn("df1", F.col("k") - 1).withColumn("df2", (F.col("k") - 1) * (F.col("n") - 1)).withColumn("f", (F.col("ss_measurements") / F.col("df1")) / (F.col("ss_error") / F.col("df2")))
    return t.select("n", "df1", "df2", *(F.round(F.col(f"ss_{c}") / F.col("sst"), 6).alias(f"share_{c}") for c in ("subjects", "measurements", "error")), F.round("f", 5).alias("f"), _p(special.f_sf("f", "df1", "df2")))


def intraclass_correlation(df: DataFrame, subject: str, measurement: str, value: str | Column) -> DataFrame:
    """ICC(2,1) and ICC(3,1) of a complete table; null where the rest has no variance."""
    t = _two_way_squares(_table_means(df, subject, measurement, value))
    n, k = F.col("n"), F.col("k")
    ms, mm, me = F.col("ss_subjects") / (n - 1), F.col("ss_measurements") / (k - 1), F.col("ss_error") / ((n - 1) * (k - 1))
    some = me > 0
    return t.select("n", "k", F.when(some, F.round((ms - me) / (ms + (k - 1) * me + k * (mm - me) / n), 6)).alias("icc_2_1"), F.when(some, F.round((ms - me) / (ms + (k - 1) * me), 6)).alias("icc_3_1"))


def two_way_anova(df: DataFrame, a: str, b: Column, value: str) -> DataFrame:
    """Sequential sums of squares: factor a, then b (a boolean: two levels) given a, then their interaction, with F and p.

    With two levels of b the additive model has a closed form: b's effect is the mean of the cell differences, weighted by
    n1 n2 / (n1 + n2) of each level of a.
    """
    x = df.select(F.col(a).alias("a"), b.alias("b"), missing(value).alias("v")).dropna()
    whole = x.agg(F.count("*").alias("n"), (F.var_pop("v") * F.count("v")).alias("sst"))
    levels = x.groupBy("a").agg(F.count("*").alias("m"), F.avg("v").alias("mean"), *(f.alias(n) for n, f in (("n1", F.count_if("b")), ("n2", F.count_if(~F.col("b"))), ("m1", F.avg(F.when(F.col("b"), F.col("v")))), ("m2", F.avg(F.when(~F.col("b"), F.col("v"))))))).where("n1 > 0 and n2 > 0")
    w, gap = F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")), F.col("m1") - F.col("m2")
    t = levels.agg(F.count("*").alias("k"), (F.sum(F.col("m") * F.col("mean") * F.col("mean")) - F.pow(F.sum(F.col("m") * F.col("mean")), 2) / F.sum("m")).alias("ss_a"), (F.pow(F.sum(w * gap), 2) / F.sum(w)).alias("ss_b"), F.sum(w * gap * gap).alias("cells")).join(whole)
    t = t.withColumn("ss_ab", F.col("cells") - F.col("ss_b")).withColumn("ss_error", F.col("sst") - F.col("ss_a") - F.col("cells")).withColumn("df_error", F.col("n") - 2 * F.col("k"))
    terms = F.array(*(F.struct(F.lit(n).alias("term"), d.cast("long").alias("df"), F.col(s).alias("ss")) for n, d, s in (("a", F.col("k") - 1, "ss_a"), ("b", F.lit(1), "ss_b"), ("a:b", F.col("k") - 1, "ss_ab"))))
    t = t.select(F.explode(terms).alias("x"), "ss_error", "df_error", "sst").select("x.*", "ss_error", "df_error", "sst").withColumn("f", (F.col("ss") / F.col("df")) / (F.col("ss_error") / F.col("df_error")))
    return t.select("term", "df", "df_error", F.round("f", 5).alias("f"), _p(special.f_sf("f", "df", "df_error")), F.round(F.col("ss") / F.col("sst"), 6).alias("eta_squared"), F.round(F.col("ss") / (F.col("ss") + F.col("ss_error")), 6).alias("partial_eta_squared"))


def dispersion_statistic(df: DataFrame, category: str, method: str = "chi2") -> DataFrame:
    """Counts against an even expectation: chi-square, or G (g_test), with p."""
    o = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("o"))
    t = o.agg(F.count("*").alias("k"), F.sum("o").alias("n"), F.collect_list("o").alias("c"))
    e = F.col("n") / F.col("k")
    x = F.aggregate("c", F.lit(0.0), lambda s, v: s + (F.pow(v - e, 2) / e if method == "chi2" else 2 * v * F.log(v / e)))
    t = t.withColumn("statistic", x).withColumn("df", F.col("k") - 1)
    return t.select("df", "n", F.round("statistic", 5).alias("statistic"), _p(special.chi2_sf("statistic", "df")))


def model_comparison(models: DataFrame) -> DataFrame:
    """AIC, AICc, their difference to the best and Akaike weights (by AICc) of rows (model, log_likelihood, n_params, n_obs); AICc is null when n <= k + 1."""
    k, n = F.col("n_params"), F.col("n_obs")
    aic = 2.0 * k - 2.0 * F.col("log_likelihood")
    x = models.select("model", aic.alias("aic"), F.when(n > k + 1, aic + 2.0 * k * (k + 1) / (n - k - 1)).alias("aicc"))
    best = x.agg(F.min("aicc").alias("best"))
    x = x.join(F.broadcast(best)).withColumn("delta", F.col("aicc") - F.col("best")).withColumn("e", F.exp(-F.col("delta") / 2))
    whole = x.agg(F.sum("e").alias("whole"))
    return x.join(F.broadcast(whole)).select("model", F.round("aic", 4).alias("aic"), F.round("aicc", 4).alias("aicc"), F.round("delta", 4).alias("delta"), F.round(F.col("e") / F.col("whole"), 6).alias("weight"))


def gaussian_models(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(model, log_likelihood, n_params, n_obs): a constant and a straight line per group, errors normal with the residuals' mean square."""
    p = df.select(F.col(group).alias("grp"), missing(x).alias("x"), missing(y).alias("y")).dropna()
    s = p.groupBy("grp").agg(F.count("*").alias("n"), F.regr_syy("y", "x").alias("syy"), (F.regr_syy("y", "x") - F.pow(F.regr_sxy("y", "x"), 2) / F.regr_sxx("y", "x")).alias("rss"))
    ll = lambda c: -F.col("n") / 2 * (F.log(2 * math.pi * F.col(c) / F.col("n")) + 1)
    rows = F.array(*(F.struct(F.concat(F.lit(f"{m}:"), F.col("grp").cast("string")).alias("model"), ll(c).alias("log_likelihood"), F.lit(k).alias("n_params"), F.col("n").alias("n_obs")) for m, c, k in (("constant", "syy", 2), ("line", "rss", 3))))
    return s.select(F.explode(rows).alias("r")).select("r.*")


def correlation_interval(df: DataFrame, x: str, y: str, confidence: float = 0.95) -> DataFrame:
    """Pearson's r with Fisher's interval."""
    z = statistics.NormalDist().inv_cdf(0.5 + confidence / 2)
    t = df.select(missing(x).alias("x"), missing(y).alias("y")).dropna().agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    end = lambda s: F.when(F.col("n") > 3, F.round(F.tanh(F.atanh("r") + s * z / F.sqrt(F.col("n") - 3)), 6))
    return t.select("n", F.round("r", 6).alias("r"), end(-1).alias("low"), end(1).alias("high"))
