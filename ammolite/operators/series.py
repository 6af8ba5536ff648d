"""Operators on ordered series (series, t, v). Every window is partitioned by series; t orders it and is unique in it.

Missing values (null, NaN) are dropped first. Rows are never ordered by anything but t, so results do not depend on how the
input is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions.columns import average_ranks, missing


def series(df: DataFrame, key: str | Column, t: str | Column, v: str | Column) -> DataFrame:
    """(series, t, v) with t and v doubles and nothing missing."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(col(key).alias("series"), missing(t).alias("t"), missing(v).alias("v")).where("t is not null and v is not null")


def _by_t():
    return W.partitionBy("series").orderBy("t")


def _all():
    return W.partitionBy("series")


def autocorrelation(x: DataFrame, lags: int) -> DataFrame:
    """Biased r_k for k = 0..lags with the white-noise band 1.96 / sqrt(n)."""
    d = x.select("series", F.row_number().over(_by_t()).alias("i"), (F.col("v") - F.avg("v").over(_all())).alias("z"))
    total = d.groupBy("series").agg(F.count("*").alias("n"), F.sum(F.col("z") * F.col("z")).alias("s"))
    shifted = d.select("series", F.col("z").alias("z0"), "i").withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).select("series", (F.col("i") + F.col("lag")).alias("i"), "lag", "z0")
    r = shifted.join(d, ["series", "i"]).groupBy("series", "lag").agg(F.sum(F.col("z0") * F.col("z")).alias("c"))
    return r.join(total, "series").where("lag < n").select("series", "lag", F.round(F.col("c") / F.col("s"), 6).alias("r"), F.round(1.96 / F.sqrt("n"), 6).alias("band"))


def cross_correlation(x: DataFrame, first: object, second: object, lags: int) -> DataFrame:
    """Pearson correlation of the two named series on overlapping times at each signed lag: first at t with second at t + lag."""
    a, b = x.where(F.col("series") == F.lit(first)).select(F.col("t").alias("ta"), F.col("v").alias("a")), x.where(F.col("series") == F.lit(second)).select("t", F.col("v").alias("b"))
    moved = a.withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).select("lag", (F.col("ta") + F.col("lag")).alias("t"), "a")
    return moved.join(b, "t").groupBy("lag").agg(F.count("*").alias("n"), F.round(F.corr("a", "b"), 6).alias("r"))


def lead_lag_rmse(x: DataFrame, first: object, second: object, lags: int, overlap: int = 3) -> DataFrame:
    """RMSE of the z-standardised series at each signed lag with at least `overlap` common times."""
    z = x.where(F.col("series").isin(first, second)).select("series", "t", ((F.col("v") - F.avg("v").over(_all())) / F.stddev_samp("v").over(_all())).alias("v"))
    a, b = z.where(F.col("series") == F.lit(first)).select(F.col("t").alias("ta"), F.col("v").alias("a")), z.where(F.col("series") == F.lit(second)).select("t", F.col("v").alias("b"))
    moved = a.withColumn("lag", F.explode(F.sequence(F.lit(-lags), F.lit(lags)))).select("lag", (F.col("ta") + F.col("lag")).alias("t"), "a")
    d = F.col("a") - F.col("b")
    return moved.join(b, "t").groupBy("lag").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse")).where(F.col("n") >= overlap)


def derivative(x: DataFrame) -> DataFrame:
    """Second-order differences for uneven steps inside, one-sided ones at the ends."""
    t0, v0, t1, v1 = F.lag("t").over(_by_t()), F.lag("v").over(_by_t()), F.lead("t").over(_by_t()), F.lead("v").over(_by_t())
    s = x.select("*", t0.alias("t0"), v0.alias("v0"), t1.alias("t1"), v1.alias("v1"))
    a, b = F.col("t") - F.col("t0"), F.col("t1") - F.col("t")
    inner = (a * a * F.col("v1") + (b * b - a * a) * F.col("v") - b * b * F.col("v0")) / (a * b * (a + b))
    d = F.when(F.col("t0").isNull(), (F.col("v1") - F.col("v")) / b).when(F.col("t1").isNull(), (F.col("v") - F.col("v0")) / a).otherwise(inner)
    return s.select("series", "t", F.round(d, 6).alias("dv"))


def _rows(width: int) -> tuple[int, int]:
    """Rows before and after the centre: odd widths are symmetric, even ones have one row fewer before it. Ends are truncated."""
    h = width // 2
    return (-h, h) if width % 2 else (1 - h, h)


def fixed_count_summary(x: DataFrame, width: int) -> DataFrame:
    """Mean, sd (0 for one value), extremes and median over windows of `width` rows."""
    w = _by_t().rowsBetween(*_rows(width))
    return x.select(
        "series", "t", F.count("v").over(w).alias("n"), F.round(F.avg("v").over(w), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("v").over(w), F.lit(0.0)), 6).alias("sd"), F.round(F.min("v").over(w), 6).alias("minimum"),
        F.round(F.max("v").over(w), 6).alias("maximum"), F.round(F.expr("percentile(v, 0.5)").over(w), 6).alias("median"),
    )


def range_frame(bandwidth: float) -> str:
    """The closed interval of t around a row, `bandwidth` wide, as SQL text: rangeBetween() takes no fractions."""
    return f"OVER (PARTITION BY series ORDER BY t RANGE BETWEEN {bandwidth / 2}D PRECEDING AND {bandwidth / 2}D FOLLOWING)"


def fixed_bandwidth_summary(x: DataFrame, bandwidth: float) -> DataFrame:
    """Mean, sd (0 for one value), extremes and standard error over the closed interval of t that is `bandwidth` wide."""
    over = range_frame(bandwidth)
    s = x.select("series", "t", *(F.expr(f"{f}(v) {over}").alias(n) for f, n in (("count", "n"), ("avg", "mean"), ("stddev_samp", "sd"), ("min", "minimum"), ("max", "maximum"))))
    s = s.withColumn("sd", F.coalesce("sd", F.lit(0.0))).withColumn("se", F.col("sd") / F.sqrt("n"))
    return s.select("series", "t", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "minimum", "maximum", "se")))


def mann_kendall(x: DataFrame) -> DataFrame:
    """S, tau-b, the tie-corrected variance of S, z with continuity correction and Sen's slope, by series.

    Every pair of a series counts, so the pairs are joined on the series alone; a series of n values costs n squared.
    """
    a, b = x, x.select("series", F.col("t").alias("t2"), F.col("v").alias("v2"))
    pairs = a.join(b, "series").where("t < t2")
    p = pairs.groupBy("series").agg(F.sum(F.signum(F.col("v2") - F.col("v"))).cast("long").alias("s"), F.expr("percentile((v2 - v) / (t2 - t), 0.5)").alias("slope"))
    ties = x.groupBy("series", "v").agg(F.count("*").alias("c")).groupBy("series").agg(F.sum("c").alias("n"), F.sum(F.expr("CAST(c AS DOUBLE) * (c - 1) * (2 * c + 5)")).alias("vt"), F.sum(F.expr("CAST(c AS DOUBLE) * (c - 1) / 2")).alias("pt"))
    n, s = F.col("n").cast("double"), F.col("s")
    var = (n * (n - 1) * (2 * n + 5) - F.col("vt")) / 18
    n0 = n * (n - 1) / 2
    return p.join(ties, "series").select("series", "n", "s", F.round(s / F.sqrt(n0 * (n0 - F.col("pt"))), 6).alias("tau_b"), F.round(var, 4).alias("variance"), F.round(F.when(s == 0, 0.0).otherwise((s - F.signum(s)) / F.sqrt(var)), 6).alias("z"), F.round("slope", 8).alias("sen_slope"))


def runs_test(x: DataFrame) -> DataFrame:
    """Runs above and not above the series' median, with the Wald-Wolfowitz z."""
    m = x.groupBy("series").agg(F.expr("percentile(v, 0.5)").alias("m"))
    s = x.join(m, "series").select("series", "t", (F.col("v") > F.col("m")).cast("int").alias("above"))
    r = s.select("series", "above", F.coalesce(F.col("above") != F.lag("above").over(_by_t()), F.lit(True)).cast("int").alias("new"))
    g = r.groupBy("series").agg(F.sum("new").alias("runs"), F.sum("above").alias("n1"), F.sum(1 - F.col("above")).alias("n2"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    mean = 2 * n1 * n2 / (n1 + n2) + 1
    var = 2 * n1 * n2 * (2 * n1 * n2 - n1 - n2) / ((n1 + n2) * (n1 + n2) * (n1 + n2 - 1))
    return g.select("series", "runs", "n1", "n2", F.round((F.col("runs") - mean) / F.sqrt(var), 6).alias("z"))


def interpolate_linear(x: DataFrame, at: DataFrame) -> DataFrame:
    """Values at the times `at` (series, t), linear between neighbours, null outside. An as-of join by windows over the union: no pairs are made."""
    both = x.select("series", "t", "v", F.lit(False).alias("asked")).unionByName(at.select("series", F.col("t").cast("double").alias("t"), F.lit(None).cast("double").alias("v"), F.lit(True).alias("asked")))
    known = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    # a known row at an asked time counts on both sides: ranges include peers
    before = W.partitionBy("series").orderBy("t").rangeBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy("series").orderBy("t").rangeBetween(W.currentRow, W.unboundedFollowing)
    s = both.select("series", "t", "asked", F.last(known, ignorenulls=True).over(before).alias("a"), F.first(known, ignorenulls=True).over(after).alias("b")).where("asked")
    share = (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t"))
    return s.select("series", "t", F.round(F.when(F.col("a.t") == F.col("b.t"), F.col("a.v")).otherwise(F.col("a.v") + share * (F.col("b.v") - F.col("a.v"))), 6).alias("v"))


def select_intervals(x: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows in any of the closed intervals (lo, hi), a small table; rows in several appear once for each."""
    return x.join(intervals.select("lo", "hi"), (F.col("t") >= F.col("lo")) & (F.col("t") <= F.col("hi"))).select("series", "t", F.round("v", 6).alias("v"), "lo")


def add_gaps(x: DataFrame, lo: float, hi: float) -> DataFrame:
    """Null inside the closed gap; the axis stays."""
    return x.select("series", "t", F.when(~F.col("t").between(lo, hi), F.round("v", 6)).alias("v"))


def remove_part(x: DataFrame, lo: float, hi: float) -> DataFrame:
    return x.where(~F.col("t").between(lo, hi)).select("series", "t", F.round("v", 6).alias("v"))


def remove_range(x: DataFrame, lo: float, hi: float) -> DataFrame:
    """Keep the closed range."""
    return x.where(F.col("t").between(lo, hi)).select("series", "t", F.round("v", 6).alias("v"))


def clip_values(x: DataFrame, lo: float, hi: float) -> DataFrame:
    return x.select("series", "t", F.round(F.least(F.greatest("v", F.lit(lo)), F.lit(hi)), 6).alias("v"))


def sort_unique(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with how many rows each stands for."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg((F.count("*") - 1).alias("removed"))


def standardize(x: DataFrame, method: str = "zscore") -> DataFrame:
    """zscore (n - 1) or minmax; a constant series has null values."""
    if method == "zscore":
        s = F.stddev_samp("v").over(_all())
        z = F.when(s > 0, (F.col("v") - F.avg("v").over(_all())) / s)
    else:
        lo, hi = F.min("v").over(_all()), F.max("v").over(_all())
        z = F.when(hi > lo, (F.col("v") - lo) / (hi - lo))
    return x.select("series", "t", F.round(z, 6).alias("v"))


def log_transform(x: DataFrame, base: float = 10.0) -> DataFrame:
    """Logarithm of positive values; others are null."""
    return x.select("series", "t", F.when(F.col("v") > 0, F.round(F.log("v") / F.log(F.lit(base)), 6)).alias("v"))


def detrend_linear(x: DataFrame) -> DataFrame:
    """Residuals of the least-squares line of each series."""
    fit = x.groupBy("series").agg(F.regr_slope("v", "t").alias("b"), F.regr_intercept("v", "t").alias("a"))
    return x.join(fit, "series").select("series", "t", F.round(F.col("v") - F.col("a") - F.col("b") * F.col("t"), 6).alias("v"))


def local_peaks(x: DataFrame, threshold: float) -> DataFrame:
    """Local maxima strictly above the threshold; ends are no maxima."""
    s = x.select("*", F.lag("v").over(_by_t()).alias("v0"), F.lead("v").over(_by_t()).alias("v1"))
    return s.where((F.col("v") > threshold) & (F.col("v") > F.col("v0")) & (F.col("v") > F.col("v1"))).select("series", "t", F.round("v", 6).alias("v"))


def excursions(x: DataFrame, sds: float) -> DataFrame:
    """Islands of consecutive values more than `sds` population standard deviations from the mean, on one side each."""
    z = (F.col("v") - F.avg("v").over(_all())) / F.stddev_pop("v").over(_all())
    s = x.select("series", "t", F.row_number().over(_by_t()).alias("i"), F.when(z > sds, 1).when(z < -sds, -1).otherwise(0).alias("side"), z.alias("z")).where("side <> 0")
    island = F.col("i") - F.row_number().over(W.partitionBy("series", "side").orderBy("t"))
    return s.withColumn("k", island).groupBy("series", "side", "k").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.count("*").alias("n"), F.round(F.max(F.abs("z")), 6).alias("peak_z")).drop("k")


def lomb_scargle(x: DataFrame, frequencies: list[float]) -> DataFrame:
    """Normalised power at each of the given frequencies, a bounded list. The phase offset is found in one pass, the power in a second."""
    s = x.select("series", "t", (F.col("v") - F.avg("v").over(_all())).alias("z"), F.var_pop("v").over(_all()).alias("var"), F.explode(F.array(*map(F.lit, frequencies))).alias("f"))
    w = 2 * 3.141592653589793 * F.col("f")
    tau = s.groupBy("series", "f").agg(F.atan2(F.sum(F.sin(2 * w * F.col("t"))), F.sum(F.cos(2 * w * F.col("t")))).alias("tau2")).withColumn("tau", F.col("tau2") / (2 * w)).drop("tau2")
    a = w * (F.col("t") - F.col("tau"))
    p = s.join(tau, ["series", "f"]).groupBy("series", "f").agg(F.sum(F.col("z") * F.cos(a)).alias("c"), F.sum(F.col("z") * F.sin(a)).alias("s"), F.sum(F.cos(a) * F.cos(a)).alias("cc"), F.sum(F.sin(a) * F.sin(a)).alias("ss"), F.first("var").alias("var"))
    return p.select("series", "f", F.round((F.col("c") * F.col("c") / F.col("cc") + F.col("s") * F.col("s") / F.col("ss")) / (2 * F.col("var")), 5).alias("power"))


def circular_spectrum(df: DataFrame, group: str, degrees: Column, n: int) -> DataFrame:
    """Squared resultant length of k times the angle, k = 1..n."""
    a = df.select(F.col(group).alias("grp"), F.radians(degrees).alias("a"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"))
    s = a.groupBy("grp", "k").agg(F.avg(F.cos(F.col("a") * F.col("k"))).alias("c"), F.avg(F.sin(F.col("a") * F.col("k"))).alias("s"))
    return s.select("grp", "k", F.round(F.col("c") * F.col("c") + F.col("s") * F.col("s"), 6).alias("power"))


def markov_chi_square(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Transitions between successive states of each key, their expected counts r c / n, chi-square and its degrees of freedom."""
    nxt = F.lead(state).over(W.partitionBy(key).orderBy(*order))
    cells = df.select(F.col(state).alias("a"), nxt.alias("b")).where("b is not null").groupBy("a", "b").agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy("a").agg(F.sum("o").alias("rt")), cells.groupBy("b").agg(F.sum("o").alias("ct"))
    q = cells.join(rows, "a").join(cols, "b").agg(F.sum("o").alias("n"), F.sum(F.col("o").cast("double") * F.col("o") / (F.col("rt").cast("double") * F.col("ct"))).alias("q"), F.count_distinct("a").alias("s"))
    return q.select("n", F.round(F.col("n") * (F.col("q") - 1), 5).alias("chi2"), ((F.col("s") - 1) * (F.col("s") - 1)).alias("df"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks over rows where both values are there."""
    x = df.select(F.monotonically_increasing_id().alias("id"), missing(a).alias("a"), missing(b).alias("b")).where("a is not null and b is not null")
    r = average_ranks(x, "a").select("id", "b", F.col("avg_rank").alias("ra"))
    r = average_ranks(r, "b").select("ra", F.col("avg_rank").alias("rb"))
    return r.agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("rho"))
