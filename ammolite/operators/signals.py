"""More operators on ordered series (series, t, v): peaks, smoothing, spectra's shape, persistence, resampling of values, alignment.

As in `series`, windows are partitioned by series and ordered by t, which is unique in it; a series is a task's work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions import special
from ammolite.functions.columns import missing
from ammolite.operators.series import _all, _by_t, range_frame


#: Added before rounding where many values are decimal halves: sums in another order then round alike.
TIE = 1e-9


def _numbered(x: DataFrame) -> DataFrame:
    return x.withColumn("i", F.row_number().over(_by_t()))


def spectral_peaks(spectrum: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of (series, f, power) the highest point of each run above `threshold` times the highest power, the first of equals."""
    s = spectrum.withColumn("top", F.max("power").over(_all())).withColumn("i", F.row_number().over(W.partitionBy("series").orderBy("f")))
    s = s.where(F.col("power") > threshold * F.col("top")).withColumn("run", F.col("i") - F.row_number().over(W.partitionBy("series").orderBy("f")))
    p = s.groupBy("series", "run").agg(F.max_by(F.struct("f", "power", "top"), F.struct("power", -F.col("f"))).alias("p")).select("series", "p.*")
    return p.select("series", "f", F.round(1 / F.col("f"), 6).alias("period"), "power", F.round(F.col("power") / F.col("top"), 6).alias("relative_power"))


def spectral_moments(spectrum: DataFrame) -> DataFrame:
    """Trapezoid moments 0 to 2 of a spectrum (series, f, power), its centroid, bandwidth, skewness and excess kurtosis."""
    w = W.partitionBy("series").orderBy("f")
    s = spectrum.select("series", "f", "power", F.lead("f").over(w).alias("f1"), F.lead("power").over(w).alias("p1")).where("f1 is not null")
    area = lambda g: F.sum((g(F.col("f")) * F.col("power") + g(F.col("f1")) * F.col("p1")) / 2 * (F.col("f1") - F.col("f")))
    m = s.groupBy("series").agg(*(area(lambda f, k=k: F.pow(f, k)).alias(f"m{k}") for k in range(3)))
    c = s.join(m, "series").withColumn("c", F.col("m1") / F.col("m0"))
    z = c.groupBy("series", "m0", "m1", "m2", "c").agg(*(area(lambda f, k=k: F.pow(f - F.col("c"), k)).alias(f"z{k}") for k in (2, 3, 4)))
    b = F.sqrt(F.greatest(F.lit(0.0), F.col("z2") / F.col("m0")))
    return z.select("series", *(F.round(f"m{k}", 6).alias(f"m{k}") for k in range(3)), F.round("c", 6).alias("centroid"), F.round(b, 6).alias("bandwidth"), F.round(F.col("z3") / F.col("m0") / F.pow(b, 3), 4).alias("skewness"), F.round(F.col("z4") / F.col("m0") / F.pow(b, 4) - 3, 4).alias("kurtosis"))


def ar1_rho(x: DataFrame) -> DataFrame:
    """Lag-1 coefficient by Yule and Walker: centred products over the squares of the earlier values."""
    z = x.select("series", "t", (F.col("v") - F.avg("v").over(_all())).alias("z"))
    z = z.withColumn("z0", F.lag("z").over(_by_t())).where("z0 is not null")
    return z.groupBy("series").agg((F.count("*") + 1).alias("n"), F.round(F.sum(F.col("z") * F.col("z0")) / F.sum(F.col("z0") * F.col("z0")), 6).alias("rho"))


def ar1_spectrum(rho: DataFrame, frequencies: list[float], dt: float) -> DataFrame:
    """Power of red noise with the lag-1 coefficients `rho` (series, rho) at the given frequencies, a bounded list."""
    s = rho.select("series", "rho", F.explode(F.array(*map(F.lit, frequencies))).alias("f"))
    r = F.col("rho")
    return s.select("series", "f", F.round((1 - r * r) / (1 - 2 * r * F.cos(2 * math.pi * F.col("f") * dt) + r * r), 6).alias("power"))


def prewhiten(x: DataFrame) -> DataFrame:
    """AIC (n ln of the variance, plus 2) of what an AR(1) step and a first difference leave, and which is lower."""
    z = x.select("series", "t", "v", (F.col("v") - F.avg("v").over(_all())).alias("z"))
    z = z.select("*", F.lag("z").over(_by_t()).alias("z0"), F.lag("v").over(_by_t()).alias("v0")).where("z0 is not null")
    phi = z.groupBy("series").agg((F.sum(F.col("z") * F.col("z0")) / F.sum(F.col("z0") * F.col("z0"))).alias("phi"))
    r = z.join(phi, "series").groupBy("series", "phi").agg(F.count("*").alias("n"), F.var_pop(F.col("z") - F.col("phi") * F.col("z0")).alias("va"), F.var_pop(F.col("v") - F.col("v0")).alias("vd"))
    aic = lambda c: F.col("n") * F.log(c) + 2
    return r.select("series", "n", F.round("phi", 6).alias("phi"), F.round(aic("va"), 4).alias("aic_ar1"), F.round(aic("vd"), 4).alias("aic_difference"), F.when(aic("va") <= aic("vd"), "ar1").otherwise("difference").alias("chosen"))


def autoassociation(x: DataFrame, width: float, most: float) -> DataFrame:
    """Mean product of standardised values of pairs by distance in t, in bins of `width` up to `most`: only pairs so near are made."""
    z = x.select("series", "t", ((F.col("v") - F.avg("v").over(_all())) / F.stddev_pop("v").over(_all())).alias("z"))
    # equality on blocks of `most`: a pair lies in one block or in neighbouring ones
    a = z.withColumn("block", F.floor(F.col("t") / most)).select("series", F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"), "t", "z")
    b = z.select("series", F.floor(F.col("t") / most).alias("block"), F.col("t").alias("t2"), F.col("z").alias("z2"))
    p = a.join(b, ["series", "block"]).where((F.col("t2") > F.col("t")) & (F.col("t2") - F.col("t") <= most))
    bin_ = F.floor((F.col("t2") - F.col("t")) / width + 1e-6)
    return p.groupBy("series", bin_.alias("bin")).agg(F.count("*").alias("pairs"), F.round(F.avg(F.col("z") * F.col("z2")), 6).alias("association"), F.round(F.corr("z", "z2"), 6).alias("r"))


def moving_average(x: DataFrame, span: int, mode: str = "smooth") -> DataFrame:
    """smooth: rows to either side up to span // 2, fewer at the ends; trailing: the row and those before it."""
    w = _by_t().rowsBetween(-(span // 2), span // 2) if mode == "smooth" else _by_t().rowsBetween(1 - span, 0)
    return x.select("series", "t", F.round(F.avg("v").over(w), 6).alias("v"))


def bandwidth_average(x: DataFrame, bandwidth: float) -> DataFrame:
    """Mean over the closed interval of t around each row."""
    return x.select("series", "t", F.round(F.expr(f"avg(v) {range_frame(bandwidth)}") + TIE, 6).alias("v"))


def find_n_peaks(x: DataFrame, n: int) -> DataFrame:
    """The n highest local maxima of each series (strictly above both neighbours), the earlier of equals; series with fewer give what they have."""
    s = x.select("*", F.lag("v").over(_by_t()).alias("v0"), F.lead("v").over(_by_t()).alias("v1")).where("v > v0 and v > v1")
    return s.withColumn("place", F.row_number().over(W.partitionBy("series").orderBy(F.desc("v"), "t"))).where(F.col("place") <= n).select("series", "t", F.round("v", 6).alias("v"), "place")


def remove_peaks(x: DataFrame, threshold: float, fill: bool = True) -> DataFrame:
    """Local maxima strictly above the threshold become null or, with `fill`, lie on the line between the nearest values that stay."""
    s = x.select("*", F.lag("v").over(_by_t()).alias("v0"), F.lead("v").over(_by_t()).alias("v1"))
    s = s.select("series", "t", F.when(~F.coalesce((F.col("v") > threshold) & (F.col("v") > F.col("v0")) & (F.col("v") > F.col("v1")), F.lit(False)), F.col("v")).alias("v"))
    if fill:
        known = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
        s = s.select("*", F.last(known, ignorenulls=True).over(_by_t().rowsBetween(W.unboundedPreceding, 0)).alias("a"), F.first(known, ignorenulls=True).over(_by_t().rowsBetween(0, W.unboundedFollowing)).alias("b"))
        s = s.select("series", "t", F.coalesce("v", F.col("a.v") + (F.col("t") - F.col("a.t")) / (F.col("b.t") - F.col("a.t")) * (F.col("b.v") - F.col("a.v"))).alias("v"))
    return s.select("series", "t", F.round("v", 6).alias("v"))


def matched_filter(x: DataFrame, template: list[float]) -> DataFrame:
    """Correlation of each run of values with a short template, at the run's first row; null where the run is constant."""
    k = len(template)
    s = _numbered(x).select("series", "i", "t", "v", F.posexplode(F.array(*map(F.lit, template))).alias("j", "w")).select("series", (F.col("i") - F.col("j")).alias("i"), "j", "t", "v", "w")
    r = s.groupBy("series", "i").agg(F.count("*").alias("n"), F.min("t").alias("t"), F.corr("v", "w").alias("r")).where(F.col("n") == k)
    return r.select("series", "t", F.round(F.when(~F.isnan("r"), F.col("r")), 6).alias("r"))


def pad_series(x: DataFrame, extra: int, mode: str = "zero") -> DataFrame:
    """(series, i, v): values numbered from 0 and `extra` more at the end: zero, edge, mean, periodic, or mirror (at most as many as there are)."""
    s = _numbered(x).select("series", (F.col("i") - 1).alias("i"), "v")
    g = s.groupBy("series").agg(F.count("*").alias("n"), F.max_by("v", "i").alias("last"), F.avg("v").alias("mean"))
    g = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(extra - 1))).alias("k"))
    if mode in ("periodic", "mirror"):
        source = F.pmod(F.col("k"), F.col("n")) if mode == "periodic" else F.col("n") - 1 - F.col("k")
        tail = g.select("series", (F.col("n") + F.col("k")).alias("at"), source.alias("i")).where("i >= 0").join(s, ["series", "i"]).select("series", F.col("at").alias("i"), "v")
    else:
        value = {"zero": F.lit(0.0), "edge": F.col("last"), "mean": F.col("mean")}[mode]
        tail = g.select("series", (F.col("n") + F.col("k")).alias("i"), value.alias("v"))
    return s.select("series", F.col("i").cast("long").alias("i"), "v").unionByName(tail.select("series", F.col("i").cast("long").alias("i"), "v")).select("series", "i", F.round("v", 6).alias("v"))


def cosine_taper(x: DataFrame, share: float = 0.05) -> DataFrame:
    """Weights by place, rising as a cosine from 0 to 1 over the first `share` of a series and falling over the last, and the tapered values."""
    u = (F.row_number().over(_by_t()) - 1) / (F.count("*").over(_all()) - 1)
    edge = F.least(u, 1 - u)
    w = F.when(edge < share, 0.5 - 0.5 * F.cos(math.pi * edge / share)).otherwise(1.0)
    return x.select("series", "t", F.round(w, 6).alias("weight"), F.round(w * F.col("v"), 6).alias("v"))


def cumulative(x: DataFrame, dt: float = 1.0) -> DataFrame:
    """Running sum of v dt."""
    return x.select("series", "t", F.round(F.sum(F.col("v") * dt).over(_by_t().rowsBetween(W.unboundedPreceding, 0)) + TIE, 5).alias("v"))


def robust_line(x: DataFrame, factor: float = 3.0, rounds: int = 3) -> DataFrame:
    """Least-squares line, then `rounds` times again over the points within `factor` times 1.4826 MAD of it (the MAD over all residuals)."""
    fit = lambda s: s.groupBy("series").agg(F.count("*").alias("n"), F.regr_slope("v", "t").alias("b"), F.regr_intercept("v", "t").alias("a"))
    line = fit(x)
    for _ in range(rounds):
        r = x.join(line, "series").withColumn("e", F.col("v") - F.col("a") - F.col("b") * F.col("t"))
        mid = r.groupBy("series").agg(F.expr("percentile(e, 0.5)").alias("m"))
        mad = r.join(mid, "series").groupBy("series", "m").agg((1.4826 * F.expr("percentile(abs(e - m), 0.5)")).alias("s"))
        line = fit(r.join(mad, "series").where(F.abs(F.col("e")) <= factor * F.col("s")).select("series", "t", "v"))
    return line.select("series", F.col("n").alias("inliers"), F.round("b", 8).alias("slope"), F.round("a", 6).alias("intercept"))


def polynomial_trend(x: DataFrame) -> DataFrame:
    """Least-squares parabola v = c0 + c1 u + c2 u^2 with u = (t - mean) / sd (population) of each series, by the normal equations in closed form."""
    u = (F.col("t") - F.avg("t").over(_all())) / F.stddev_pop("t").over(_all())
    s = x.select("series", "v", u.alias("u")).groupBy("series").agg(F.count("*").alias("n"), F.avg("v").alias("y"), F.avg(F.col("u") * F.col("v")).alias("uy"), F.avg(F.col("u") * F.col("u") * F.col("v")).alias("uuy"), F.avg(F.pow("u", 3)).alias("k3"), F.avg(F.pow("u", 4)).alias("k4"))
    # u has mean 0 and mean square 1, which leaves a 2 x 2 system
    c2 = (F.col("uuy") - F.col("y") - F.col("k3") * F.col("uy")) / (F.col("k4") - 1 - F.col("k3") * F.col("k3"))
    s = s.withColumn("c2", c2).withColumn("c1", F.col("uy") - F.col("k3") * F.col("c2")).withColumn("c0", F.col("y") - F.col("c2"))
    return s.select("series", "n", *(F.round(c, 6).alias(c) for c in ("c0", "c1", "c2")))


_POSITION = {"hazen": (0.5, 0.0), "weibull": (0.0, 1.0), "blom": (0.375, 0.25)}


def _positions(df: DataFrame, group: str, value: str, kind: str) -> DataFrame:
    """(grp, v, p): distinct values with their plotting positions (k - a) / (n + b)."""
    a, b = _POSITION[kind]
    x = df.select(F.col(group).alias("grp"), missing(value).alias("v")).where("v is not null").distinct()
    w = W.partitionBy("grp")
    return x.select("grp", "v", ((F.row_number().over(w.orderBy("v")) - a) / (F.count("*").over(w) + b)).alias("p"))


def inverse_percentile(df: DataFrame, group: str, value: str, probabilities: list[float], kind: str = "hazen") -> DataFrame:
    """Values at given probabilities of each group's distinct values, linear between plotting positions, the extremes beyond them."""
    p = _positions(df, group, value, kind).withColumn("q", F.explode(F.array(*map(F.lit, probabilities))))
    below, above = F.col("p") <= F.col("q"), F.col("p") >= F.col("q")
    s = p.groupBy("grp", "q").agg(F.max_by(F.struct("p", "v"), F.when(below, F.col("p"))).alias("a"), F.min_by(F.struct("p", "v"), F.when(above, F.col("p"))).alias("b"), F.max(F.when(below, 1)).alias("has_a"), F.max(F.when(above, 1)).alias("has_b"))
    line = F.col("a.v") + (F.col("q") - F.col("a.p")) / F.nullif(F.col("b.p") - F.col("a.p"), F.lit(0.0)) * (F.col("b.v") - F.col("a.v"))
    out = F.when(F.col("has_a").isNull(), F.col("b.v")).when(F.col("has_b").isNull(), F.col("a.v")).otherwise(F.coalesce(line, F.col("a.v")))
    return s.select("grp", F.col("q").alias("probability"), F.round(out, 6).alias("value"))


def non_exceedance(df: DataFrame, group: str, value: str, quantile: float, kind: str = "hazen") -> DataFrame:
    """Plotting position of the greatest distinct value that is at most `quantile`; 0 where there is none."""
    p = _positions(df, group, value, kind)
    return p.groupBy("grp").agg(F.round(F.coalesce(F.max(F.when(F.col("v") <= quantile, F.col("p"))), F.lit(0.0)), 6).alias("probability"))


def box_cox(value: Column, power: float) -> Column:
    """(x^power - 1) / power, the logarithm for 0; null unless positive."""
    return F.when(value > 0, F.log(value) if power == 0 else (F.pow(value, F.lit(power)) - 1) / power)


def box_cox_inverse(value: Column, power: float) -> Column:
    return F.exp(value) if power == 0 else F.pow(power * value + 1, F.lit(1 / power))


def box_cox_power(df: DataFrame, group: str, value: str, powers: list[float]) -> DataFrame:
    """The power of a bounded grid with the highest profile likelihood -n/2 ln(variance) + (power - 1) sum of logs, by group; only positive values count."""
    x = df.select(F.col(group).alias("grp"), missing(value).alias("v")).where("v > 0")
    g = x.groupBy("grp").agg(F.count("*").alias("n"), F.sum(F.log("v")).alias("l"), *(F.var_pop(box_cox(F.col("v"), p)).alias(f"s{k}") for k, p in enumerate(powers)))
    rows = F.array(*(F.struct((-F.col("n") / 2 * F.log(f"s{k}") + (p - 1) * F.col("l")).alias("likelihood"), F.lit(float(p)).alias("power")) for k, p in enumerate(powers)))
    best = g.select("grp", "n", F.explode(rows).alias("r")).groupBy("grp", "n").agg(F.max_by("r", F.struct("r.likelihood", -F.col("r.power"))).alias("r"))
    return best.select("grp", "n", F.col("r.power").alias("power"), F.round("r.likelihood", 3).alias("likelihood"))


def uniform_sampling(x: DataFrame, tolerance: float = 1e-5, alpha: float = 0.05) -> DataFrame:
    """Whether gaps are alike (largest relative difference from the median gap) and counts in n // 5 even bins are (chi-square and its p)."""
    gaps = x.select("series", "t", (F.col("t") - F.lag("t").over(_by_t())).alias("gap"))
    m = gaps.groupBy("series").agg(F.expr("percentile(gap, 0.5)").alias("m"), F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
    d = gaps.join(m, "series").groupBy("series").agg(F.max(F.abs(F.col("gap") / F.col("m") - 1)).alias("deviation"))
    place = F.least(F.col("k") - 1, F.floor((F.col("t") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.col("k"))))
    # empty bins add their expectation: sum of o^2 / e - n over the bins that hold anything
    c = x.join(m, "series").groupBy("series", "n", "k", place.alias("bin")).agg(F.count("*").alias("o")).groupBy("series", "n", "k").agg((F.sum(F.col("o") * F.col("o")) * F.first("k") / F.first("n") - F.first("n")).alias("chi2"))
    s = c.join(d, "series").withColumn("df", F.col("k") - 1).withColumn("p", special.chi2_sf("chi2", "df"))
    return s.select("series", "n", F.col("k").cast("long").alias("bins"), F.round("deviation", 6).alias("deviation"), F.round("chi2", 5).alias("chi2"), F.round("p", 6).alias("p"), ((F.col("deviation") <= tolerance) & (F.col("p") >= alpha)).alias("uniform"))


def apply_function(x: DataFrame, function: str) -> DataFrame:
    """square, abs, exp or sqrt of the values; outside of a function's domain the value is null."""
    v = F.col("v")
    f = {"square": v * v, "abs": F.abs(v), "exp": F.when(v < 709, F.exp(v)), "sqrt": F.when(v >= 0, F.sqrt(v))}[function]
    return x.select("series", "t", F.round(f, 6).alias("v"))


def merge_series(first: DataFrame, second: DataFrame, keep: str = "first") -> DataFrame:
    """Union of two series tables by (series, t): where both have a value the first's, the second's (last) or the mean stays."""
    both = first.select("series", "t", "v", F.lit(0).alias("src")).unionByName(second.select("series", "t", "v", F.lit(1).alias("src")))
    pick = {"first": F.min_by("v", "src"), "last": F.max_by("v", "src"), "mean": F.avg("v")}[keep]
    return both.groupBy("series", "t").agg(F.round(pick, 6).alias("v"), F.count("*").alias("sources"))


def remove_outliers(x: DataFrame, method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Rows within `threshold` IQRs of the quartiles, or with |z| (population) under it."""
    if method == "iqr":
        q = x.groupBy("series").agg(F.expr("percentile(v, array(0.25, 0.75))").alias("q"))
        far = threshold * (F.col("q")[1] - F.col("q")[0])
        kept = x.join(q, "series").where(F.col("v").between(F.col("q")[0] - far, F.col("q")[1] + far))
    else:
        kept = x.select("*", ((F.col("v") - F.avg("v").over(_all())) / F.stddev_pop("v").over(_all())).alias("z")).where(F.abs("z") < threshold)
    return kept.select("series", "t", F.round("v", 6).alias("v"))


def lb_keogh(x: DataFrame, query: str, reference: str, window: int = 5) -> DataFrame:
    """Lower bound of the warped distance of two series paired by place: how far the query leaves the reference's envelope of rows within `window`."""
    s = _numbered(x)
    w = W.partitionBy("series").orderBy("i").rowsBetween(-window, window)
    r = s.where(F.col("series") == reference).select("i", F.max("v").over(w).alias("hi"), F.min("v").over(w).alias("lo"))
    e = s.where(F.col("series") == query).join(r, "i")
    out = F.when(F.col("v") > F.col("hi"), F.pow(F.col("v") - F.col("hi"), 2)).when(F.col("v") < F.col("lo"), F.pow(F.col("v") - F.col("lo"), 2)).otherwise(0.0)
    return e.agg(F.count("*").alias("n"), F.round(F.sqrt(F.sum(out)), 5).alias("bound"))


def effective_correlation(x: DataFrame, first: str, second: str, lags: int) -> DataFrame:
    """Correlation of two series at shared times with the sample size that their autocorrelations leave: n (1 - s) / (1 + s), s the sum of products of the lagged ones, within [2, n]."""
    a, b = (x.where(F.col("series") == n).select("t", F.col("v").alias(c)) for n, c in ((first, "a"), (second, "b")))
    s = a.join(b, "t").select(F.lit(1).alias("series"), "t", "a", "b")
    d = s.select("series", F.row_number().over(_by_t()).alias("i"), (F.col("a") - F.avg("a").over(_all())).alias("a"), (F.col("b") - F.avg("b").over(_all())).alias("b"))
    whole = d.agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"))
    moved = d.select(F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), "i", F.col("a").alias("a0"), F.col("b").alias("b0")).withColumn("i", F.col("i") + F.col("lag"))
    p = moved.join(d, "i").groupBy("lag").agg(F.sum(F.col("a") * F.col("a0")).alias("pa"), F.sum(F.col("b") * F.col("b0")).alias("pb"))
    t = p.join(F.broadcast(whole)).groupBy("n", "r").agg(F.sum(F.col("pa") / F.col("aa") * F.col("pb") / F.col("bb")).alias("s"))
    n = F.least(F.col("n").cast("double"), F.greatest(F.lit(2.0), F.col("n") * (1 - F.col("s")) / (1 + F.col("s"))))
    t = t.withColumn("m", n).withColumn("t", F.col("r") * F.sqrt((F.col("m") - 2) / (1 - F.col("r") * F.col("r"))))
    return t.select("n", F.round("r", 6).alias("r"), F.round("m", 4).alias("n_effective"), F.round("t", 6).alias("t"))
