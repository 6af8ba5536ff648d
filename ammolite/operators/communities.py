"""Distances between communities and what is built on them. Communities are long rows (sample, taxon, n).

Pair statistics come from an equality join on the taxon, so only shared taxa meet; a pair that shares nothing is filled in
from the samples' own totals. The result itself has a row for every pair of samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions.columns import average_ranks
from ammolite.functions.storage import cut


def communities(df: DataFrame, sample: str, taxon: str, count: str) -> DataFrame:
    """(sample, taxon, n) with positive counts, one row each."""
    return df.groupBy(F.col(sample).alias("sample"), F.col(taxon).alias("taxon")).agg(F.sum(count).cast("double").alias("n")).where("n > 0")


def _pairs(x: DataFrame) -> DataFrame:
    """Shared sums and own totals of all sample pairs i < j."""
    a, b = x.select(F.col("sample").alias("i"), "taxon", F.col("n").alias("u")), x.select(F.col("sample").alias("j"), "taxon", F.col("n").alias("v"))
    shared = a.join(b, "taxon").where("i < j").groupBy("i", "j").agg(F.count("*").alias("a"), F.sum(F.least("u", "v")).alias("low"), F.sum(F.col("u") * F.col("v")).alias("dot"), F.sum(F.abs(F.col("u") - F.col("v")) / (F.col("u") + F.col("v"))).alias("canberra"))
    own = x.groupBy("sample").agg(F.count("*").alias("s"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"))
    left = own.select(F.col("sample").alias("i"), F.col("s").alias("si"), F.col("t").alias("ti"), F.col("q").alias("qi"))
    right = own.select(F.col("sample").alias("j"), F.col("s").alias("sj"), F.col("t").alias("tj"), F.col("q").alias("qj"))
    every = left.join(right, F.col("i") < F.col("j"))
    return every.join(shared, ["i", "j"], "left").fillna(0, ["a", "low", "dot", "canberra"])


def pair_distances(x: DataFrame) -> DataFrame:
    """Bray-Curtis, Jaccard, Euclidean, Manhattan, Canberra and cosine distances of all pairs i < j."""
    p = _pairs(x)
    total = F.col("ti") + F.col("tj")
    return p.select(
        "i", "j", F.round(1 - 2 * F.col("low") / total, 6).alias("bray_curtis"), F.round(1 - F.col("a") / (F.col("si") + F.col("sj") - F.col("a")), 6).alias("jaccard"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("qi") + F.col("qj") - 2 * F.col("dot"))), 6).alias("euclidean"), F.round(total - 2 * F.col("low"), 6).alias("manhattan"),
        F.round(F.col("canberra") + (F.col("si") - F.col("a")) + (F.col("sj") - F.col("a")), 6).alias("canberra"), F.round(1 - F.col("dot") / F.sqrt(F.col("qi") * F.col("qj")), 6).alias("cosine"),
    )


def beta_diversity(x: DataFrame) -> DataFrame:
    """Shared and own taxa of each pair with the Jaccard and Sørensen partitions (the latter's turnover is min / (2a + min))."""
    p = _pairs(x).select("i", "j", F.col("a").cast("long").alias("a"), (F.col("si") - F.col("a")).cast("long").alias("b"), (F.col("sj") - F.col("a")).cast("long").alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    low, high = F.least(b, c), F.greatest(b, c)
    return p.select(
        "i", "j", "a", "b", "c", F.round((b + c) / (a + b + c), 6).alias("beta_jac"), F.round(F.coalesce(2 * low / F.nullif(a + 2 * low, F.lit(0)), F.lit(0.0)), 6).alias("beta_jtu"),
        F.round(F.coalesce(a * (high - low) / F.nullif((a + b + c) * (a + 2 * low), F.lit(0)), F.lit(0.0)), 6).alias("beta_jne"), F.round((b + c) / (2 * a + b + c), 6).alias("beta_sor"),
        F.round(F.coalesce(low / F.nullif(2 * a + low, F.lit(0)), F.lit(0.0)), 6).alias("beta_sim"), F.round(F.coalesce(2 * a * high / F.nullif((2 * a + b + c) * (2 * a + low), F.lit(0)), F.lit(0.0)), 6).alias("beta_sne"),
    )


def _grouped(pairs: DataFrame, distance: str, groups: DataFrame) -> DataFrame:
    g = groups.select("sample", "grp")
    return pairs.select("i", "j", F.col(distance).alias("d")).join(g.select(F.col("sample").alias("i"), F.col("grp").alias("gi")), "i").join(g.select(F.col("sample").alias("j"), F.col("grp").alias("gj")), "j")


def permanova(pairs: DataFrame, distance: str, groups: DataFrame) -> DataFrame:
    """Pseudo-F and R² of a grouping (sample, grp): sums of squares over unordered pairs, divided by n and by group sizes."""
    sizes = groups.groupBy("grp").agg(F.count("*").alias("m"))
    d = _grouped(pairs, distance, groups)
    within = d.where("gi = gj").groupBy(F.col("gi").alias("grp")).agg(F.sum(F.col("d") * F.col("d")).alias("w")).join(sizes, "grp").agg(F.sum(F.col("w") / F.col("m")).alias("ssw"))
    total = d.agg(F.sum(F.col("d") * F.col("d")).alias("t"))
    n = sizes.agg(F.sum("m").alias("n"), F.count("*").alias("g"))
    s = total.join(within).join(n)
    sst = F.col("t") / F.col("n")
    return s.select("n", "g", F.round(((sst - F.col("ssw")) / (F.col("g") - 1)) / (F.col("ssw") / (F.col("n") - F.col("g"))), 5).alias("f"), F.round(1 - F.col("ssw") / sst, 6).alias("r2"))


def anosim(pairs: DataFrame, distance: str, groups: DataFrame) -> DataFrame:
    """R from average ranks of the distances between and within groups."""
    d = _grouped(pairs, distance, groups).select(F.col("d").alias("v"), (F.col("gi") == F.col("gj")).alias("same"))
    r = average_ranks(d).agg(F.avg(F.when(F.col("same"), F.col("avg_rank"))).alias("w"), F.avg(F.when(~F.col("same"), F.col("avg_rank"))).alias("b"), F.count("*").alias("m"))
    return r.select(F.col("m").alias("pairs"), F.round((F.col("b") - F.col("w")) / (F.col("m") / 2), 6).alias("r"))


def simper(x: DataFrame, groups: DataFrame, first: object, second: object) -> DataFrame:
    """Each taxon's mean contribution to the Bray-Curtis dissimilarity over all pairs of samples from two groups, largest share first."""
    g = groups.where(F.col("grp").isin(first, second))
    x = cut(x.join(F.broadcast(g.select("sample", "grp")), "sample").select("sample", "grp", "taxon", "n"), "held")
    own = x.groupBy("sample", "grp").agg(F.sum("n").alias("t"))
    counts = own.agg((F.count_if(F.col("grp") == F.lit(first)) * F.count_if(F.col("grp") == F.lit(second))).alias("m"))
    # |u - v| = u + v - 2 min(u, v): what a sample holds counts once with the reciprocal totals of all its pairs, and only samples that share a taxon meet in it
    total = lambda which, t: own.where(F.col("grp") == F.lit(which)).select(F.col("sample").alias(f"s{t}"), F.col("t").alias(t))
    pairs = cut(total(first, "ti").join(total(second, "tj"), how="cross").withColumn("r", 1 / (F.col("ti") + F.col("tj"))), "pairs")
    weight = lambda t: pairs.groupBy(F.col(f"s{t}").alias("sample")).agg(F.sum("r").alias("weight"), F.first(t).alias("t"))
    held = lambda t: x.select("sample", "taxon", "n").join(F.broadcast(weight(t)), "sample")
    one = held("ti").unionByName(held("tj")).select("taxon", (F.col("n") * F.col("weight")).alias("c"))
    a, b = (held(t).select("taxon", F.col("n").alias(n), F.col("t").alias(t)) for t, n in (("ti", "u"), ("tj", "v")))
    both = a.join(b, "taxon").select("taxon", (-2 * F.least("u", "v") / (F.col("ti") + F.col("tj"))).alias("c"))
    c = one.unionByName(both).groupBy("taxon").agg(F.sum("c").alias("s"))
    s = cut(c.join(F.broadcast(counts)).where("m > 0").select("taxon", (F.greatest(F.col("s"), F.lit(0.0)) / F.col("m")).alias("average")), "averages")
    whole = s.agg(F.sum("average").alias("overall"))
    return s.join(F.broadcast(whole)).select("taxon", F.round("average", 8).alias("average"), F.round(F.col("average") / F.col("overall"), 8).alias("share"))


def mantel(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of two distances over all pairs."""
    return pairs.agg(F.count("*").alias("pairs"), F.round(F.corr(a, b), 6).alias("r"))


def disparity(pairs: DataFrame, distance: str) -> DataFrame:
    """Mean, maximum, population variance and median of the pairwise distances."""
    return pairs.agg(F.round(F.avg(distance), 6).alias("dispersion"), F.round(F.max(distance), 6).alias("rng"), F.round(F.var_pop(distance), 6).alias("variance"), F.round(F.expr(f"percentile({distance}, 0.5)"), 6).alias("median"))


def sample_coverage(x: DataFrame) -> DataFrame:
    """Incidence coverage over samples from the taxa found in one and in two of them, with the expected unseen taxa."""
    f = x.groupBy("taxon").agg(F.count("*").alias("k")).agg(F.count("*").alias("s_obs"), F.count_if(F.col("k") == 1).alias("f1"), F.count_if(F.col("k") == 2).alias("f2"))
    m = x.agg(F.count_distinct("sample").alias("m"))
    s = f.join(m)
    f1, f2, k = F.col("f1"), F.col("f2"), F.col("m")
    inner = (1 - f2 / (f1 + 1)) * (k - 1) / (k - 2) + f2 / ((f1 + 1) * (k - 2))
    c = F.when(f1 == 0, 1.0).when(k < 3, 1 - f1 / k).otherwise(1 - f1 / k * inner)
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return s.select("m", "s_obs", "f1", "f2", F.round(c, 6).alias("coverage"), F.round(k * (1 - c), 6).alias("tau"), F.when(c > 0, F.round(f1 * (1 - c) / c, 6)).alias("unseen"))


def she(x: DataFrame) -> DataFrame:
    """Richness, Shannon entropy and evenness of the first k samples pooled, k = 1..n.

    A taxon's pooled count changes only at the samples that hold it, so its steps are summed by sample first; the window
    that adds them up has one row for each sample.
    """
    w = W.partitionBy("taxon").orderBy("sample").rowsBetween(W.unboundedPreceding, W.currentRow)
    c = x.select("sample", "n", F.sum("n").over(w).alias("after")).withColumn("before", F.col("after") - F.col("n"))
    xlogx = lambda v: F.when(F.col(v) > 0, F.col(v) * F.log(v)).otherwise(0.0)
    step = c.groupBy("sample").agg(F.count_if(F.col("before") == 0).alias("s"), F.sum("n").alias("n"), F.sum(xlogx("after") - xlogx("before")).alias("l"))
    o = W.orderBy("sample").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = step.select(F.row_number().over(W.orderBy("sample")).alias("k"), F.sum("s").over(o).alias("s"), F.sum("n").over(o).alias("n"), F.sum("l").over(o).alias("l"))
    h = F.log("n") - F.col("l") / F.col("n")
    return t.select("k", "s", F.round(h, 6).alias("h"), F.when(F.col("s") == 1, 1.0).otherwise(F.round(F.exp(h) / F.col("s"), 6)).alias("exp_evenness"), F.when(F.col("s") == 1, 1.0).otherwise(F.round(h / F.log("s"), 6)).alias("evenness"))
