"""More on communities (sample, taxon, n): rarefaction, standardised subsampling, abundance models, richness intervals.

Counts are whole numbers. Curves have a row a point; taxa with equal counts are added up first, so a point costs a sample's
distinct counts.
"""

from __future__ import annotations

import math
import statistics

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions import special
from ammolite.functions.columns import ratio


def _log_choose(n: Column, k: Column) -> Column:
    return special.lgamma(n + 1.0) - special.lgamma(k + 1.0) - special.lgamma(n - k + 1.0)


def _expected(counts: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Sum over (keys, n, c taxa with it, all) of c (1 - C(all - n, m) / C(all, m)) at the sizes (keys, m)."""
    x = counts.join(sizes, keys) if keys else counts.join(F.broadcast(sizes))
    rest = F.col("all") - F.col("n")
    x = x.withColumn("up", _log_choose(F.greatest(rest, F.col("m")), F.col("m"))).withColumn("down", _log_choose(F.col("all"), F.col("m")))
    return x.groupBy(*keys, "m").agg(F.sum(F.col("c") * F.when(rest < F.col("m"), 1.0).otherwise(1 - F.exp(F.col("up") - F.col("down")))).alias("e"))


def rarefaction(x: DataFrame, points: int = 50) -> DataFrame:
    """Hurlbert's expected taxa of each sample at up to `points` whole sizes from 1 to half of its individuals."""
    counts = x.groupBy("sample", F.round("n").alias("n")).agg(F.count("*").alias("c")).withColumn("all", F.sum(F.col("n") * F.col("c")).over(W.partitionBy("sample")))
    top = F.least(F.floor(F.col("all") / 2), F.col("all") - 1)
    sizes = counts.select("sample", "all").distinct().where("all >= 2").select("sample", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"), top.alias("top"))
    sizes = sizes.select("sample", F.floor(1 + F.col("k") * (F.col("top") - 1) / (points - 1) + 1e-9).cast("double").alias("m")).distinct()
    return _expected(counts, sizes, ["sample"]).select("sample", F.col("m").cast("long").alias("m"), F.round("e", 4).alias("expected"))


def sample_rarefaction(x: DataFrame) -> DataFrame:
    """Expected taxa in 1, 2 ... all of the samples, from how many samples hold each taxon."""
    held = x.groupBy("taxon").agg(F.count_distinct("sample").cast("double").alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    n = x.agg(F.count_distinct("sample").cast("double").alias("all"))
    sizes = n.select(F.explode(F.sequence(F.lit(1), F.col("all").cast("int"))).alias("m")).select(F.col("m").cast("double").alias("m"))
    return _expected(held.join(F.broadcast(n)), sizes, []).select(F.col("m").cast("long").alias("m"), F.round("e", 4).alias("expected"))


def _indices(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Richness, Shannon, Simpson and Pielou of positive counts n."""
    total = F.sum("n")
    g = counts.where("n > 0").groupBy(*keys).agg(F.count("*").alias("richness"), (F.log(total) - F.sum(F.col("n") * F.log("n")) / total).alias("h"), (1 - F.sum(F.col("n") * F.col("n")) / (total * total)).alias("d"))
    return g.select(*keys, "richness", F.abs(F.round("h", 6)).alias("shannon"), F.round("d", 6).alias("simpson"), F.when(F.col("richness") > 1, F.round(F.col("h") / F.log("richness"), 6)).alias("pielou"))


def _round_robin(x: DataFrame, quorums: DataFrame) -> DataFrame:
    """Counts left when taxa, the most abundant first (ties by name), give one individual a cycle until the quorum (sample, quorum) is met.

    A taxon has given min(n, c) after c whole cycles; the last cycle's individuals come from the first taxa that still have one.
    c is found from the sorted counts: after c cycles with n_i the counts, the sum of min(n_i, c) has been taken.
    """
    w = W.partitionBy("sample")
    r = x.select("sample", "taxon", F.round("n").alias("n"))
    r = r.withColumn("low", F.row_number().over(w.orderBy("n", F.desc("taxon")))).withColumn("s", F.count("*").over(w)).withColumn("below", F.sum("n").over(w.orderBy("n", F.desc("taxon")).rowsBetween(W.unboundedPreceding, 0)))
    # with all counts up to this one used up, whole cycles so far: n; taken: below + n * taxa above
    r = r.withColumn("taken", F.col("below") + F.col("n") * (F.col("s") - F.col("low")))
    q = r.join(quorums, "sample")
    steps = q.groupBy("sample", "quorum").agg(
        F.max(F.when(F.col("taken") <= F.col("quorum"), F.struct("taken", "n", "low"))).alias("a"), F.max("s").alias("s")
    )
    taken, cycles, rest = F.coalesce("a.taken", F.lit(0.0)), F.coalesce("a.n", F.lit(0.0)), F.col("s") - F.coalesce("a.low", F.lit(0))
    steps = steps.select("sample", "quorum", (cycles + F.when(rest > 0, F.floor((F.col("quorum") - taken) / rest)).otherwise(0)).alias("c"), F.when(rest > 0, (F.col("quorum") - taken) % rest).otherwise(0).alias("extra"))
    q = r.join(steps, "sample").withColumn("place", F.row_number().over(W.partitionBy("sample", "quorum", (F.col("n") > F.col("c"))).orderBy(F.desc("n"), "taxon")))
    return q.select("sample", "quorum", "taxon", (F.least("n", "c") + F.when((F.col("n") > F.col("c")) & (F.col("place") <= F.col("extra")), 1).otherwise(0)).alias("n"))


def sqs_subsample(x: DataFrame, quorum: int) -> DataFrame:
    """Diversity of each sample reduced to `quorum` individuals, taken in turns; samples with fewer are left out."""
    q = x.groupBy("sample").agg(F.sum(F.round("n")).alias("t")).where(F.col("t") >= quorum).select("sample", F.lit(float(quorum)).alias("quorum"))
    return _indices(_round_robin(x, q), ["sample", "quorum"])


def diversity_profile(x: DataFrame, points: int = 20) -> DataFrame:
    """Diversity of each sample at up to `points` whole depths from 1 to its individuals."""
    t = x.groupBy("sample").agg(F.sum(F.round("n")).alias("t"))
    k = F.least(F.lit(points), F.col("t").cast("int"))
    q = t.select("sample", "t", k.alias("k"), F.explode(F.sequence(F.lit(0), k - 1)).alias("i"))
    q = q.select("sample", F.floor(1 + F.col("i") * (F.col("t") - 1) / F.greatest(F.col("k") - 1, F.lit(1)) + 1e-9).cast("double").alias("quorum")).distinct()
    return _indices(_round_robin(x, q), ["sample", "quorum"])


def sample_accumulation(x: DataFrame, most: int) -> DataFrame:
    """Taxa against the number of samples m = 1 .. most, straight through what was seen: slope f1 / m0 up to the m0 samples and f1 / (coverage m0) beyond, never falling, at least min(1, seen)."""
    f = x.groupBy("taxon").agg(F.count("*").alias("k")).agg(F.count("*").alias("s"), F.count_if(F.col("k") == 1).alias("f1"), F.count_if(F.col("k") == 2).alias("f2")).join(x.agg(F.count_distinct("sample").alias("m0")))
    f1, f2, m0 = F.col("f1"), F.col("f2"), F.col("m0")
    inner = (1 - f2 / (f1 + 1)) * (m0 - 1) / (m0 - 2) + f2 / ((f1 + 1) * (m0 - 2))
    c = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(f1 == 0, 1.0).when(m0 < 3, 1 - f1 / m0).otherwise(1 - f1 / m0 * inner)))
    p = f.withColumn("c", c).select("*", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("m"))
    delta = (F.col("m") - m0) / m0
    e = F.col("s") + delta * F.when(F.col("m") <= m0, f1).otherwise(F.when(F.col("c") > 0, f1 / F.col("c")).otherwise(0.0))
    p = p.select("m", F.greatest(e, F.least(F.lit(1.0), F.col("s"))).alias("e"), (F.col("m") > m0).alias("extrapolated"))
    return p.select(F.col("m").cast("long").alias("m"), F.round(F.max("e").over(W.orderBy("m").rowsBetween(W.unboundedPreceding, 0)), 6).alias("expected"), "extrapolated")


def chao1_interval(x: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Chao1 of each sample with its interval [chao1 / k, chao1 k], k from the logarithm's variance."""
    z = statistics.NormalDist().inv_cdf(0.5 + confidence / 2)
    g = x.groupBy("sample").agg(F.count("*").alias("s"), F.sum("n").alias("n"), F.count_if(F.col("n") == 1).cast("double").alias("f1"), F.count_if(F.col("n") == 2).cast("double").alias("f2"))
    f1, f2 = F.col("f1"), F.col("f2")
    g = g.withColumn("chao1", F.col("s") + F.when(f2 > 0, f1 * f1 / (2 * f2)).otherwise(f1 * (f1 - 1) / 2))
    a, r = 2 * f2 / ((F.col("n") - 1) * f1 + 2 * f2), f1 / f2
    v = F.when((f2 > 0) & (f1 > 0), f2 * (a / 4 * F.pow(r, 4) + a * a / 2 * F.pow(r, 3) + a * a / 2 * r * r + a * a / 4 * r)).when(f1 > 1, f1 * (f1 - 1) / 2).otherwise(0.0)
    k = F.exp(z * F.sqrt(F.log(1 + v / (F.col("chao1") * F.col("chao1")))))
    return g.select("sample", F.round("chao1", 4).alias("chao1"), F.round(F.col("chao1") / k, 4).alias("low"), F.round(F.col("chao1") * k, 4).alias("high"))


def _ranked(x: DataFrame) -> DataFrame:
    w = W.partitionBy("sample")
    return x.select("sample", "n", F.row_number().over(w.orderBy(F.desc("n"), "taxon")).alias("k"), F.count("*").over(w).alias("s"), F.sum("n").over(w).alias("t"))


def _fit(r: DataFrame, predicted: Column, parameters: int) -> DataFrame:
    """r squared and AIC (n ln of the mean square plus 2 k) of predicted abundances."""
    e = r.withColumn("e", F.col("n") - predicted)
    g = e.groupBy("sample").agg(F.count("*").alias("taxa"), F.sum(F.col("e") * F.col("e")).alias("rss"), (F.var_pop("n") * F.count("n")).alias("sst"))
    return g.select("sample", "taxa", F.round(1 - F.col("rss") / F.nullif(F.col("sst"), F.lit(0.0)), 5).alias("r_squared"), F.round(F.col("taxa") * F.log(F.col("rss") / F.col("taxa")) + 2 * parameters, 3).alias("aic"))


def broken_stick(x: DataFrame) -> DataFrame:
    """MacArthur's broken stick against ranked abundances: (t / s) times the sum of 1 / i from the rank to s."""
    tail = F.sum(1 / F.col("k")).over(W.partitionBy("sample").orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0))
    return _fit(_ranked(x).withColumn("p", F.col("t") / F.col("s") * tail), F.col("p"), 1)


def geometric_series(x: DataFrame, steps: int = 98) -> DataFrame:
    """Motomura's geometric series with the ratio of an even grid in [0.01, 0.99] that fits ranked abundances best, the smaller of equals."""
    r = _ranked(x).select("*", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i")).withColumn("c", F.round(0.01 + F.col("i") * (0.98 / steps), 6))
    p = F.col("t") * F.pow("c", F.col("k") - 1) * (1 - F.col("c")) / (1 - F.pow("c", F.col("s")))
    g = r.withColumn("e", F.col("n") - p).groupBy("sample", "c").agg(F.count("*").alias("taxa"), F.sum(F.col("e") * F.col("e")).alias("rss"))
    best = g.groupBy("sample").agg(F.min_by(F.struct("c", "taxa", "rss"), F.struct(F.round("rss", 6), "c")).alias("b")).select("sample", "b.*")
    return best.select("sample", F.col("c").alias("ratio"), "taxa", F.round(F.col("taxa") * F.log(F.col("rss") / F.col("taxa")) + 2, 3).alias("aic"))


def log_normal(x: DataFrame) -> DataFrame:
    """Preston's curve ln S(r) = ln s0 - a r^2 through the octaves (floor of log2(n + 1)) that hold a taxon; null under three octaves."""
    o = x.groupBy("sample", F.floor(F.log2(F.col("n") + 1) + 1e-12).alias("r")).agg(F.count("*").alias("c"))
    g = o.groupBy("sample").agg(F.count("*").alias("octaves"), F.regr_slope(F.log("c"), F.col("r") * F.col("r")).alias("b"), F.regr_intercept(F.log("c"), F.col("r") * F.col("r")).alias("a"))
    some = F.col("octaves") >= 3
    return g.select("sample", "octaves", F.when(some, F.round(F.exp("a"), 5)).alias("s0"), F.when(some, F.round(-F.col("b"), 6)).alias("a"))


def fisher_alpha(x: DataFrame, rounds: int = 60) -> DataFrame:
    """Fisher's alpha and x of the log series: x / ((1 - x) ln(1 / (1 - x))) = individuals / taxa, by halving; null where every taxon is single."""
    g = x.groupBy("sample").agg(F.count("*").alias("s"), F.sum("n").alias("n")).where("n > s")

    def halve(e: Column, _) -> Column:
        # the logarithm of 1 - x is halved: 1 - x may be very small
        mid = (e["lo"] + e["hi"]) / 2
        more = (1 - F.exp(mid)) / (F.exp(mid) * -mid) > F.col("n") / F.col("s")
        return F.struct(F.when(more, mid).otherwise(e["lo"]).alias("lo"), F.when(more, e["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(math.log(1e-12)).alias("lo"), F.lit(math.log(1 - 1e-9)).alias("hi")), halve)
    g = g.withColumn("y", F.exp(found["lo"]))
    return g.select("sample", "s", F.col("n").cast("long").alias("n"), F.round(F.col("s") / -F.log("y"), 4).alias("alpha"), F.round(1 - F.col("y"), 6).alias("x"))


def c_score(x: DataFrame, least: float = 0.0) -> DataFrame:
    """Mean of (r_i - shared)(r_j - shared) over all pairs of taxa, and the share of pairs that never meet; r is the number of samples that hold a taxon.
    A taxon is present where it has at least `least` individuals.

    Pairs that share nothing need no rows: over all pairs the sum of r_i r_j comes from the totals.
    """
    held = x.where(F.col("n") >= least).select("sample", "taxon").distinct()
    r = held.groupBy("taxon").agg(F.count("*").cast("double").alias("r"))
    h = held.join(r, "taxon")
    met = h.select("sample", F.col("taxon").alias("a"), F.col("r").alias("ra")).join(h.select("sample", F.col("taxon").alias("b"), F.col("r").alias("rb")), "sample").where("a < b")
    met = met.groupBy("a", "b", "ra", "rb").agg(F.count("*").alias("s")).agg(F.count("*").alias("meeting"), F.sum((F.col("ra") - F.col("s")) * (F.col("rb") - F.col("s")) - F.col("ra") * F.col("rb")).alias("gap"))
    t = r.agg(F.count("*").cast("double").alias("k"), ((F.pow(F.sum("r"), 2) - F.sum(F.col("r") * F.col("r"))) / 2).alias("all"))
    pairs = F.col("k") * (F.col("k") - 1) / 2
    return t.join(met).select(F.col("k").cast("long").alias("taxa"), F.round((F.col("all") + F.coalesce("gap", F.lit(0.0))) / pairs, 6).alias("c_score"), F.round(1 - F.col("meeting") / pairs, 6).alias("checkerboard"))


def group_diversity(x: DataFrame, groups: DataFrame) -> DataFrame:
    """Welch's and the pooled t of Shannon's and Simpson's index between the first two groups (sample, grp) in order.

    Indices are rounded, so rich samples may all have the same: without variance t is infinite, or NaN where the means are equal too.
    """
    d = _indices(x, ["sample"]).join(groups, "sample").select("grp", F.explode(F.create_map(F.lit("shannon"), F.col("shannon"), F.lit("simpson"), F.col("simpson"))).alias("index", "v"))
    g = d.groupBy("index", "grp").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s2")).withColumn("k", F.row_number().over(W.partitionBy("index").orderBy("grp"))).where("k <= 2")
    t = g.groupBy("index").agg(*(F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}") for c in ("n", "m", "s2") for k in (1, 2)))
    n1, n2, v1, v2, gap = F.col("n1"), F.col("n2"), F.col("s21"), F.col("s22"), F.col("m1") - F.col("m2")
    pooled = ratio((n1 - 1) * v1 + (n2 - 1) * v2, (n1 + n2 - 2).cast("double"))
    return t.select("index", "n1", "n2", F.round(ratio(gap, F.sqrt(v1 / n1 + v2 / n2)), 5).alias("t_welch"), F.round(ratio(gap, F.sqrt(pooled * (1 / n1 + 1 / n2))), 5).alias("t_pooled"))
