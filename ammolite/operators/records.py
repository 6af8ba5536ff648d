"""Records against curves: calibration, nearest and bracketing values, change points, recurrence, segment spectra, false discovery rates, bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.functions import special
from ammolite.operators.permutation import order_key, replicates
from ammolite.operators.series import _all, _by_t, lomb_scargle


def interpolate_nearest(x: DataFrame, at: DataFrame) -> DataFrame:
    """Values at the times `at` (series, t) from the nearest known time, the earlier of two equally near; null outside the known range."""
    both = x.select("series", "t", "v", F.lit(False).alias("asked")).unionByName(at.select("series", F.col("t").cast("double").alias("t"), F.lit(None).cast("double").alias("v"), F.lit(True).alias("asked")))
    known = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    a = F.last(known, ignorenulls=True).over(_by_t().rangeBetween(W.unboundedPreceding, W.currentRow))
    b = F.first(known, ignorenulls=True).over(_by_t().rangeBetween(W.currentRow, W.unboundedFollowing))
    s = both.select("series", "t", "asked", a.alias("a"), b.alias("b")).where("asked")
    near = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.when(F.col("t") - F.col("a.t") <= F.col("b.t") - F.col("t"), F.col("a.v")).otherwise(F.col("b.v")))
    return s.select("series", "t", F.round(near, 6).alias("v"))


def radiocarbon(determinations: DataFrame, curve: DataFrame, delta: float = 0.0, delta_error: float = 0.0, level: float = 0.95) -> DataFrame:
    """Calibrated ages of (id, age, error) on a yearly curve (cal, mu, sigma): median (the year whose cumulative share is nearest to 0.5), most likely year, and the size and ends of the smallest set that holds `level`.

    The curve has a bounded number of years; every determination meets those within eight of its standard errors, in arrays that are gone with the next one:
    no row a year is made or sorted. Determinations of the same id count as one.
    """
    kinds = dict(curve.dtypes)
    years = curve.select("cal", F.col("mu").cast("double"), F.col("sigma").cast("double")).orderBy("cal").toArrow()
    cal, mu, sigma = (years.column(k).to_numpy() for k in range(3))
    kind = years.schema.field("cal").type
    told = determinations.select("id", F.col("age").cast("double"), F.col("error").cast("double")).dropna().groupBy("id").agg(F.collect_list(F.struct("age", "error")).alias("r"))
    held = dict(told.dtypes)["id"]

    def run(batches):
        for batch in batches:
            kept, out = [], []
            for k, r in enumerate(batch.column("r").to_pylist()):
                at, w = [], []
                for d in r:
                    near = np.flatnonzero(np.abs(d["age"] - delta - mu) <= 8 * (d["error"] + sigma + delta_error))
                    s = np.sqrt(d["error"] * d["error"] + sigma[near] * sigma[near] + delta_error * delta_error)
                    z = (d["age"] - delta - mu[near]) / s
                    at.append(near)
                    w.append(np.exp(-z * z / 2) / s)
                at, w = np.concatenate(at), np.concatenate(w)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                year, p = cal[at[order]], w[order] / w.sum()
                dense = np.argsort(-p, kind="stable")
                inside = year[dense[np.cumsum(p[dense]) - p[dense] < level]]
                ends = (inside.min(), inside.max()) if len(inside) else (None, None)
                out.append((year[np.round(np.abs(np.cumsum(p) - 0.5), 12).argmin()], year[np.round(p, 14).argmax()], len(inside), *ends))
                kept.append(k)
            median, mode, n, low, high = zip(*out) if out else [()] * 5
            yield pa.record_batch([batch.column("id").take(pa.array(kept, pa.int64())), pa.array(median, kind), pa.array(mode, kind), pa.array(n, pa.int64()), pa.array(low, kind), pa.array(high, kind)], names=["id", "median", "mode", "years", "low", "high"])

    return told.mapInArrow(run, f"id {held}, median {kinds['cal']}, mode {kinds['cal']}, years long, low {kinds['cal']}, high {kinds['cal']}")


def change_points(x: DataFrame, block: int, prior: float = 0.01, threshold: float = 0.95) -> DataFrame:
    """Where means of the `block` values before and from a row differ: Bayes factor exp(d^2 / 4v) / sqrt(2), v the mean of both variances over `block`, and its posterior; rows above the threshold."""
    before, here = _by_t().rowsBetween(-block, -1), _by_t().rowsBetween(0, block - 1)
    s = x.select("series", "t", *(f("v").over(w).alias(n) for n, f, w in (("n0", F.count, before), ("n1", F.count, here), ("m0", F.avg, before), ("m1", F.avg, here), ("s0", F.var_samp, before), ("s1", F.var_samp, here))))
    s = s.where((F.col("n0") == block) & (F.col("n1") == block)).withColumn("var", (F.col("s0") + F.col("s1")) / 2 / block)
    factor = F.exp(F.least(F.lit(700.0), F.pow(F.col("m1") - F.col("m0"), 2) / (4 * F.col("var")))) / math.sqrt(2)
    s = s.withColumn("posterior", prior * factor / (1 - prior + prior * factor)).where(F.col("posterior") >= threshold)
    return s.select("series", "t", F.round(F.col("m1") - F.col("m0"), 6).alias("step"), F.round("posterior", 6).alias("posterior"))


def recurrence(x: DataFrame, radius: float, theiler: int = 1, least: int = 2) -> DataFrame:
    """Recurrence rate and determinism of each series: pairs of rows at least `theiler` apart whose values differ by at most `radius`, and the share of them on diagonals of `least` or more.

    Values meet only in the cells of a grid as wide as the radius, so pairs far apart in value are never made.
    """
    s = x.select("series", F.row_number().over(_by_t()).alias("i"), "v")
    n = s.groupBy("series").agg(F.count("*").cast("double").alias("n"))
    a = s.select("series", "i", "v", F.floor(F.col("v") / radius).alias("cell"))
    b = s.select("series", F.col("i").alias("j"), F.col("v").alias("u"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.floor(F.col("v") / radius) + o)).alias("cell"))
    p = a.join(b, ["series", "cell"]).where((F.col("j") - F.col("i") >= theiler) & (F.abs(F.col("u") - F.col("v")) <= radius)).select("series", (F.col("j") - F.col("i")).alias("lag"), "i")
    runs = p.withColumn("run", F.col("i") - F.row_number().over(W.partitionBy("series", "lag").orderBy("i"))).groupBy("series", "lag", "run").agg(F.count("*").alias("length"))
    g = runs.groupBy("series").agg(F.sum("length").alias("points"), F.sum(F.when(F.col("length") >= least, F.col("length")).otherwise(0)).alias("lined"), F.max("length").alias("longest"), F.avg(F.when(F.col("length") >= least, F.col("length"))).alias("mean"))
    pairs = (F.col("n") - theiler) * (F.col("n") - theiler + 1) / 2
    return g.join(n, "series").select("series", "points", F.round(F.col("points") / pairs, 6).alias("rate"), F.round(F.col("lined") / F.col("points"), 6).alias("determinism"), "longest", F.round("mean", 6).alias("mean_line"))


def segment_spectrum(x: DataFrame, frequencies: list[float], segments: int) -> DataFrame:
    """Mean Lomb-Scargle power of equal spans of time at given frequencies, a bounded list, with 2 x segments degrees of freedom."""
    lo, hi = F.min("t").over(_all()), F.max("t").over(_all())
    part = F.least(F.lit(segments - 1), F.floor((F.col("t") - lo) / ((hi - lo) / segments)))
    s = x.select(F.struct(F.col("series").alias("name"), part.alias("part")).alias("series"), "t", "v")
    p = lomb_scargle(s, frequencies)
    return p.groupBy(F.col("series.name").alias("series"), "f").agg(F.round(F.avg("power"), 7).alias("power"), F.count("*").alias("segments"), (2 * F.count("*")).alias("dof"))


def false_discovery(spectrum: DataFrame, background: Column, dof: int = 2, alpha: float = 0.05) -> DataFrame:
    """Chi-square p of power over background and Benjamini-Hochberg's step-up by series: all ranks up to the last p <= alpha rank / m."""
    s = spectrum.withColumn("x", dof * F.col("power") / background).withColumn("p", special.chi2_sf("x", F.lit(float(dof))))
    w = W.partitionBy("series")
    r = s.withColumn("rank", F.row_number().over(w.orderBy("p", "f"))).withColumn("m", F.count("*").over(w))
    last = F.max(F.when(F.col("p") <= alpha * F.col("rank") / F.col("m"), F.col("rank"))).over(w)
    return r.select("series", "f", F.round("p", 6).alias("p"), "rank", F.coalesce(F.col("rank") <= last, F.lit(False)).alias("significant"))


def match_periods(observed: DataFrame, periods: DataFrame, tolerance: float) -> DataFrame:
    """The orbital band (name, period_kyr) nearest to each observed period (id, period) within a relative tolerance, ties by name; null where none is."""
    d = F.abs(F.col("period") - F.col("period_kyr")) / F.col("period_kyr")
    near = observed.join(F.broadcast(periods.select("name", "period_kyr")), d <= tolerance).groupBy("id").agg(F.min_by(F.struct("name", "period_kyr"), F.struct(F.round(d, 12), F.col("name"))).alias("b"))
    return observed.join(near, "id", "left").select("id", "period", F.col("b.name").alias("name"), F.col("b.period_kyr").alias("period_kyr"))


def target_spectrum(frequencies: DataFrame, periods: DataFrame, width: float = 0.002) -> DataFrame:
    """Sum of Gaussian peaks (width in cycles per kyr) at the periods' frequencies, for each asked frequency (f)."""
    g = frequencies.join(F.broadcast(periods.select("period_kyr"))).groupBy("f").agg(F.sum(F.exp(-F.pow((F.col("f") - 1 / F.col("period_kyr")) / width, 2) / 2)).alias("power"))
    return g.select("f", F.round("power", 8).alias("power"))


def circular_strength(events: DataFrame, periods: DataFrame) -> DataFrame:
    """Vector strength of event times (t) folded at each period (period), a bounded table."""
    a = 2 * math.pi * F.col("t") / F.col("period")
    g = events.select("t").join(F.broadcast(periods.select("period"))).groupBy("period").agg(F.count("*").alias("n"), F.avg(F.cos(a)).alias("c"), F.avg(F.sin(a)).alias("s"))
    return g.select("period", "n", F.round(F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")), 6).alias("strength"))


def block_bootstrap(x: DataFrame, block: int, n: int = 200, level: float = 0.95, seed: int = 1) -> DataFrame:
    """Interval of each series' mean from `n` moving-block resamples: blocks start at rows picked by md5(seed:replicate:place), so draws are the same on any cluster."""
    s = x.select("series", (F.row_number().over(_by_t()) - 1).alias("i"), "v")
    size = s.groupBy("series").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    places = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block) - 1))
    draws = size.where(F.col("n") >= block).crossJoin(F.broadcast(replicates(n, x.sparkSession))).select("series", "n", "rep", places.alias("place"))
    pick = F.conv(F.substring(order_key(seed, "rep", "place"), 1, 12), 16, 10).cast("long") % (F.col("n") - block + 1)
    draws = draws.select("series", "n", "rep", "place", pick.alias("start"))
    rows = draws.select("series", "n", "rep", "place", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k")).where(F.col("place") * block + F.col("k") < F.col("n")).select("series", "rep", (F.col("start") + F.col("k")).alias("i"))
    means = rows.join(s, ["series", "i"]).groupBy("series", "rep").agg(F.avg("v").alias("m"))
    a = (1 - level) / 2
    q = means.groupBy("series").agg(F.expr(f"percentile(m, array({a}D, {1 - a}D))").alias("q"), F.stddev_samp("m").alias("se"))
    return size.join(q, "series").select("series", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round(F.col("q")[0], 6).alias("low"), F.round(F.col("q")[1], 6).alias("high"))


def density_grid(x: DataFrame, columns: int, rows: int) -> DataFrame:
    """Counts of (t, v) in an even grid over their ranges; the last cells are closed, empty ones left out."""
    box = x.agg(*(f(c).alias(f"{n}_{c}") for c in ("t", "v") for n, f in (("lo", F.min), ("hi", F.max))))
    cell = lambda c, n: F.least(F.lit(n - 1), F.floor((F.col(c) - F.col(f"lo_{c}")) / ((F.col(f"hi_{c}") - F.col(f"lo_{c}")) / n))).cast("int")
    return x.join(F.broadcast(box)).groupBy(cell("t", columns).alias("i"), cell("v", rows).alias("j")).agg(F.count("*").alias("n"))


def hotelling_t2(df: DataFrame, group: Column, x: str, y: str) -> DataFrame:
    """Hotelling's T squared of two variables between two groups, given as a boolean, with F and p."""
    p = df.select(group.alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    g = p.groupBy("g").agg(F.count("*").cast("double").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("a"), F.var_samp("y").alias("b"), F.covar_samp("x", "y").alias("c"))
    t = g.agg(*(F.max(F.when(F.col("g") == flag, F.col(c))).alias(f"{c}{k}") for c in ("n", "mx", "my", "a", "b", "c") for k, flag in ((1, True), (2, False))))
    n = F.col("n1") + F.col("n2")
    pooled = lambda c: ((F.col("n1") - 1) * F.col(f"{c}1") + (F.col("n2") - 1) * F.col(f"{c}2")) / (n - 2)
    dx, dy, a, b, c = F.col("mx1") - F.col("mx2"), F.col("my1") - F.col("my2"), pooled("a"), pooled("b"), pooled("c")
    t = t.withColumn("t2", F.col("n1") * F.col("n2") / n * (dx * dx * b - 2 * dx * dy * c + dy * dy * a) / (a * b - c * c)).withColumn("df2", n - 3).withColumn("f", F.col("t2") * (n - 3) / (2 * (n - 2))).withColumn("df1", F.lit(2))
    return t.select(F.round("t2", 5).alias("t2"), F.round("f", 5).alias("f"), F.col("df2").cast("long").alias("df2"), F.round(special.f_sf("f", "df1", "df2"), 6).alias("p"))


def age_model(depths: DataFrame, anchors: DataFrame) -> DataFrame:
    """Ages of depths (depth) by the segments of anchors (depth, age), a few rows, with each segment's rate of depth over age; beyond them the end segments run on."""
    w = W.orderBy("depth")
    a = anchors.select(F.col("depth").alias("d0"), F.col("age").alias("a0"), F.lead("depth").over(w).alias("d1"), F.lead("age").over(w).alias("a1"), F.lag("depth").over(w).isNull().alias("first"), F.lead("depth", 2).over(w).isNull().alias("last")).where("d1 is not null")
    seg = depths.join(F.broadcast(a), (F.col("first") | (F.col("depth") >= F.col("d0"))) & (F.col("last") | (F.col("depth") < F.col("d1"))))
    rate = (F.col("d1") - F.col("d0")) / F.nullif(F.col("a1") - F.col("a0"), F.lit(0.0))
    return seg.select("depth", F.round(F.col("a0") + (F.col("depth") - F.col("d0")) / rate, 6).alias("age"), F.round(rate, 6).alias("rate"))


def day_length_scale(x: DataFrame, model: Column) -> DataFrame:
    """Least-squares scale of a model curve to the values of each series, sum m y / sum m^2, with its standard error."""
    s = x.withColumn("m", model).groupBy("series").agg(F.count("*").alias("n"), F.sum(F.col("m") * F.col("v")).alias("my"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("v") * F.col("v")).alias("yy"))
    scale = F.col("my") / F.col("mm")
    return s.select("series", "n", F.round(scale, 8).alias("scale"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("yy") - scale * F.col("my")) / (F.col("n") - 1) / F.col("mm")), 8).alias("se"))
