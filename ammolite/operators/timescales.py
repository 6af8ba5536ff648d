"""Orbital periods, geological periods, ages of depths, and rates between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ammolite.operators.series import _by_t

# Mean orbital periods in kyr, rounded amplitudes, bands and roles.
MILANKOVITCH = [("eccentricity_100", 100.0), ("obliquity_41", 41.0), ("precession_21", 21.0), ("precession_19", 19.0), ("precession_23", 23.0)]
FORCING = [
    ("long_period_precession", 400.0, 0.35, "precession", "modulation"), ("precession_100", 100.0, 0.30, "precession", "forcing"), ("precession_70", 70.0, 0.18, "precession", "forcing"),
    ("obliquity_41", 41.0, 0.35, "obliquity", "forcing"), ("precession_23", 23.0, 0.30, "precession", "forcing"), ("precession_19", 19.0, 0.18, "precession", "forcing"),
]
ORBIT_GROUPS = ("long eccentricity", "short eccentricity", "obliquity", "precession")
# The geological periods of the Phanerozoic, name, abbreviation, start and end in Ma.
PERIODS = [
    ("Quaternary", "Q", 2.58, 0.0), ("Neogene", "Ng", 23.03, 2.58), ("Paleogene", "Pg", 66.0, 23.03), ("Cretaceous", "K", 145.0, 66.0), ("Jurassic", "J", 201.4, 145.0), ("Triassic", "Tr", 251.902, 201.4),
    ("Permian", "P", 298.9, 251.902), ("Carboniferous", "C", 358.9, 298.9), ("Devonian", "D", 419.2, 358.9), ("Silurian", "S", 443.8, 419.2), ("Ordovician", "O", 485.4, 443.8), ("Cambrian", "Cm", 538.8, 485.4),
]


def milankovitch_periods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MILANKOVITCH, "name string, period_kyr double")


def orbital_forcing(spark: SparkSession, period_kyr: float | None = None) -> DataFrame:
    """The table of orbital bands, or those within 1 % of a period."""
    t = spark.createDataFrame(FORCING, "name string, period_kyr double, amplitude double, band string, role string").withColumn("frequency_per_ma", F.round(1000.0 / F.col("period_kyr"), 6))
    return t if period_kyr is None else t.where(F.abs(F.col("period_kyr") - period_kyr) / F.col("period_kyr") <= 0.01)


def get_scale(spark: SparkSession, lo: float = 0.0, hi: float = 538.8, touching: bool = False) -> DataFrame:
    """Geological periods contained in a window of ages, oldest first by number; `touching` keeps those that only touch it."""
    t = spark.createDataFrame(PERIODS, "interval_name string, abbr string, max_ma double, min_ma double")
    t = t.where((F.col("max_ma") >= lo) & (F.col("min_ma") <= hi)) if touching else t.where((F.col("max_ma") <= hi) & (F.col("min_ma") >= lo))
    return t.select(F.row_number().over(W.orderBy(F.desc("max_ma"))).alias("bin"), "interval_name", "abbr", "max_ma", "min_ma", F.round((F.col("max_ma") + F.col("min_ma")) / 2, 4).alias("mid_ma"), F.round(F.col("max_ma") - F.col("min_ma"), 4).alias("duration"))


def time_bins(scale: DataFrame, n_bins: int) -> DataFrame:
    """Neighbouring intervals of a scale (a few rows) merged to `n_bins` bins whose durations differ least from the mean, in squares.

    Every way to cut m intervals into k runs is a set of k - 1 cuts; cheapest runs are found by joining runs end to end, k times:
    at each step only the cheapest way to reach an interval stays, the one with the earlier cut where two are equal.
    """
    m = scale.select("bin", "max_ma", "min_ma", "interval_name")
    n = m.agg(F.count("*").alias("m"), (F.max("max_ma") - F.min("min_ma")).alias("span"))
    a, b = m.select(F.col("bin").alias("i"), F.col("max_ma").alias("top")), m.select(F.col("bin").alias("j"), F.col("min_ma").alias("base"))
    runs = F.broadcast(a.join(b, F.col("i") <= F.col("j")).join(n).select("i", "j", F.pow(F.col("top") - F.col("base") - F.col("span") / n_bins, 2).alias("cost")))
    ways = runs.where("i = 1").select("j", "cost", F.array("j").alias("ends"))
    for _ in range(n_bins - 1):
        longer = ways.select(F.col("j").alias("_to"), F.col("cost").alias("_sum"), "ends").join(runs, F.col("i") == F.col("_to") + 1).select("j", (F.col("_sum") + F.col("cost")).alias("cost"), F.concat("ends", F.array("j")).alias("ends"))
        ways = longer.groupBy("j").agg(F.min_by(F.struct("cost", "ends"), F.struct(F.round("cost", 9), "ends")).alias("w")).select("j", "w.*")
    best = ways.join(n, F.col("j") == F.col("m")).select(F.posexplode("ends").alias("k", "last"), "ends").select((F.col("k") + 1).alias("group"), "last", F.when(F.col("k") > 0, F.element_at("ends", F.col("k"))).otherwise(0).alias("before"))
    g = m.join(F.broadcast(best), (F.col("bin") > F.col("before")) & (F.col("bin") <= F.col("last"))).groupBy(F.col("group").alias("bin"))
    return g.agg(F.max("max_ma").alias("max_ma"), F.min("min_ma").alias("min_ma"), F.round(F.max("max_ma") - F.min("min_ma"), 4).alias("duration"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("max_ma"), F.col("interval_name")))), lambda x: x["interval_name"]), ", ").alias("intervals"))


def orbit_groups(periods: DataFrame) -> DataFrame:
    """Family and target weight of orbital periods (period_kyr): nine distinct ones by descending rank (1, 2 to 5, 6, 7 to 9), others by the thresholds of 80 and 30 kyr."""
    n = periods.agg(F.count("*").alias("n"), F.count_distinct("period_kyr").alias("distinct"))
    r = periods.select("period_kyr", F.rank().over(W.orderBy(F.desc("period_kyr"))).alias("r")).join(F.broadcast(n))
    by_rank = F.when(F.col("r") == 1, 1).when(F.col("r") <= 5, 2).when(F.col("r") == 6, 3).otherwise(4)
    by_size = F.when(F.col("period_kyr") >= 80, 1).when(F.col("period_kyr") >= 30, 3).otherwise(4)
    g = r.select("period_kyr", F.when((F.col("n") == 9) & (F.col("distinct") == 9), by_rank).otherwise(by_size).alias("k"))
    return g.select("period_kyr", F.element_at(F.array(*map(F.lit, ORBIT_GROUPS)), F.col("k")).alias("family"), F.when(F.col("k") <= 2, 1.0).when(F.col("k") == 3, 0.8).otherwise(0.6).alias("weight"))


def num_orbits(periods: DataFrame, span: float, rates: DataFrame, spacing: float | None = None) -> DataFrame:
    """How many of the periods (period_kyr) a record of `span` shows at each rate (rate): as long as the record at most, and above the Nyquist period where the spacing is given."""
    usable = F.col("period_kyr") / 1000.0 <= span / F.col("rate")
    if spacing is not None:
        usable = usable & (1000.0 / F.col("period_kyr") < F.col("rate") / (2.0 * spacing))
    return rates.join(F.broadcast(periods.select("period_kyr"))).groupBy("rate").agg(F.count_if(usable).alias("orbits"), F.round(F.max(F.when(usable, F.col("period_kyr"))), 4).alias("longest"))


def taper_count(lengths: DataFrame, bandwidth: float = 4.0) -> DataFrame:
    """Tapers for series of n values: the largest odd number up to 2 floor(NW) - 1 and n // 2, at least 1, and the bandwidth it stands for."""
    k = F.least(F.lit(2 * int(bandwidth) - 1), F.floor(F.col("n") / 2)).cast("long")
    k = F.greatest(F.lit(1), k - F.when(k % 2 == 0, 1).otherwise(0)).cast("long")
    return lengths.where("n >= 4").select("series", "n", k.alias("tapers"), ((k + 1) / 2).alias("bandwidth"))


def axis_summary(x: DataFrame) -> DataFrame:
    """Count, span, mean step, whether steps are even to 1 % of the mean, and the ends of the frequency axis (1 / span and Nyquist) of each series' t."""
    s = x.select("series", "t", (F.col("t") - F.lag("t").over(_by_t())).alias("d"))
    g = s.groupBy("series").agg(F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span"), F.max("d").alias("most"), F.min("d").alias("least"))
    dt = F.col("span") / (F.col("n") - 1)
    return g.select("series", "n", "span", F.round(dt, 6).alias("dt"), ((F.col("n") >= 3) & (F.col("most") - dt <= 0.01 * dt) & (dt - F.col("least") <= 0.01 * dt)).alias("uniform"), F.round(1 / F.col("span"), 8).alias("f_low"), F.round(1 / (2 * dt), 6).alias("f_high"))


def frequency_axis(x: DataFrame, n: int, log: bool = False) -> DataFrame:
    """(series, k, frequency, period): an even grid between the ends of the frequency axis, even in logarithms with `log`."""
    g = x.groupBy("series").agg(F.count("*").alias("m"), (F.max("t") - F.min("t")).alias("span")).where("m >= 3 and span > 0")
    g = g.select("series", (1 / F.col("span")).alias("lo"), ((F.col("m") - 1) / (2 * F.col("span"))).alias("hi"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    share = F.col("k") / (n - 1)
    f = F.col("lo") * F.pow(F.col("hi") / F.col("lo"), share) if log else F.col("lo") + share * (F.col("hi") - F.col("lo"))
    return g.select("series", "k", F.round(f, 8).alias("frequency"), F.round(1 / f, 6).alias("period"))


def rate_age_model(x: DataFrame, datum: float = 0.0) -> DataFrame:
    """Ages of depths (series, t as depth, v as rate between a depth and the next): datum plus the sum of steps over rates. Rates must be positive: others give null from there on."""
    step = (F.col("t") - F.lag("t").over(_by_t())) / F.nullif(F.greatest(F.lag("v").over(_by_t()), F.lit(0.0)), F.lit(0.0))
    s = x.select("series", "t", step.alias("d"), F.lag("t").over(_by_t()).isNull().alias("first"))
    w = _by_t().rowsBetween(W.unboundedPreceding, 0)
    broken = F.max(F.when(F.col("d").isNull() & ~F.col("first"), 1)).over(w)
    return s.select("series", F.col("t").alias("depth"), F.round(F.when(broken.isNull(), datum + F.coalesce(F.sum("d").over(w), F.lit(0.0))), 6).alias("age"))


def sedimentation_rate(x: DataFrame) -> DataFrame:
    """Step in depth over step in age (series, t as depth, v as age) at each depth but the first, which repeats the second's."""
    r = (F.col("t") - F.lag("t").over(_by_t())) / F.nullif(F.col("v") - F.lag("v").over(_by_t()), F.lit(0.0))
    s = x.select("series", "t", "v", r.alias("r"))
    return s.select("series", F.col("t").alias("depth"), F.round(F.coalesce("r", F.lead("r").over(_by_t())), 6).alias("rate"))
