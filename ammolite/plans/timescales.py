"""Time scales and age models: suppliers' balances stand for ages, hourly series for records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammolite.functions import axes
from ammolite.operators import stratigraphy as st
from ammolite.operators import timescales as t
from ammolite.plans.series import _H
from ammolite.plans.series import hourly as H
from ammolite.plans.stratigraphy import _O, _R, bins, occurrences

NINE = [405.0, 123.0, 95.0, 41.0, 39.0, 37.0, 23.0, 19.0, 17.0]


def _ages(s, d):
    return s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", (F.col("s_acctbal") / 10).alias("age"))


def _r(c, digits=6):
    return F.round(c, digits)


def _rates(s):
    return s.range(1, 51).select((F.col("id") / 10).alias("rate"))


def _periods(s, values):
    return s.createDataFrame([(p,) for p in values], "period_kyr double")


def _positive(s, d):
    return H(s, d).withColumn("v", F.abs("v") + 1)


QUERIES = {
    "time_axis_units": lambda s, d: _ages(s, d).select("s_suppkey", _r(axes.to_kyr(F.col("age")), 3).alias("kyr"), _r(axes.to_bp_years(F.col("age")), 0).alias("bp_years"), _r(axes.calendar_years(F.col("age")), 0).alias("calendar"), _r(axes.frequency_per_ma(F.col("age"))).alias("frequency"), _r(axes.period_kyr(axes.frequency_per_ma(F.col("age")))).alias("period")),
    "lod_closed_forms": lambda s, d: _ages(s, d).select("s_suppkey", _r(axes.day_length(F.col("age"))).alias("hours"), _r(axes.days_in_year(F.col("age"))).alias("days"), _r(axes.day_lengthening(F.col("age"))).alias("ms_per_century")),
    "astronomical_target_curve": lambda s, d: _ages(s, d).select("s_suppkey", _r(axes.target_curve(F.col("age"), 405.0, 2.0)).alias("curve")),
    "insolation_series": lambda s, d: _ages(s, d).select("s_suppkey", _r(axes.target_curve(F.col("age") / 1000, 41.0)).alias("curve")),
    "milankovitch_periods": lambda s, d: t.milankovitch_periods(s),
    "orbital_forcing": lambda s, d: t.orbital_forcing(s),
    "orbital_forcing_band": lambda s, d: t.orbital_forcing(s, 41.2),
    "get_scale": lambda s, d: t.get_scale(s),
    "get_scale_window": lambda s, d: t.get_scale(s, 66.0, 251.902, touching=True),
    "time_bins": lambda s, d: t.time_bins(t.get_scale(s), 5),
    "orbit_groups": lambda s, d: t.orbit_groups(_periods(s, NINE)),
    "fixed_target_weights": lambda s, d: t.orbit_groups(_periods(s, [405.0, 41.0, 30.0, 19.0])),
    "num_orbits": lambda s, d: t.num_orbits(_periods(s, NINE), 0.4, _rates(s), 0.01),
    "multitaper_taper_count": lambda s, d: t.taper_count(H(s, d).groupBy("series").agg(F.count("*").alias("n"))),
    "time_axis_summary": lambda s, d: t.axis_summary(H(s, d)),
    "frequency_axis": lambda s, d: t.frequency_axis(H(s, d), 64),
    "period_axis": lambda s, d: t.frequency_axis(H(s, d), 64, log=True),
    "sedimentation_rate_age_model": lambda s, d: t.rate_age_model(_positive(s, d), 5.0),
    "sedimentation_rate": lambda s, d: t.sedimentation_rate(_positive(s, d)),
    "tax_expand_time": lambda s, d: st.tax_expand_time(st.ranges(occurrences(s, d)), bins(s)),
    "interval_count_diversity": lambda s, d: st.interval_count(st.bin_time(occurrences(s, d), bins(s), "all"), bins(s)),
    "estimate_diversity": lambda s, d: st.diversity_dynamics(st.ranges(occurrences(s, d)), bins(s)),
    "fit_exponential_model": lambda s, d: st.exponential_growth(st.diversity_dynamics(st.ranges(occurrences(s, d)), bins(s))),
    "cohort_survivorship": lambda s, d: st.cohorts(st.ranges(occurrences(s, d)), bins(s)),
    "extinction_marshall": lambda s, d: st.extinction_intervals(st.ranges(occurrences(s, d)).select("taxon", F.col("min_ma").alias("lad")), 0.2),
    "extinction_strauss_sadler": lambda s, d: st.extinction_intervals(st.ranges(occurrences(s, d)).select("taxon", F.col("min_ma").alias("lad")), None),
    "filter_endemics": lambda s, d: st.filter_endemics(occurrences(s, d).withColumn("section", F.floor(F.col("min_ma") / 400)), 4),
}

_A = "WITH a AS (SELECT s_suppkey, s_acctbal / 10 AS age FROM supplier)"
_DAY = "CASE WHEN age >= 0 THEN 23.934468 + t * (7.432167 + t * (-0.727046 + t * (-0.409572 + t * -0.0589692))) ELSE 23.934468 + t * (7.444649 + t * (-0.715049 + t * 0.458097)) END"
_FORCING = "SELECT name, CAST(p AS DOUBLE) AS period_kyr, CAST(a AS DOUBLE) AS amplitude, band, role, round(1000 / p, 6) AS frequency_per_ma FROM (VALUES ('long_period_precession', 400.0, 0.35, 'precession', 'modulation'), ('precession_100', 100.0, 0.30, 'precession', 'forcing'), ('precession_70', 70.0, 0.18, 'precession', 'forcing'), ('obliquity_41', 41.0, 0.35, 'obliquity', 'forcing'), ('precession_23', 23.0, 0.30, 'precession', 'forcing'), ('precession_19', 19.0, 0.18, 'precession', 'forcing')) t(name, p, a, band, role)"
_SCALE = "WITH s AS (SELECT * FROM (VALUES ('Quaternary', 'Q', 2.58, 0.0), ('Neogene', 'Ng', 23.03, 2.58), ('Paleogene', 'Pg', 66.0, 23.03), ('Cretaceous', 'K', 145.0, 66.0), ('Jurassic', 'J', 201.4, 145.0), ('Triassic', 'Tr', 251.902, 201.4), ('Permian', 'P', 298.9, 251.902), ('Carboniferous', 'C', 358.9, 298.9), ('Devonian', 'D', 419.2, 358.9), ('Silurian', 'S', 443.8, 419.2), ('Ordovician', 'O', 485.4, 443.8), ('Cambrian', 'Cm', 538.8, 485.4)) v(n, a, hi, lo))"
_SCALED = " SELECT CAST(row_number() OVER (ORDER BY hi DESC) AS INTEGER) AS bin, n AS interval_name, a AS abbr, CAST(hi AS DOUBLE) AS max_ma, CAST(lo AS DOUBLE) AS min_ma, round(CAST(hi + lo AS DOUBLE) / 2, 4) AS mid_ma, round(CAST(hi - lo AS DOUBLE), 4) AS duration FROM s"
_NINE = "(SELECT unnest([405.0, 123.0, 95.0, 41.0, 39.0, 37.0, 23.0, 19.0, 17.0]) AS p)"
_P = _H + ", p AS (SELECT series, t, abs(v) + 1 AS v FROM h)"
_DYN = _R + """, i AS (SELECT bin, taxon FROM b JOIN r ON lo < bh AND hi > bl), n AS (SELECT bin, count(*) AS n FROM i GROUP BY 1), q AS (SELECT a.bin, count(*) AS k FROM i a JOIN i c ON c.bin = a.bin + 1 AND c.taxon = a.taxon GROUP BY 1),
y AS (SELECT b.bin, (bl + bh) / 2 AS t, coalesce(n.n, 0) AS n, coalesce(o.k, 0) AS o, coalesce(e.k, 0) AS e, b.bin < (SELECT max(bin) FROM b) AS older, b.bin > (SELECT min(bin) FROM b) AS younger FROM b LEFT JOIN n ON n.bin = b.bin LEFT JOIN q o ON o.bin = b.bin LEFT JOIN q e ON e.bin = b.bin - 1),
z AS (SELECT bin, t, n, CASE WHEN older AND n > 0 THEN CASE WHEN o > 0 THEN abs(ln(o / n)) / 365 ELSE CAST('inf' AS DOUBLE) END END AS p, CASE WHEN younger AND n > 0 THEN CASE WHEN e > 0 THEN abs(ln(e / n)) / 365 ELSE CAST('inf' AS DOUBLE) END END AS q FROM y)"""

ORACLE_SQL = {
    "time_axis_units": _A + " SELECT s_suppkey, round(age * 1000, 3) AS kyr, round(age * 1e6, 0) AS bp_years, round(2020 - age * 1e6, 0) AS calendar, round(1000 / nullif(age, 0), 6) AS frequency, round(age, 6) AS period FROM a",
    "lod_closed_forms": _A + ", b AS (SELECT *, -age / 1000 AS t FROM a), d AS (SELECT *, " + _DAY + """ AS h FROM b)
SELECT s_suppkey, round(h, 6) AS hours, round(3.15576e7 / (h * 3600), 6) AS days, round(0.36 * CASE WHEN age >= 0 THEN 7.432167 + t * (2 * -0.727046 + t * (3 * -0.409572 + t * 4 * -0.0589692)) ELSE 7.444649 + t * (2 * -0.715049 + t * 3 * 0.458097) END, 6) AS ms_per_century FROM d""",
    "astronomical_target_curve": _A + " SELECT s_suppkey, round(2 * cos(2 * pi() * age * 1000 / 405), 6) AS curve FROM a",
    "insolation_series": _A + " SELECT s_suppkey, round(cos(2 * pi() * age / 41), 6) AS curve FROM a",
    "milankovitch_periods": "SELECT name, CAST(p AS DOUBLE) AS period_kyr FROM (VALUES ('eccentricity_100', 100.0), ('obliquity_41', 41.0), ('precession_21', 21.0), ('precession_19', 19.0), ('precession_23', 23.0)) t(name, p)",
    "orbital_forcing": _FORCING,
    "orbital_forcing_band": _FORCING + " WHERE abs(p - 41.2) / p <= 0.01",
    "get_scale": _SCALE + _SCALED,
    "get_scale_window": _SCALE + _SCALED + " WHERE hi >= 66 AND lo <= 251.902",
    "time_bins": _SCALE + """, m AS (SELECT row_number() OVER (ORDER BY hi DESC) AS k, n, CAST(hi AS DOUBLE) AS hi, CAST(lo AS DOUBLE) AS lo FROM s),
c AS (SELECT a.k AS a, b.k AS b, c.k AS c, d.k AS d FROM m a JOIN m b ON b.k > a.k JOIN m c ON c.k > b.k JOIN m d ON d.k > c.k WHERE d.k < 12),
g AS (SELECT a, b, c, d, m.k, m.n, m.hi, m.lo, CASE WHEN m.k <= a THEN 1 WHEN m.k <= b THEN 2 WHEN m.k <= c THEN 3 WHEN m.k <= d THEN 4 ELSE 5 END AS bin FROM c, m),
x AS (SELECT a, b, c, d, bin, max(hi) AS hi, min(lo) AS lo, string_agg(n, ', ' ORDER BY hi DESC) AS names FROM g GROUP BY a, b, c, d, bin), w AS (SELECT a, b, c, d FROM x GROUP BY a, b, c, d ORDER BY round(sum((hi - lo - 538.8 / 5) ** 2), 9), a, b, c, d LIMIT 1)
SELECT CAST(bin AS INTEGER) AS bin, hi AS max_ma, lo AS min_ma, round(hi - lo, 4) AS duration, names AS intervals FROM x JOIN w USING (a, b, c, d)""",
    "orbit_groups": "SELECT CAST(p AS DOUBLE) AS period_kyr, CASE WHEN k = 1 THEN 'long eccentricity' WHEN k <= 5 THEN 'short eccentricity' WHEN k = 6 THEN 'obliquity' ELSE 'precession' END AS family, CAST(CASE WHEN k <= 5 THEN 1.0 WHEN k = 6 THEN 0.8 ELSE 0.6 END AS DOUBLE) AS weight FROM (SELECT p, row_number() OVER (ORDER BY p DESC) AS k FROM " + _NINE + ")",
    "fixed_target_weights": "SELECT CAST(p AS DOUBLE) AS period_kyr, CASE WHEN p >= 80 THEN 'long eccentricity' WHEN p >= 30 THEN 'obliquity' ELSE 'precession' END AS family, CAST(CASE WHEN p >= 80 THEN 1.0 WHEN p >= 30 THEN 0.8 ELSE 0.6 END AS DOUBLE) AS weight FROM (SELECT unnest([405.0, 41.0, 30.0, 19.0]) AS p)",
    "num_orbits": "SELECT k / 10 AS rate, count(*) FILTER (p / 1000 <= 0.4 / (k / 10) AND 1000 / p < (k / 10) / (2 * 0.01)) AS orbits, CAST(max(p) FILTER (p / 1000 <= 0.4 / (k / 10) AND 1000 / p < (k / 10) / (2 * 0.01)) AS DOUBLE) AS longest FROM range(1, 51) g(k), " + _NINE + " GROUP BY k",
    "multitaper_taper_count": _H + ", c AS (SELECT series, count(*) AS n FROM h GROUP BY 1), k AS (SELECT series, n, least(7, n // 2) AS k FROM c WHERE n >= 4), o AS (SELECT series, n, greatest(1, k - CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END) AS k FROM k) SELECT series, n, k AS tapers, (k + 1) / 2 AS bandwidth FROM o",
    "time_axis_summary": _H + """, d AS (SELECT series, t, t - lag(t) OVER (PARTITION BY series ORDER BY t) AS d FROM h), g AS (SELECT series, count(*) AS n, max(t) - min(t) AS span, max(d) AS hi, min(d) AS lo FROM d GROUP BY 1), e AS (SELECT *, span / (n - 1) AS dt FROM g)
SELECT series, n, span, round(dt, 6) AS dt, n >= 3 AND hi - dt <= 0.01 * dt AND dt - lo <= 0.01 * dt AS uniform, round(1 / span, 8) AS f_low, round(1 / (2 * dt), 6) AS f_high FROM e""",
    "frequency_axis": _H + """, g AS (SELECT series, 1 / (max(t) - min(t)) AS lo, (count(*) - 1) / (2 * (max(t) - min(t))) AS hi FROM h GROUP BY 1) SELECT series, CAST(k AS INTEGER) AS k, round(lo + k / 63 * (hi - lo), 8) AS frequency, round(1 / (lo + k / 63 * (hi - lo)), 6) AS period FROM g, range(64) r(k)""",
    "period_axis": _H + """, g AS (SELECT series, 1 / (max(t) - min(t)) AS lo, (count(*) - 1) / (2 * (max(t) - min(t))) AS hi FROM h GROUP BY 1) SELECT series, CAST(k AS INTEGER) AS k, round(lo * power(hi / lo, k / 63), 8) AS frequency, round(1 / (lo * power(hi / lo, k / 63)), 6) AS period FROM g, range(64) r(k)""",
    "sedimentation_rate_age_model": _P + ", d AS (SELECT series, t, (t - lag(t) OVER w) / lag(v) OVER w AS d FROM p WINDOW w AS (PARTITION BY series ORDER BY t)) SELECT series, t AS depth, round(5 + coalesce(sum(d) OVER (PARTITION BY series ORDER BY t), 0), 6) AS age FROM d",
    "sedimentation_rate": _P + ", d AS (SELECT series, t, (t - lag(t) OVER w) / nullif(v - lag(v) OVER w, 0) AS r FROM p WINDOW w AS (PARTITION BY series ORDER BY t)) SELECT series, t AS depth, round(coalesce(r, lead(r) OVER (PARTITION BY series ORDER BY t)), 6) AS rate FROM d",
    "tax_expand_time": _R + " SELECT taxon, lo AS min_ma, hi AS max_ma, bin, hi <= bh AS orig, lo >= bl AND lo > 0 AS ext FROM r JOIN b ON lo < bh AND hi > bl",
    "interval_count_diversity": _O + " SELECT b.bin, count(DISTINCT taxon) AS taxa FROM b LEFT JOIN o ON lo < bh AND hi > bl GROUP BY b.bin",
    "estimate_diversity": _DYN + " SELECT bin, t, n AS richness, round(p, 8) AS origination_rate, round(q, 8) AS extinction_rate FROM z",
    "fit_exponential_model": _DYN + " SELECT count(*) AS n, round(regr_slope(ln(n + 1e-10), t), 8) AS rate, round(exp(regr_intercept(ln(n + 1e-10), t)), 4) AS start FROM z",
    "cohort_survivorship": _R + """, c AS (SELECT bin, taxon, lo, hi, bl, bh FROM r JOIN b ON hi > bl AND hi <= bh), s AS (SELECT bin, count(*) AS n, count(*) FILTER (lo < bl) AS k FROM c GROUP BY 1), p AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM s)
SELECT bin, n AS total, k AS survivors, round(p, 6) AS survival, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n), 6) AS high,
 round(CASE WHEN p < 1 THEN abs(ln(1 - p)) / 365 ELSE CAST('inf' AS DOUBLE) END, 8) AS origination_rate, round(CASE WHEN p > 0 THEN abs(ln(p)) / 365 ELSE CAST('inf' AS DOUBLE) END, 8) AS extinction_rate FROM p""",
    "extinction_marshall": _R + " SELECT taxon, lo AS lad, round(greatest(0, lo - ln(0.05) / ln(1 - 0.2)), 6) AS low, lo AS high FROM r",
    "extinction_strauss_sadler": _R + ", d AS (SELECT DISTINCT lo FROM r), l AS (SELECT lo, lag(lo) OVER (ORDER BY lo) AS below FROM d) SELECT taxon, r.lo AS lad, round(greatest(0, r.lo - coalesce(r.lo - below, 0) * (power(0.05, -0.5) - 1) / 2), 6) AS low, r.lo AS high FROM r JOIN l ON l.lo = r.lo",
    "filter_endemics": _O + ", s AS (SELECT taxon, count(DISTINCT CAST(floor(lo / 400) AS BIGINT)) AS sections, count(*) AS n FROM o GROUP BY 1) SELECT taxon, sections, n FROM s WHERE sections >= 4 OR (NOT EXISTS (SELECT 1 FROM s WHERE sections >= 4) AND sections = (SELECT max(sections) FROM s))",
}
