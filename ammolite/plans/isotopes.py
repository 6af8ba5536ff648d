"""Isotope queries: hourly event means scaled to carbonate values between -4 and 4 per mil."""

from __future__ import annotations

from pyspark.sql import functions as F

from ammolite.functions import isotopes as i
from ammolite.plans.series import _H, hourly


def _temperatures(spark, sf_dir):
    c, w = F.col("v") / 490.0 * 8.0 - 4.0, F.lit(-0.5)
    x = hourly(spark, sf_dir).select("series", "t", c.alias("c"))
    c = F.col("c")
    return x.select(
        "series", "t", F.round(i.vpdb_to_vsmow(c), 6).alias("vsmow"), F.round(i.temperature_quadratic(c, w), 6).alias("t_quadratic"), F.round(i.temperature_genus(c, w, "ruber"), 6).alias("t_ruber"),
        F.round(i.temperature_fractionation(c, w), 6).alias("t_fractionation"), i.calibrated(i.temperature_quadratic(c, w)).alias("calibrated"),
    )


QUERIES = {"isotope_paleotemperature": _temperatures}
ORACLE_SQL = {
    "isotope_paleotemperature": _H + """, c AS (SELECT series, t, v / 490.0 * 8.0 - 4.0 AS c FROM h), d AS (SELECT *, c - (-0.5 - 0.27) AS d FROM c)
SELECT series, t, round(1.03091 * c + 30.91, 6) AS vsmow, round(17.0 - 4.52 * d + 0.03 * d * d, 6) AS t_quadratic, round(16.998 - 4.52 * (d - 0.27), 6) AS t_ruber,
 round(18030.0 / (1000.0 * ln((1 + (1.03091 * c + 30.91) / 1000) / (1 - 0.5 / 1000)) + 32.42) - 273.15, 6) AS t_fractionation, (17.0 - 4.52 * d + 0.03 * d * d) BETWEEN 0 AND 35 AS calibrated FROM d""",
}
