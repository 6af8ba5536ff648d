"""Oxygen isotopes: scales and palaeotemperatures as column expressions. Values in per mil, temperatures in degrees Celsius."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slope and intercept between the scales, the older small offset, genus offsets.
SLOPE, INTERCEPT = 1.03091, 30.91
SMALL_OFFSET = 0.27
GENUS_OFFSETS = {"generic": 0.0, "ruber": 0.27, "sacculifer": 0.22}


def vpdb_to_vsmow(delta: Column) -> Column:
    return SLOPE * delta + INTERCEPT


def vsmow_to_vpdb(delta: Column, small: bool = False) -> Column:
    """The linear conversion of carbonates or, for sea water in the older equations, the small offset."""
    return delta - SMALL_OFFSET if small else (delta - INTERCEPT) / SLOPE


def temperature_quadratic(carbonate: Column, water: Column) -> Column:
    """17.0 - 4.52 d + 0.03 d^2 with d = carbonate (VPDB) - water (given as VSMOW)."""
    d = carbonate - vsmow_to_vpdb(water, small=True)
    return 17.0 - 4.52 * d + 0.03 * d * d


def temperature_genus(carbonate: Column, water: Column, genus: str = "generic") -> Column:
    """16.998 - 4.52 d, water shifted by the genus' offset; an unknown genus is an error."""
    return 16.998 - 4.52 * (carbonate - (vsmow_to_vpdb(water, small=True) + GENUS_OFFSETS[genus]))


def temperature_fractionation(carbonate: Column, water: Column) -> Column:
    """From 1000 ln(alpha) = 18030 / T - 32.42, both on VSMOW."""
    alpha = (1 + vpdb_to_vsmow(carbonate) / 1000) / (1 + water / 1000)
    return 18030.0 / (1000.0 * F.log(alpha) + 32.42) - 273.15


def calibrated(temperature: Column) -> Column:
    """Whether a temperature lies in the range that the equations were made for; values outside are kept and flagged."""
    return temperature.between(0.0, 35.0)
