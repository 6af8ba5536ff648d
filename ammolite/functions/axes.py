"""Time axes and orbital curves as column expressions. Ages are in Ma and grow into the past."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day length in hours today, and the coefficients of its change by powers of Gyr, in the past and in the future; seconds of a year.
DAY_HOURS = 23.934468
DAY_PAST = (7.432167, -0.727046, -0.409572, -0.0589692)
DAY_FUTURE = (7.444649, -0.715049, 0.458097)
YEAR_SECONDS = 3.15576e7
#: Milliseconds a century for a change of an hour a Gyr.
MS_PER_CENTURY = 0.36


def to_kyr(age: Column) -> Column:
    return age * 1000.0


def to_bp_years(age: Column) -> Column:
    return age * 1.0e6


def calendar_years(age: Column, present: int = 2020) -> Column:
    return present - age * 1.0e6


def frequency_per_ma(period_kyr: Column) -> Column:
    return 1000.0 / F.nullif(period_kyr, F.lit(0.0))


def period_kyr(frequency: Column) -> Column:
    return 1000.0 / F.nullif(frequency, F.lit(0.0))


def _polynomial(t: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = F.lit(c) + t * out
    return out


def day_length(age: Column) -> Column:
    """Hours of a day."""
    t = -age / 1000.0
    return DAY_HOURS + t * F.when(t <= 0, _polynomial(t, DAY_PAST)).otherwise(_polynomial(t, DAY_FUTURE))


def days_in_year(age: Column) -> Column:
    return YEAR_SECONDS / (day_length(age) * 3600.0)


def day_lengthening(age: Column) -> Column:
    """Milliseconds a century by which days grow longer."""
    t = -age / 1000.0
    slope = lambda c: _polynomial(t, tuple((k + 1) * x for k, x in enumerate(c)))
    return MS_PER_CENTURY * F.when(t <= 0, slope(DAY_PAST)).otherwise(slope(DAY_FUTURE))


def target_curve(age: Column, period: Column | float, amplitude: float = 1.0) -> Column:
    """Cosine of a period in kyr."""
    return amplitude * F.cos(2.0 * math.pi * age * 1000.0 / period)
