"""Rounding and ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The distance from 1 to the next double.
EPSILON = 2.220446049250313e-16


def half_up(value: Column, digits: int = 0, epsilon: bool = True) -> Column:
    """Rounds half towards positive infinity, after adding EPSILON; Spark's round() takes halves away from zero."""
    power = float(10**digits)
    shifted = value.cast("double") + EPSILON if epsilon else value.cast("double")
    return F.floor(shifted * power + 0.5) / power


def whole(value: Column) -> Column:
    """Rounds half up to a whole number."""
    return half_up(value).cast("long")


def share(part: Column, total: Column, digits: int = 3) -> Column:
    """part / total rounded; 0 where total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(half_up(part / F.nullif(total, F.lit(0)), digits))


def trend(recent: Column, previous: Column) -> Column:
    """Percentage change from previous to recent; 100 from nothing to something."""
    grown = F.when(recent > 0, F.lit(100)).otherwise(F.lit(0)).cast("long")
    return F.when(previous == 0, grown).otherwise(whole((recent - previous) / F.nullif(previous, F.lit(0)) * 100))


def mean0(value: Column) -> Column:
    """The mean as an aggregate; 0 of nothing."""
    return F.coalesce(F.avg(value), F.lit(0.0))
