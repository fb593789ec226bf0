"""Rounding and fixed-point helpers.

Temperatures are summed as integers (millionths of a degree). An integer sum does not depend on the
order in which partitions are merged, so replays, restarts and different cluster sizes give the same
averages bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIXED_UNITS = 1_000_000


def whole(value: Column) -> Column:
    """DOUBLE to the nearest whole DOUBLE, halves away from zero: F.round without its decimal per value."""
    near = F.rint(value)
    return F.when(F.abs(value - near) == 0.5, value + F.signum(value) * 0.5).otherwise(near)


def fixed_point(value: Column) -> Column:
    """DOUBLE degrees to BIGINT millionths of a degree, null if they do not fit."""
    return whole(value * F.lit(float(FIXED_UNITS))).try_cast("bigint")


def _int_div(numerator: Column, denominator: Column) -> Column:
    return F.call_function("div", numerator, denominator)


def divide_rounded(numerator: Column, denominator: Column) -> Column:
    """Integer quotient rounded to nearest, ties away from zero, as BIGINT. The denominator must be positive.

    Both may be BIGINT or whole DECIMAL; a decimal numerator keeps the doubled value from overflowing.
    """
    quotient = _int_div(F.abs(numerator) * 2 + denominator, denominator * 2)
    return F.when(numerator < 0, -quotient).otherwise(quotient)


def mean_from_fixed(total: Column, count: Column, digits: int = 2) -> Column:
    """Mean of fixed-point values, rounded to `digits` decimals on integers only."""
    return divide_rounded(total, count * F.lit(FIXED_UNITS // 10**digits)) / F.lit(10.0**digits)


def round_half_away(value: Column, digits: int = 2) -> Column:
    """DOUBLE rounded to `digits` decimals by the same tie rule as mean_from_fixed."""
    return mean_from_fixed(fixed_point(value), F.lit(1).cast("bigint"), digits)


def ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """Quotient of two integers rounded to `digits` decimals on integers only."""
    return divide_rounded(numerator * F.lit(10**digits), denominator) / F.lit(10.0**digits)


def js_round(value: Column) -> Column:
    """Nearest integer, halves toward positive infinity."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
