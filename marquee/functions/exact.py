"""Decimal arithmetic that rounds once, half away from zero."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000
WIDE = "decimal(38,0)"


def micros_between(start: Column, end: Column) -> Column:
    """Whole microseconds from ``start`` to ``end`` (timestamps without zone)."""
    return F.timestamp_diff("MICROSECOND", start, end)


def cents(amount: Column) -> Column:
    """A two-digit decimal amount as a whole number of hundredths."""
    return (amount * 100).cast(WIDE)


def round_ratio(numerator: Column, denominator: Column, scale: int) -> Column:
    """``numerator / denominator`` of whole numbers, rounded to ``scale`` digits.

    Null when the denominator is zero. Nothing is rounded before the last step.
    """
    top = numerator.cast(WIDE)
    bottom = F.nullif(denominator.cast(WIDE), F.lit(0).cast(WIDE))
    doubled = (F.abs(bottom) * 2).cast(WIDE)
    units = F.call_function(
        "div", (F.abs(top) * (2 * 10**scale)).cast(WIDE) + F.abs(bottom), doubled
    )
    sign = (F.signum(top) * F.signum(bottom)).cast("int")
    return (units * sign).cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-scale))
