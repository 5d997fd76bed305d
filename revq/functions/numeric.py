"""Exact sums, null-safe quotients and rounding.

Money and percentages are summed as decimals, so a total does not depend on
the order in which tasks finish. A quotient is taken in double and rounded
through a decimal, which rounds halves the way a person would (0.145 -> 0.15).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTIENT = "decimal(38,10)"


def dbl(x: Column) -> Column:
    return x.cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den in double; NULL where the denominator is 0 or NULL."""
    return dbl(num) / F.nullif(dbl(den), F.lit(0.0))


def rnd(x: Column, digits: int) -> Column:
    """Round half up; the result is an exact decimal with `digits` places."""
    return F.round(x.cast(QUOTIENT), digits).cast(f"decimal(24,{digits})")


def rnd_even(x: Column, digits: int) -> Column:
    """Round half to even, as the what-if results are rounded."""
    return F.bround(x.cast(QUOTIENT), digits).cast(f"decimal(24,{digits})")


def pct_change(now: Column, before: Column) -> Column:
    """100 * (now - before) / before; NULL without a non-zero predecessor."""
    return dbl(now - before) * 100.0 / F.nullif(dbl(before), F.lit(0.0))


def rel_change(now: Column, before: Column) -> Column:
    """(now - before) / before as a fraction."""
    return ratio(now - before, before)


def mean(x: Column, places: int = 10) -> Column:
    """AVG over the non-NULL values, through an exact decimal sum."""
    return ratio(F.sum(x.cast(f"decimal(28,{places})")), F.count(x))
