"""Exact ratios of counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10_000


def ratio4(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator`` to four places, ties to even; null for a null or 0 denominator.

    Integer arithmetic on bigints, so no intermediate quotient is rounded first.
    """
    bottom = F.when(denominator != 0, denominator.cast("bigint"))
    scaled = numerator.cast("bigint") * F.lit(SCALE)
    quotient = F.call_function("div", scaled, bottom)
    twice = (scaled % bottom) * 2
    up = (twice > bottom) | ((twice == bottom) & (quotient % 2 == 1))
    rounded = quotient + F.when(up, 1).otherwise(0)
    return (rounded.cast("decimal(18,0)") / F.lit(SCALE)).cast("decimal(18,4)")
