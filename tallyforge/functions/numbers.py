"""Rounding half to even of the value that a double holds, as published scores are."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Splits a double into two halves of 26 bits.
_SPLIT = float(2**27 + 1)
#: From here on a double has no fraction, or its product with a power of ten loses one.
_LARGE = float(2**51)


def half_even(x: Column, digits: int) -> Column:
    """x to so many decimals: the nearest, and of two equally near the even one.

    Spark's round and bround look at the shortest text of a double, so that
    2.675 counts as a tie though the double lies below it. Here the product with
    10 ** digits is taken exactly, as the double nearest to it and the rest, and
    compared with a half. Nulls, NaN, infinities and values too large to have
    such decimals stay as they are.
    """
    x, scale = x.cast("double"), 10.0**digits
    p = x * scale
    # the product's rest, by halves whose products are exact
    a = x * _SPLIT - (x * _SPLIT - x)
    s = scale * _SPLIT - (scale * _SPLIT - scale)
    b, t = x - a, scale - s
    rest = ((a * s - p) + a * t + b * s) + b * t
    # floor() gives a long; nothing here is as large
    low = F.floor(p).cast("double")
    over = p - low
    up = (over > 0.5) | ((over == 0.5) & ((rest > 0) | ((rest == 0) & (low % 2 != 0))))
    # a product that is whole as a double can lie just below it
    return F.when(F.abs(p) < _LARGE, F.when(up, low + 1).otherwise(low) / scale).otherwise(x)


def published(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """df with the columns named rounded half to even to so many decimals."""
    return df.withColumns({c: half_even(F.col(f"`{c}`"), n) for c, n in digits.items()})
