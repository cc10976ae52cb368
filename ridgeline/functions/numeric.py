"""Small numeric helpers shared by all modules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def r6(x: Column) -> Column:
    """Round to six digits for a result edge.

    The tie is broken a hair above one half, so that values which sit exactly
    on a seventh-digit five land on the same side whatever the order of the
    additions that produced them.
    """
    return F.floor(x * 1e6 + 0.5001) / F.lit(1e6)


def ratio(num: Column, den: Column) -> Column:
    """num / den, null when the denominator is 0 or null."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def flag(cond: Column) -> Column:
    """Boolean that reads null as false."""
    return F.coalesce(cond, F.lit(False))


def as_text(x: Column) -> Column:
    return x.cast("string")
