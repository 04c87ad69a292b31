"""Missing-value rules. A missing number is NULL everywhere; NaN is removed at ingest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Limit to ``[lo, hi]``, keeping NULL (``greatest``/``least`` alone would drop it)."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def no_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def ratio(num: Column, den: Column) -> Column:
    """``num / den``; NULL where the divisor is zero."""
    return F.try_divide(num, den)


def flag_gt(c: Column, threshold: float) -> Column:
    """1 if above the threshold, else 0; a missing value counts as not above."""
    return F.coalesce((no_nan(c) > F.lit(threshold)).cast("int"), F.lit(0))


def known_flag(c: Column) -> Column:
    return c.isNotNull().cast("int")
