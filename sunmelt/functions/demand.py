"""Household hot-water demand by hour, and the bins built on it and on the heating index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Litres drawn in each hour of the day; any other hour draws the default.
DEMAND_LITRES = {
    5: 5.0, 6: 25.0, 7: 30.0, 8: 20.0, 9: 10.0, 10: 5.0, 11: 5.0, 12: 5.0, 13: 5.0, 14: 5.0,
    15: 5.0, 16: 5.0, 17: 10.0, 18: 20.0, 19: 25.0, 20: 15.0, 21: 10.0, 22: 5.0, 23: 3.0,
}
DEFAULT_LITRES = 2.0
HIGH_DEMAND = 20.0
MEDIUM_DEMAND = 10.0
MORNING_PEAK = (6, 8)
EVENING_PEAK = (18, 20)
DEMAND_CODES = {"low": 0, "medium": 1, "high": 2}
INDEX_LOW = 4.0
INDEX_HIGH = 5.7


def demand_litres(hour: Column) -> Column:
    profile = F.create_map(*[F.lit(x) for pair in DEMAND_LITRES.items() for x in pair])
    return F.coalesce(F.try_element_at(profile, hour), F.lit(DEFAULT_LITRES))


def demand_level(litres: Column) -> Column:
    return (
        F.when(litres >= F.lit(HIGH_DEMAND), "high")
        .when(litres >= F.lit(MEDIUM_DEMAND), "medium")
        .otherwise("low")
    )


def demand_code(level: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for pair in DEMAND_CODES.items() for x in pair])
    return F.try_element_at(codes, level)


def peak_flag(hour: Column, hours: tuple[int, int]) -> Column:
    return F.coalesce(hour.between(*hours).cast("int"), F.lit(0))


def index_bin(index: Column) -> Column:
    """low / medium / high; a missing index falls into ``high``."""
    return (
        F.when(index < F.lit(INDEX_LOW), "low")
        .when(index < F.lit(INDEX_HIGH), "medium")
        .otherwise("high")
    )
