"""Date parts and Indian climate seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season of each calendar month, and the integer code of each season.
SEASON_MONTHS = {
    "winter": (12, 1, 2),
    "pre-monsoon": (3, 4, 5),
    "monsoon": (6, 7, 8, 9),
    "post-monsoon": (10, 11),
}
SEASON_CODES = {"winter": 0, "pre-monsoon": 1, "monsoon": 2, "post-monsoon": 3}


def local_time(ts: Column, offset_minutes: int | Column = 0) -> Column:
    """Shift a zone-less UTC clock by an offset; 0 keeps the clock as read."""
    if isinstance(offset_minutes, int) and offset_minutes == 0:
        return ts
    minutes = offset_minutes if isinstance(offset_minutes, Column) else F.lit(offset_minutes)
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), minutes)


def month_key(ts: Column) -> Column:
    """First day of the calendar month, as a date."""
    return F.trunc(F.to_date(ts), "month")


def day_key(ts: Column) -> Column:
    return F.to_date(ts)


def season_of(month: Column) -> Column:
    out = F.when(month.isin(*SEASON_MONTHS["winter"]), "winter")
    for name in ("pre-monsoon", "monsoon"):
        out = out.when(month.isin(*SEASON_MONTHS[name]), name)
    return out.otherwise("post-monsoon")


def season_code(season: Column) -> Column:
    pairs = [F.lit(x) for pair in SEASON_CODES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), season)


def season_name(code: Column) -> Column:
    pairs = [F.lit(x) for name, number in SEASON_CODES.items() for x in (number, name)]
    return F.try_element_at(F.create_map(*pairs), code)
