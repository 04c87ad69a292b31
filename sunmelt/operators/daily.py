"""Hourly rows to one row per site and day, then lags, rolling means and next-day targets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunmelt.operators.columns import present

# Statistics of the daily table, the columns of which a day keeps its first
# value, and the columns that get lags, rolling means and next-day targets.
DAILY_STATS: dict[str, tuple[str, ...]] = {
    "GHI": ("mean", "max", "sum"),
    "DNI": ("mean", "max"),
    "DHI": ("mean",),
    "T_amb": ("mean", "max", "min"),
    "RHum": ("mean",),
    "W_spd": ("mean", "max"),
    "cloud_cover": ("mean",),
    "CSI": ("mean",),
    "SZA": ("mean",),
    "ETR": ("mean", "max"),
    "P_atm": ("mean",),
    "precipitation": ("sum",),
    "demand_L_per_hr": ("sum",),
}
DAILY_FIRSTS = (
    "RRTDHS", "month", "DOY", "year", "season", "season_code", "sunrise_hour", "sunset_hour",
    "high_solar_resource", "lat", "lon", "altitude_m", "climate_zone", "T_set", "Tm_melting",
    "Tm_freezing", "latent_heat_melting", "heat_storage_Wh_kg", "TC_both", "density_solid",
    "Cp_avg", "rho_H_MJ_m3", "pcm_suitability_score", "pcm_type_code", "is_flammable",
    "pcm_label", "pcm_label_code", "best_pcm_product", "best_pcm_Tm", "optimal_Tm_target",
)
STAT_NAMES = {"demand_L_per_hr_sum": "demand_total_L", "GHI_sum": "GHI_daily_kWh_m2"}
WH_PER_KWH = 1000.0
LAGGED = ("GHI_mean", "T_amb_mean", "T_amb_max", "CSI_mean", "cloud_cover_mean")
LAGS = (1, 2, 7)
ROLLED = ("GHI_mean", "T_amb_mean")
ROLL_DAYS = 7
NEXT_DAY = {"GHI_mean": "GHI_next_day", "T_amb_mean": "T_amb_next_day"}


def daily_rollup(
    df: DataFrame,
    keys: Sequence[str] = ("city",),
    ts: str = "timestamp",
    stats: Mapping[str, Sequence[str]] = DAILY_STATS,
    firsts: Sequence[str] = DAILY_FIRSTS,
) -> DataFrame:
    """One row per key and day: statistics, and the first known value of other columns.

    Columns the input lacks are skipped and rows without a key are left out. A daily sum of
    nothing is 0, a mean of nothing is NULL. Of several values known at the same earliest
    time the smallest counts as first, so the result does not depend on how rows are spread
    (doubles and whole numbers are told apart exactly, decimals as doubles). Text cannot live
    in a hash-aggregation buffer, so text columns first serve as extra grouping keys (they
    hardly vary within a day) and only the resulting few rows per day are merged.
    """
    keys = list(keys)
    stats, values, text = rollup_columns(df, keys, stats, firsts)
    parts = partial_rollup(dated(df, keys, ts), [*keys, "date", *text], stats, values, ts)
    return merge_rollup(parts, [*keys, "date"], stats, values, text, combine=bool(text))


def rollup_columns(
    df: DataFrame, keys: Sequence[str], stats: Mapping[str, Sequence[str]] = DAILY_STATS, firsts: Sequence[str] = DAILY_FIRSTS
) -> tuple[dict[str, tuple[str, ...]], list[str], list[str]]:
    """What a rollup of ``df`` has: statistics, and first values of numbers and of text."""
    known = {c: tuple(stats[c]) for c in present(df, list(stats))}
    others = [c for c in present(df, firsts) if c not in keys and c not in known]
    text = [c for c in others if not isinstance(df.schema[c].dataType, T.NumericType)]
    return known, [c for c in others if c not in text], text


def dated(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Rows with a date and all keys."""
    rows = df.withColumn("date", F.to_date(ts))
    for key in [*keys, "date"]:
        rows = rows.where(F.col(key).isNotNull())
    return rows


def _order(ts: str, value: str, kind: T.DataType) -> Column:
    """Time of day and then value as one number, which a hash-aggregation buffer can hold.

    Microseconds take 37 bits and a value 68, together under 38 decimal digits.
    """
    seconds = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts)).cast("decimal(12,6)")
    time = (seconds * 1_000_000).cast("decimal(11,0)") * F.lit(Decimal(10**21))
    place = F.col(value).cast("decimal(22,0)") if isinstance(kind, T.IntegralType) else _ordered(F.col(value).cast("double"))
    return F.when(F.col(value).isNotNull(), (time + place + F.lit(Decimal(2 * 10**20))).cast("decimal(38,0)"))


def _ordered(x: Column) -> Column:
    """A whole number for each double, in the same order: exponent, then mantissa, with sign.

    The logarithm may round to the next power of two; a spare bit keeps the mantissa whole
    and the order right in that case too. NaN is above all.
    """
    size = F.abs(x)
    power = F.floor(F.log2(size))
    half = F.floor(-power / 2)
    mantissa = size * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -power - half) * F.lit(2.0**53)
    steps = (power + 1100).cast("decimal(5,0)") * F.lit(Decimal(2**55)) + mantissa.cast("long").cast("decimal(20,0)")
    top = F.lit(Decimal(2300 * 2**55)).cast("decimal(22,0)")
    known = F.when(size == 0, F.lit(0).cast("decimal(22,0)")).when(size == F.lit(float("inf")), top).otherwise(steps.cast("decimal(22,0)"))
    return F.when(F.isnan(x), top + 1).when(x < 0, -known).otherwise(known)


def partial_rollup(
    df: DataFrame, keys: Sequence[str], stats: Mapping[str, Sequence[str]],
    firsts: Sequence[str] = (), ts: str = "timestamp",
) -> DataFrame:
    """Mergeable daily parts (sum, count, extremes, first value and its order)."""
    aggs: list[Column] = [F.min(ts).alias("_seen")]
    for c, kinds in stats.items():
        if {"mean", "sum"} & set(kinds):
            aggs.append(F.sum(c).alias(f"_sum_{c}"))
        if "mean" in kinds:
            aggs.append(F.count(c).alias(f"_n_{c}"))
        aggs += [F.max(c).alias(f"_max_{c}")] if "max" in kinds else []
        aggs += [F.min(c).alias(f"_min_{c}")] if "min" in kinds else []
    for c in firsts:
        place = _order(ts, c, df.schema[c].dataType)
        aggs.append(F.min_by(c, place).alias(f"_first_{c}"))
        aggs.append(F.min(place).alias(f"_at_{c}"))
    return df.groupBy(*keys).agg(*aggs)


def _added(parts: DataFrame) -> list[Column]:
    """Aggregates that make one part of several."""
    pick = {"sum": F.sum, "n": F.sum, "max": F.max, "min": F.min, "at": F.min, "seen": F.min}
    out: list[Column] = []
    for name in parts.columns:
        kind = name.split("_")[1] if name.startswith("_") else ""
        if kind in pick:
            out.append(pick[kind](name).alias(name))
        elif kind == "first":
            out.append(F.min_by(name, name.replace("_first_", "_at_", 1)).alias(name))
    return out


def add_parts(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts made by :func:`partial_rollup` with one part for each value of ``keys``."""
    return parts.groupBy(*keys).agg(*_added(parts))


def merge_rollup(
    parts: DataFrame, keys: Sequence[str], stats: Mapping[str, Sequence[str]],
    firsts: Sequence[str] = (), text: Sequence[str] = (), combine: bool = True,
) -> DataFrame:
    """Finish parts made by :func:`partial_rollup`, adding up those of one key if asked."""
    if combine:
        firsts_of_text = [
            F.min(F.when(F.col(c).isNotNull(), F.struct("_seen", c)))[c].alias(f"_first_{c}")
            for c in text
        ]
        parts = parts.groupBy(*keys).agg(*_added(parts), *firsts_of_text)
    out: list[Column] = [F.col(k) for k in keys]
    for c, kinds in stats.items():
        out += [_stat(c, kind) for kind in kinds]
    out += [F.col(f"_first_{c}").alias(c) for c in [*firsts, *text]]
    return parts.select(*out)


def _stat(c: str, kind: str) -> Column:
    name = STAT_NAMES.get(f"{c}_{kind}", f"{c}_{kind}")
    if kind == "mean":
        # count is 0 exactly where the sum is NULL
        value = F.try_divide(F.col(f"_sum_{c}"), F.col(f"_n_{c}"))
    elif kind == "sum":
        value = F.coalesce(F.col(f"_sum_{c}"), F.lit(0.0))
        if name == "GHI_daily_kWh_m2":
            value = value / F.lit(WH_PER_KWH)
    else:
        value = F.col(f"_{kind}_{c}")
    return value.alias(name)


def _by_date(keys: Sequence[str], date: str):
    # One row per site and day: a group is bounded by the calendar (365 rows a year).
    return Window.partitionBy(*keys).orderBy(date)


def with_lags(
    daily: DataFrame, columns: Sequence[str] = LAGGED, lags: Sequence[int] = LAGS,
    keys: Sequence[str] = ("city",), date: str = "date",
) -> DataFrame:
    """Values of k rows before (rows, not calendar days) as ``<col>_lag<k>``."""
    w = _by_date(keys, date)
    return daily.withColumns(
        {f"{c}_lag{k}": F.lag(c, k).over(w) for c in present(daily, columns) for k in lags}
    )


def with_rolling_mean(
    daily: DataFrame, columns: Sequence[str] = ROLLED, rows: int = ROLL_DAYS,
    keys: Sequence[str] = ("city",), date: str = "date",
) -> DataFrame:
    """Mean of the last ``rows`` rows including this one as ``<col>_roll<rows>``."""
    w = _by_date(keys, date).rowsBetween(-(rows - 1), Window.currentRow)
    return daily.withColumns(
        {f"{c}_roll{rows}": F.avg(c).over(w) for c in present(daily, columns)}
    )


def with_next_day(
    daily: DataFrame, targets: Mapping[str, str] = NEXT_DAY,
    keys: Sequence[str] = ("city",), date: str = "date",
) -> DataFrame:
    """Next row's values as forecasting targets; NULL in the last row."""
    w = _by_date(keys, date)
    return daily.withColumns(
        {targets[c]: F.lead(c, 1).over(w) for c in present(daily, list(targets))}
    )


def forecast_columns(daily: DataFrame, keys: Sequence[str] = ("city",)) -> DataFrame:
    """Lags, rolling means and targets over one window ordering: one shuffle, one sort."""
    daily = with_lags(daily, keys=keys)
    daily = with_rolling_mean(daily, keys=keys)
    return with_next_day(daily, keys=keys)
