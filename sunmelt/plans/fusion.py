"""Climate and materials to the hourly fused table and the daily model table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmelt.functions import calendar as cal
from sunmelt.operators.daily import DAILY_FIRSTS, daily_rollup, forecast_columns
from sunmelt.operators.fuse import (
    join_labels,
    join_materials,
    label_classes,
    with_demand,
    with_index_bin,
    with_label_code,
)
from sunmelt.operators.labels import assign_labels, season_index
from sunmelt.runtime import attach, cut_lineage, written_table


def label_map(climate: DataFrame, materials: DataFrame, material_id: str = "material_id") -> DataFrame:
    """Best material per site and season, from the measured index of the climate table."""
    index = cut_lineage(season_index(climate, keep=["T_set"]))
    return assign_labels(index, materials, material_id=material_id)


def fused_hourly(climate: DataFrame, materials: DataFrame, labels: DataFrame) -> DataFrame:
    """Hourly rows with demand, index bin, chosen material, its properties and label code."""
    df = with_index_bin(with_demand(climate))
    df = join_labels(df, labels, spread_by=["timestamp"])
    df = join_materials(df, materials, spread_by=["timestamp"])
    return with_label_code(df, label_classes(df), spread_by=["timestamp"])


def daily_features(fused: DataFrame) -> DataFrame:
    """Daily model table: statistics, first values, lags, rolling means, next-day targets."""
    return forecast_columns(daily_rollup(fused, ts=clock_of(fused)))


def clock_of(df: DataFrame) -> str:
    """The column whose date is a row's day: the site's own clock if there is one."""
    return "local_time" if "local_time" in df.columns else "timestamp"


def daily_from_climate(
    climate: DataFrame, materials: DataFrame, labels: DataFrame, site_dim: DataFrame | None = None
) -> DataFrame:
    """The same daily table straight from the climate rows, joining after the rollup.

    City and season are constant within a day, so what depends on them is joined to the
    daily rows: a twenty-fourth of the rows, and no text goes through the aggregation.
    """
    hourly = with_demand(climate).drop("season", "climate_zone")
    daily = daily_rollup(hourly, ts=clock_of(hourly)).withColumn("season", cal.season_of(F.col("month")))
    daily = written_table(daily)  # read for the label classes and again for the result
    if site_dim is not None and "climate_zone" in site_dim.columns:
        daily = attach(daily, site_dim.select("city", "climate_zone"), ["city"], spread_by=["date"])
    have = set(daily.columns)
    daily = join_labels(daily, labels, spread_by=["date"])
    daily = join_materials(daily, materials, spread_by=["date"])
    daily = with_label_code(daily, label_classes(daily), spread_by=["date"])
    kept = [c for c in daily.columns if c in have or c in DAILY_FIRSTS]
    return forecast_columns(daily.select(*kept))
