"""Gridded weather readings to hourly climate features per site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmelt.functions import calendar as cal
from sunmelt.functions import meteo
from sunmelt.operators.columns import nan_to_null, resolve_alias, select_known
from sunmelt.operators.grid import spatial_mean
from sunmelt.operators.sites import (
    SITE_CLOCK_MINUTES,
    with_clear_sky,
    with_heating_index,
    with_site,
    with_solar_position,
    with_sun_times,
)
from sunmelt.runtime import written_table

# Columns of the hourly climate table, in order.
CLIMATE_COLUMNS = (
    "timestamp", "T_amb", "T_dew", "RHum", "W_spd", "W_dir", "GHI", "DNI", "LW_down",
    "cloud_cover", "precipitation", "P_atm", "hour", "month", "DOY", "year", "season",
    "season_code", "SZA", "solar_azimuth", "ETR", "GHI_clearsky", "CSI", "DHI", "RRTDHS",
    "sunrise_hour", "sunset_hour", "city", "lat", "lon", "altitude_m", "climate_zone", "T_set",
    "high_solar_resource",
)


def convert_units(df: DataFrame) -> DataFrame:
    """Weather variables (short names) to physical features; absent variables are skipped."""
    have = set(df.columns)

    def col(name: str) -> Column | None:
        return F.col(name) if name in have else None

    new: dict[str, Column] = {}
    if "t2m" in have:
        new["T_amb"] = meteo.celsius(col("t2m"))
    if "d2m" in have:
        new["T_dew"] = meteo.celsius(col("d2m"))
    if {"t2m", "d2m"} <= have:
        new["RHum"] = meteo.magnus_humidity(new["T_amb"], new["T_dew"])
    if {"u10", "v10"} <= have:
        new["W_spd"] = meteo.wind_speed(col("u10"), col("v10"))
        new["W_dir"] = meteo.wind_direction(col("u10"), col("v10"))
    if "ssrd" in have:
        new["GHI"] = col("ssrd") / F.lit(meteo.SECONDS_PER_HOUR)
    if "fdir" in have:
        new["DNI"] = col("fdir")
    if "strd" in have:
        new["LW_down"] = col("strd") / F.lit(meteo.SECONDS_PER_HOUR)
    if "tcc" in have:
        new["cloud_cover"] = col("tcc")
    if "tp" in have:
        new["precipitation"] = meteo.millimetres(col("tp"))
    if "sp" in have:
        new["P_atm"] = meteo.hectopascal(col("sp"))
    return meteo.limited(df.withColumns(new), list(new.keys() & meteo.LIMITS.keys()))


def time_features(
    df: DataFrame, ts: str = "timestamp", offset_minutes: int | Column = 0
) -> DataFrame:
    """Hour, month, day of year, year and season of the (shifted) clock."""
    t = cal.local_time(F.col(ts), offset_minutes)
    return (
        df.withColumns(
            {"hour": F.hour(t), "month": F.month(t), "DOY": F.dayofyear(t), "year": F.year(t)}
        )
        .withColumn("season", cal.season_of(F.col("month")))
        .withColumn("season_code", cal.season_code(F.col("season")))
    )


def climate_hourly(
    grid: DataFrame,
    site_dim: DataFrame,
    turbidity: DataFrame,
    clock_minutes: int | Column = 0,
    sun_clock_minutes: int | Column = SITE_CLOCK_MINUTES,
) -> DataFrame:
    """Hourly features of every site.

    ``grid`` has site, timestamp (UTC), latitude, longitude and weather variables under any
    known name; ``site_dim`` has city, lat, lon, altitude_m, climate_zone and T_set;
    ``turbidity`` has city, month and TL. The spatial mean is the only shuffle of the grid
    and its result is written once, as the monthly index reads it as well.

    With a ``clock_minutes`` shift the rows also have ``local_time``. Hour, date, month and
    season, the month of the index, the date of the sun times and later the day of the
    rollup all follow that clock; positions of the sun follow UTC.
    """
    cells = resolve_alias(nan_to_null(grid.withColumnsRenamed({"time": "timestamp"})))
    hourly = written_table(spatial_mean(cells)).withColumnsRenamed({"site": "city"})
    site_columns = ["city", "lat", "lon", "altitude_m", "climate_zone", "T_set"]
    df = with_site(convert_units(hourly), select_known(site_dim, site_columns))
    shifted = not (isinstance(clock_minutes, int) and clock_minutes == 0)
    clock = "local_time" if shifted else "timestamp"
    if shifted:
        df = df.withColumn(clock, cal.local_time(F.col("timestamp"), clock_minutes))
    df = time_features(df, clock)
    df = with_solar_position(df)
    df = with_clear_sky(df, turbidity)
    if {"GHI", "DNI"} <= set(df.columns):
        dhi = meteo.unlimited_diffuse(F.col("GHI"), F.col("DNI"), F.col("SZA"))
        df = meteo.limited(df.withColumn("DHI", dhi), ["DHI"])
    if {"GHI", "T_amb"} <= set(df.columns):
        df = with_heating_index(df, ts=clock)
    df = with_sun_times(df, ts=clock, offset_minutes=sun_clock_minutes)
    return select_known(df, [*CLIMATE_COLUMNS, "local_time"])
