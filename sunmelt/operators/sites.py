"""Operators that bring site knowledge to hourly rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmelt.functions import calendar as cal
from sunmelt.functions import solar
from sunmelt.functions.nulls import clip, flag_gt, ratio
from sunmelt.runtime import attach, cut_lineage

# Heating index above which the solar resource counts as high, and the
# clock of the sites in minutes east of UTC.
HIGH_RESOURCE = 5.7
SITE_CLOCK_MINUTES = 330


def with_site(df: DataFrame, site_dim: DataFrame, key: str = "city") -> DataFrame:
    """Add the site's coordinates, altitude, climate zone and setpoint."""
    return attach(df, site_dim, [key])


def monthly_means(
    df: DataFrame, keys: Sequence[str] = ("city",), ts: str = "timestamp"
) -> DataFrame:
    """Mean irradiance and air temperature per site and calendar month."""
    return df.groupBy(*keys, cal.month_key(F.col(ts)).alias("month_start")).agg(
        F.avg("GHI").alias("Q_sol_ave"), F.avg("T_amb").alias("T_out_ave")
    )


def heating_index(q_sol: Column, t_set: Column, t_out: Column) -> Column:
    """Mean irradiance per degree of heating still needed, never negative."""
    return clip(ratio(q_sol, t_set - t_out), 0)


def with_heating_index(
    df: DataFrame, site_dim: DataFrame | None = None, keys: Sequence[str] = ("city",),
    ts: str = "timestamp",
) -> DataFrame:
    """Add the monthly ``RRTDHS`` and the ``high_solar_resource`` flag to every row.

    The setpoint comes from ``site_dim``, or from the rows' own ``T_set``. The month table
    (one row per site and month) is aggregated with partial means, written once, and joined
    back, so the hourly rows are not shuffled and no task holds a whole month of a site.
    """
    keys = list(keys)
    months = monthly_means(df, keys, ts)
    if site_dim is not None:
        months = attach(cut_lineage(months), site_dim.select(*keys, "T_set"), keys)
    else:
        months = cut_lineage(
            df.groupBy(*keys, cal.month_key(F.col(ts)).alias("month_start")).agg(
                F.avg("GHI").alias("Q_sol_ave"),
                F.avg("T_amb").alias("T_out_ave"),
                F.max("T_set").alias("T_set"),
            )
        )
    index = months.select(
        *keys,
        "month_start",
        heating_index(F.col("Q_sol_ave"), F.col("T_set"), F.col("T_out_ave")).alias("RRTDHS"),
    )
    hourly = df.withColumn("month_start", cal.month_key(F.col(ts)))
    return (
        attach(hourly, index, [*keys, "month_start"], spread_by=[ts])
        .drop("month_start")
        .withColumn("high_solar_resource", flag_gt(F.col("RRTDHS"), HIGH_RESOURCE))
    )


def with_solar_position(
    df: DataFrame, ts: str = "timestamp", lat: str = "lat", lon: str = "lon",
    altitude: str = "altitude_m",
) -> DataFrame:
    """Add apparent zenith ``SZA``, ``solar_azimuth`` and ``ETR`` from the UTC clock."""
    t = F.col(ts)
    b = solar.day_angle(solar.fractional_day(t))
    # Each step is used more than once by the next, so none is worked out twice.
    df = df.withColumns({"_b": b, "_phi": F.radians(lat)})
    df = df.withColumns(
        {
            "_decl": solar.declination(F.col("_b")),
            "_angle": solar.hour_angle(t, F.col(lon), solar.equation_of_time(F.col("_b"))),
        }
    )
    west, north, up = solar.sun_vector(F.col("_phi"), F.col("_decl"), F.col("_angle"))
    df = df.withColumns({"_west": west, "_north": north, "_up": up})
    df = df.withColumn(
        "_zenith", solar.true_zenith(F.col("_west"), F.col("_north"), F.col("_up"))
    )
    return df.withColumns(
        {
            "SZA": solar.apparent_zenith(F.col("_zenith"), F.col(altitude)),
            "solar_azimuth": solar.azimuth(F.col("_west"), F.col("_north")),
            "ETR": solar.extraterrestrial(F.dayofyear(t)),
        }
    ).drop("_b", "_phi", "_decl", "_angle", "_west", "_north", "_up", "_zenith")


def turbidity_profile(turbidity: DataFrame, key: str = "city") -> DataFrame:
    """(site, month, TL) rows to one row per site with an array of twelve values."""
    months = [F.max(F.when(F.col("month") == m, F.col("TL"))) for m in range(1, 13)]
    return turbidity.groupBy(key).agg(F.array(*months).alias("tl_by_month"))


def with_clear_sky(
    df: DataFrame, turbidity: DataFrame | None, key: str = "city", ts: str = "timestamp",
    altitude: str = "altitude_m",
) -> DataFrame:
    """Add ``GHI_clearsky`` and, where there is ``GHI``, the clear-sky index ``CSI``.

    ``turbidity`` has (site, month, TL); with None the rows carry ``tl_by_month``.
    """
    if turbidity is not None:
        df = attach(df, turbidity_profile(turbidity, key), [key], spread_by=[ts])
    tl = solar.turbidity_on(F.col("tl_by_month"), F.dayofyear(ts))
    clear = solar.clear_sky_ghi(F.col("SZA"), tl, F.col(altitude), F.col("ETR"))
    out = df.withColumn("GHI_clearsky", clear)
    if "GHI" in out.columns:
        out = out.withColumn(
            "CSI", solar.clear_sky_index(F.col("GHI"), F.col("GHI_clearsky"))
        )
    return out.drop("tl_by_month")


def with_sun_times(
    df: DataFrame, ts: str = "timestamp", lat: str = "lat", lon: str = "lon",
    offset_minutes: int | Column = SITE_CLOCK_MINUTES,
) -> DataFrame:
    """Add ``sunrise_hour`` and ``sunset_hour`` of the row's date.

    Both are closed forms of site and date, so they are computed in place: no distinct
    dates table and no join.
    """
    day, phi, lam = F.to_date(ts), F.col(lat), F.col(lon)
    return df.withColumns(
        {
            "sunrise_hour": solar.sun_hour(day, phi, lam, offset_minutes, rising=True),
            "sunset_hour": solar.sun_hour(day, phi, lam, offset_minutes, rising=False),
        }
    )
