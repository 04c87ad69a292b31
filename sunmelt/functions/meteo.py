"""Unit conversions and moist-air formulas on hourly weather readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmelt.functions.nulls import clip

# Magnus coefficients, ice point, seconds per hour.
MAGNUS_A = 17.625
MAGNUS_B = 243.04
ZERO_CELSIUS_K = 273.15
SECONDS_PER_HOUR = 3600.0
# Range each feature is limited to.
LIMITS: dict[str, tuple[float | None, float | None]] = {
    "RHum": (0.0, 100.0),
    "GHI": (0.0, None),
    "LW_down": (0.0, None),
    "cloud_cover": (0.0, 1.0),
    "DHI": (0.0, None),
}


def celsius(kelvin: Column) -> Column:
    return kelvin - F.lit(ZERO_CELSIUS_K)


def magnus_humidity(t_amb: Column, t_dew: Column) -> Column:
    """Percent, from air and dew-point temperature in Celsius, before limiting."""

    def saturation_exponent(t: Column) -> Column:
        return F.try_divide(F.lit(MAGNUS_A) * t, F.lit(MAGNUS_B) + t)

    return F.lit(100.0) * F.exp(saturation_exponent(t_dew) - saturation_exponent(t_amb))


def relative_humidity(t_amb: Column, t_dew: Column) -> Column:
    return clip(magnus_humidity(t_amb, t_dew), *LIMITS["RHum"])


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(u, v)), F.lit(360.0))


def hourly_flux(joules: Column) -> Column:
    """Energy gathered over one hour (J/m2) as mean power (W/m2), never negative."""
    return clip(joules / F.lit(SECONDS_PER_HOUR), *LIMITS["GHI"])


def cloud_fraction(c: Column) -> Column:
    return clip(c, *LIMITS["cloud_cover"])


def millimetres(metres: Column) -> Column:
    return metres * F.lit(1000.0)


def hectopascal(pascal: Column) -> Column:
    return pascal / F.lit(100.0)


def unlimited_diffuse(ghi: Column, dni: Column, zenith_deg: Column) -> Column:
    return ghi - dni * F.cos(F.radians(zenith_deg))


def diffuse_irradiance(ghi: Column, dni: Column, zenith_deg: Column) -> Column:
    return clip(unlimited_diffuse(ghi, dni, zenith_deg), *LIMITS["DHI"])


def limited(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Limit feature columns that are already there. A limit names its input three times, so
    long formulas become a column first and are limited by name."""
    names = [c for c in (columns or LIMITS) if c in df.columns]
    return df.withColumns({c: clip(F.col(c), *LIMITS[c]) for c in names})
