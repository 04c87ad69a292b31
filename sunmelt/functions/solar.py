"""Closed-form solar geometry and clear-sky irradiance as column expressions.

Public formulas: Spencer (1971) for declination, equation of time and earth-sun distance;
Saemundsson refraction; Kasten and Young (1989) air mass; Ineichen (2002) clear sky.
Positions are expected within a few tenths of a degree of numerical solvers.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sunmelt.functions.nulls import clip

# Fixed values of the published formulas.
SOLAR_CONSTANT = 1366.1
EARTH_SUN = (1.00011, 0.034221, 0.00128, 0.000719, 0.000077)
DECLINATION = (0.006918, -0.399912, 0.070257, -0.006758, 0.000907, -0.002697, 0.00148)
EQUATION_OF_TIME = (0.000075, 0.001868, -0.032077, -0.014615, -0.040849)
EOT_MINUTES = 229.18
SUNRISE_ELEVATION_DEG = -0.833
REFRACTION_LIMIT_DEG = -0.8337
STANDARD_PRESSURE_PA = 101325.0
SITE_TEMPERATURE_C = 12.0
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
CLEARSKY_FLOOR = 10.0
CSI_MAX = 1.5


def day_angle(day: Column) -> Column:
    """Angle of the year in radians for a (possibly fractional) day of year starting at 1."""
    return (day - F.lit(1.0)) * F.lit(2.0 * math.pi / 365.0)


def fractional_day(ts: Column) -> Column:
    seconds = F.hour(ts) * F.lit(3600.0) + F.minute(ts) * F.lit(60.0) + F.second(ts)
    return F.dayofyear(ts) + seconds / F.lit(86400.0)


def _fourier(b: Column, coefficients: tuple[float, ...]) -> Column:
    """``c0 + c1 cos b + c2 sin b + c3 cos 2b + c4 sin 2b + ...``"""
    out = F.lit(coefficients[0])
    for i, c in enumerate(coefficients[1:]):
        angle = b * F.lit(float(i // 2 + 1))
        out = out + F.lit(c) * (F.sin(angle) if i % 2 else F.cos(angle))
    return out


def declination(b: Column) -> Column:
    """Radians."""
    return _fourier(b, DECLINATION)


def equation_of_time(b: Column) -> Column:
    """Minutes."""
    return F.lit(EOT_MINUTES) * _fourier(b, EQUATION_OF_TIME)


def extraterrestrial(day_of_year: Column) -> Column:
    """Irradiance outside the atmosphere (W/m2) for a whole day of year."""
    return F.lit(SOLAR_CONSTANT) * _fourier(day_angle(day_of_year), EARTH_SUN)


def hour_angle(ts: Column, lon: Column, eot: Column) -> Column:
    """Radians, from a UTC clock."""
    minutes = F.hour(ts) * F.lit(60.0) + F.minute(ts) + F.second(ts) / F.lit(60.0)
    return F.radians((minutes + F.lit(4.0) * lon + eot) / F.lit(4.0) - F.lit(180.0))


def sun_vector(phi: Column, decl: Column, angle: Column) -> tuple[Column, Column, Column]:
    """Direction away from the sun on the ground (west, north) and its height (up), as a unit
    vector; ``phi`` is the latitude in radians."""
    west = F.cos(decl) * F.sin(angle)
    north = F.sin(phi) * F.cos(decl) * F.cos(angle) - F.cos(phi) * F.sin(decl)
    up = F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(angle)
    return west, north, up


def true_zenith(west: Column, north: Column, up: Column) -> Column:
    """Degrees, without refraction."""
    return F.degrees(F.atan2(F.sqrt(west * west + north * north), up))


def azimuth(west: Column, north: Column) -> Column:
    """Degrees clockwise from north."""
    return F.pmod(F.degrees(F.atan2(west, north)) + F.lit(180.0), F.lit(360.0))


def site_pressure(altitude: Column) -> Column:
    """Standard-atmosphere pressure (Pa) at an altitude in metres."""
    return F.lit(100.0) * F.pow(
        (F.lit(44331.514) - altitude) / F.lit(11880.516), F.lit(1.0 / 0.1902632)
    )


def apparent_zenith(zenith: Column, altitude: Column) -> Column:
    """Zenith as seen through the refracting air above the site, in degrees."""
    elevation = F.lit(90.0) - zenith
    lift = F.lit(1.02 / 60.0) / F.tan(
        F.radians(elevation + F.lit(10.3) / (elevation + F.lit(5.11)))
    )
    air = site_pressure(altitude) / F.lit(101000.0) * F.lit(283.0 / (273.0 + SITE_TEMPERATURE_C))
    # Well below the horizon there is nothing to refract (and the formula has a pole there).
    return F.when(elevation < F.lit(REFRACTION_LIMIT_DEG), zenith).otherwise(zenith - lift * air)


def relative_air_mass(zenith: Column) -> Column:
    """Only meant for a sun above the horizon."""
    depth = F.pow(F.lit(96.07995) - zenith, F.lit(-1.6364))
    return F.lit(1.0) / (F.cos(F.radians(zenith)) + F.lit(0.50572) * depth)


def absolute_air_mass(zenith: Column, altitude: Column) -> Column:
    return relative_air_mass(zenith) * site_pressure(altitude) / F.lit(STANDARD_PRESSURE_PA)


def clear_sky_ghi(zenith: Column, turbidity: Column, altitude: Column, etr: Column) -> Column:
    """Clear-sky global irradiance (W/m2); 0 below the horizon."""
    fh1 = F.exp(-altitude / F.lit(8000.0))
    fh2 = F.exp(-altitude / F.lit(1250.0))
    cg1 = F.lit(5.09e-5) * altitude + F.lit(0.868)
    cg2 = F.lit(3.92e-5) * altitude + F.lit(0.0387)
    mass = absolute_air_mass(zenith, altitude)
    through = F.exp(-cg2 * mass * (fh1 + fh2 * (turbidity - F.lit(1.0))))
    lit_up = cg1 * etr * F.cos(F.radians(zenith)) * through
    return F.when(zenith > F.lit(90.0), F.lit(0.0)).otherwise(lit_up)


def clear_sky_index(ghi: Column, clearsky: Column) -> Column:
    """Measured over clear-sky irradiance within 0..1.5; 0 at night or without clear sky."""
    index = clip(F.try_divide(ghi, clearsky), 0, CSI_MAX)
    return F.when(clearsky > F.lit(CLEARSKY_FLOOR), index).otherwise(F.lit(0.0))


def _interpolation() -> tuple[list[int], list[float]]:
    """For each day of the year, the month whose middle it follows and how far it is on the
    way to the next middle."""
    middles, start = [], 0
    for days in MONTH_DAYS:
        middles.append(start + (days + 1) / 2.0)
        start += days
    left, share = [], []
    for day in range(1, 367):
        passed = sum(day >= m for m in middles)
        here = middles[passed - 1] if passed else middles[11] - 365.0
        following = middles[passed] if passed < 12 else middles[0] + 365.0
        left.append(passed or 12)
        share.append((day - here) / (following - here))
    return left, share


def turbidity_on(by_month: Column, day_of_year: Column) -> Column:
    """Linke turbidity of a day, linear between the middles of the months.

    ``by_month`` is an array of twelve monthly values, January first. The months and weights
    of each day are constants, so a row costs a few array reads.
    """
    left, share = _interpolation()
    spot = day_of_year - 1

    def of_day(values: list, kind: str) -> Column:
        # one folded constant; an array of literals would cost one JVM call per day
        return F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), spot)

    before = F.get(by_month, of_day([m - 1 for m in left], "int"))
    after = F.get(by_month, of_day([m % 12 for m in left], "int"))
    return before + (after - before) * of_day(share, "double")


def day_arc(lat: Column, decl: Column) -> Column:
    """Half the daylight arc in degrees; NULL where the sun does not rise or set."""
    phi = F.radians(lat)
    sun = F.lit(math.sin(math.radians(SUNRISE_ELEVATION_DEG)))
    cos_w = (sun - F.sin(phi) * F.sin(decl)) / (F.cos(phi) * F.cos(decl))
    return F.when(F.abs(cos_w) <= F.lit(1.0), F.degrees(F.acos(cos_w)))


def sun_hour(
    date: Column, lat: Column, lon: Column, offset_minutes: int | Column, rising: bool
) -> Column:
    """Local clock hour (whole minutes as a fraction) of sunrise or sunset on a date."""
    b = day_angle(F.dayofyear(date) + F.lit(0.5))
    arc = day_arc(lat, declination(b))
    east = lon + arc if rising else lon - arc
    offset = offset_minutes if isinstance(offset_minutes, Column) else F.lit(float(offset_minutes))
    minutes = F.lit(720.0) - F.lit(4.0) * east - equation_of_time(b) + offset
    return F.floor(F.pmod(minutes, F.lit(1440.0))) / F.lit(60.0)
