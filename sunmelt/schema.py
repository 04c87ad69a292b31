"""Schemas of the input tables."""

from __future__ import annotations

GRID = (
    "site string, timestamp timestamp_ntz, latitude double, longitude double, t2m double, "
    "d2m double, ssrd double, fdir double, strd double, u10 double, v10 double, tp double, "
    "tcc double, sp double"
)
SITE_DIM = (
    "city string, lat double, lon double, altitude_m int, climate_zone string, T_set double, "
    "lat_min double, lat_max double, lon_min double, lon_max double"
)
TURBIDITY = "city string, month int, TL double"
