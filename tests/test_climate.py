"""Hourly climate features: formulas, missing values, and the whole plan on a small grid."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sunmelt import schema
from sunmelt.functions import calendar as cal
from sunmelt.functions import demand, meteo, nulls, solar
from sunmelt.operators import grid as grids
from sunmelt.operators import sites
from sunmelt.plans import climate
from sunmelt.runtime import attach

SITES = [
    ("Coimbatore", 11.0, 77.0, 411, "hot-humid", 45.0, 10.5, 11.5, 76.5, 77.5),
    ("Jaisalmer", 26.9, 70.9, 225, "hot-arid", 55.0, 26.5, 27.5, 70.5, 71.5),
]
START = dt.datetime(2021, 3, 1)
NAN = float("nan")


@pytest.fixture(scope="module")
def site_dim(spark):
    return spark.createDataFrame(SITES, schema.SITE_DIM)


@pytest.fixture(scope="module")
def turbidity(spark):
    rows = [(s[0], m, 3.0 + 0.1 * m) for s in SITES for m in range(1, 13)]
    return spark.createDataFrame(rows, schema.TURBIDITY)


@pytest.fixture(scope="module")
def readings():
    rows = []
    for site, lat, lon, *_ in SITES:
        for h in range(240):
            ts = START + dt.timedelta(hours=h)
            sun = max(0.0, math.sin((h % 24 - 1) / 12 * math.pi))
            for i, (dlat, dlon) in enumerate([(0, 0), (0.25, 0), (0, 0.25), (0.25, 0.25)]):
                t = 300.0 + 5 * sun + i
                ssrd, tcc = sun * 3.0e6 + i, 0.3 + 0.1 * i
                if h == 5 and i == 0:
                    t, ssrd = NAN, None
                if h == 7:
                    t = None
                if h == 8:
                    ssrd = -50.0
                if h == 9:
                    tcc = 1.4
                rows.append(
                    (site, ts, lat + dlat, lon + dlon, t, 295.0 + i / 2, ssrd, sun * 500.0, 1.2e6,
                     -1.0, -1.0, 0.0005, tcc, 98000.0)
                )
    return rows


@pytest.fixture(scope="module")
def hourly(spark, readings, site_dim, turbidity):
    grid = spark.createDataFrame(readings, schema.GRID)
    return climate.climate_hourly(grid, site_dim, turbidity).toPandas()


def test_plan_has_the_columns_of_the_contract(hourly):
    assert list(hourly.columns) == list(climate.CLIMATE_COLUMNS)
    assert len(hourly) == 2 * 240


def test_physical_limits(hourly):
    rh = hourly["RHum"].dropna()
    assert ((rh >= 0) & (rh <= 100)).all()
    assert ((hourly["CSI"].dropna() >= 0) & (hourly["CSI"].dropna() <= 1.5)).all()
    assert (hourly["DHI"].dropna() >= 0).all()
    assert (hourly.loc[hourly["SZA"] > 90, "GHI_clearsky"] == 0).all()
    assert (hourly.loc[hourly["SZA"] < 85, "GHI_clearsky"] > 0).all()
    assert hourly["GHI_clearsky"].max() < 1200
    assert ((hourly["cloud_cover"] >= 0) & (hourly["cloud_cover"] <= 1)).all()
    assert ((hourly["solar_azimuth"] >= 0) & (hourly["solar_azimuth"] < 360)).all()


def test_missing_readings(hourly):
    one = hourly[hourly["city"] == "Coimbatore"].set_index("timestamp")
    at = lambda h: one.loc[START + dt.timedelta(hours=h)]
    # the cell with NaN is left out of the mean
    sun = max(0.0, math.sin((5 - 1) / 12 * math.pi))
    assert at(5)["T_amb"] == pytest.approx(300.0 + 5 * sun + 2 - 273.15)
    # an hour without any reading stays missing, and so does what needs it
    assert math.isnan(at(7)["T_amb"]) and math.isnan(at(7)["RHum"])
    assert at(8)["GHI"] == 0.0
    assert at(9)["cloud_cover"] == 1.0
    assert at(0)["W_dir"] == pytest.approx(225.0)
    assert at(0)["W_spd"] == pytest.approx(math.sqrt(2))


def test_monthly_index(hourly):
    for site in SITES:
        one = hourly[hourly["city"] == site[0]]
        want = max(0.0, one["GHI"].mean() / (site[5] - one["T_amb"].mean()))
        assert one["RRTDHS"].to_numpy() == pytest.approx(want)
        assert (one["high_solar_resource"] == int(want > 5.7)).all()


def test_absent_variables_are_skipped(spark, readings, site_dim, turbidity):
    grid = spark.createDataFrame(readings[:200], schema.GRID).drop("fdir", "d2m", "u10")
    out = climate.climate_hourly(grid.withColumnRenamed("t2m", "2m_temperature"), site_dim, turbidity)
    missing = set(climate.CLIMATE_COLUMNS) - set(out.columns)
    assert missing == {"T_dew", "RHum", "W_spd", "W_dir", "DNI", "DHI"}
    assert out.count() == 50


def column(spark, expr, rows, ddl):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(expr).collect()]


def test_extraterrestrial_irradiance(spark):
    january, july = column(spark, solar.extraterrestrial(F.col("d")), [(3,), (185,)], "d int")
    assert january == pytest.approx(1413, abs=2) and july == pytest.approx(1321, abs=2)


def test_declination_and_equation_of_time(spark):
    days = [(80,), (172,), (266,), (355,)]
    b = solar.day_angle(F.col("d"))
    decl = column(spark, F.degrees(solar.declination(b)), days, "d int")
    assert decl == pytest.approx([-0.2, 23.45, 0.1, -23.45], abs=0.4)
    eot = column(spark, solar.equation_of_time(b), [(42,), (307,)], "d int")
    assert eot == pytest.approx([-14.2, 16.4], abs=0.3)


def test_sun_position_over_known_places(spark):
    rows = [
        # overhead at solar noon on the tropic in June; due south over Greenwich at noon
        (dt.datetime(2021, 6, 21, 12, 2), 23.44, 0.0, 0),
        (dt.datetime(2021, 12, 21, 11, 58), 51.48, 0.0, 0),
        # sunrise due east on the equator at the equinox
        (dt.datetime(2021, 3, 20, 6, 7), 0.0, 0.0, 0),
    ]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, lat double, lon double, altitude_m int")
    a, b, c = sites.with_solar_position(df).collect()
    assert a["SZA"] == pytest.approx(0.0, abs=0.5)
    assert b["SZA"] == pytest.approx(74.9, abs=0.3) and b["solar_azimuth"] == pytest.approx(180, abs=1)
    assert c["SZA"] == pytest.approx(89.5, abs=0.7) and c["solar_azimuth"] == pytest.approx(90, abs=1)


def test_sun_times(spark):
    rows = [
        (dt.datetime(2021, 6, 21), 26.9, 70.9), (dt.datetime(2021, 12, 21), 26.9, 70.9),
        (dt.datetime(2021, 6, 21), 75.0, 20.0),
    ]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, lat double, lon double")
    summer, winter, polar = sites.with_sun_times(df).collect()
    # almanac: 05:52-19:44 and 07:25-17:53 on the clock of the place
    assert summer["sunrise_hour"] == pytest.approx(5 + 57 / 60, abs=0.15)
    assert summer["sunset_hour"] == pytest.approx(19 + 40 / 60, abs=0.15)
    assert winter["sunset_hour"] - winter["sunrise_hour"] == pytest.approx(10.5, abs=0.15)
    assert polar["sunrise_hour"] is None and polar["sunset_hour"] is None


def test_turbidity_is_linear_between_month_middles(spark):
    rows = [([float(m) for m in range(1, 13)], d) for d in (1, 16, 46, 30, 350, 366)]
    got = column(spark, solar.turbidity_on(F.col("a"), F.col("d")), rows, "a array<double>, d int")
    assert got[1] == pytest.approx(1.0)
    assert got[0] == pytest.approx(12 - 11 * 16 / 31, abs=0.2)  # January 1, on the way 12 -> 1
    assert 1.0 < got[3] < 2.0
    assert got[4] == pytest.approx(12.0)


@pytest.mark.parametrize("month, name, code", [(12, "winter", 0), (2, "winter", 0), (3, "pre-monsoon", 1),
                                               (5, "pre-monsoon", 1), (6, "monsoon", 2),
                                               (9, "monsoon", 2), (10, "post-monsoon", 3)])
def test_seasons(spark, month, name, code):
    season = cal.season_of(F.col("m"))
    df = spark.createDataFrame([(month,)], "m int")
    assert tuple(df.select(season, cal.season_code(season), cal.season_name(cal.season_code(season))).first()) == (name, code, name)


def test_local_clock_shift(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 12, 31, 20, 45),)], "timestamp timestamp_ntz")
    r = climate.time_features(df, offset_minutes=330).first()
    assert (r["hour"], r["month"], r["DOY"], r["year"], r["season"]) == (2, 1, 1, 2021, "winter")


def test_missing_value_rules(spark):
    df = spark.createDataFrame([(5.8,), (5.7,), (NAN,), (None,)], "x double")
    flags = [r[0] for r in df.select(nulls.flag_gt(F.col("x"), 5.7)).collect()]
    assert flags == [1, 0, 0, 0]
    clean = df.select(nulls.no_nan(F.col("x")).alias("x"))
    assert [r[0] for r in clean.select(nulls.clip(F.col("x"), 0, 5)).collect()] == [5.0, 5.0, None, None]
    bins = [r[0] for r in clean.select(demand.index_bin(F.col("x"))).collect()]
    assert bins == ["high", "high", "high", "high"]
    low = spark.createDataFrame([(3.99,), (4.0,), (5.69,)], "x double")
    assert [r[0] for r in low.select(demand.index_bin(F.col("x"))).collect()] == ["low", "medium", "medium"]


def test_clear_sky_index_rules(spark):
    rows = [(500.0, None), (500.0, 10.0), (None, 400.0), (500.0, 400.0), (900.0, 400.0), (-5.0, 400.0)]
    got = column(spark, solar.clear_sky_index(F.col("g"), F.col("c")), rows, "g double, c double")
    assert got == [0.0, 0.0, None, 1.25, 1.5, 0.0]


def test_zero_divisor_gives_null_index(spark):
    df = spark.createDataFrame([(100.0, 45.0, 45.0), (100.0, 45.0, 50.0)], "q double, s double, t double")
    got = [r[0] for r in df.select(sites.heating_index(F.col("q"), F.col("s"), F.col("t"))).collect()]
    assert got == [None, 0.0]


def test_demand_profile_totals(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("hour"))
    litres = [r[0] for r in df.select(demand.demand_litres(F.col("hour"))).collect()]
    assert sum(litres) == 5 + 25 + 30 + 20 + 10 + 35 + 10 + 20 + 25 + 15 + 10 + 5 + 3 + 5 * 2
    assert litres[0] == 2.0 and litres[7] == 30.0 and litres[23] == 3.0


def test_slice_grid(spark):
    rows = [
        (dt.datetime(y, m, 3, h), lat, 77.0)
        for y in (2019, 2020, 2021, 2022) for m in (1, 7) for h in (0, 12) for lat in (9.0, 10.5, 11.5)
    ]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, latitude double, longitude double")
    out = grids.slice_grid(df, (11.5, 76.5, 10.5, 77.5), years=[2020, 2022], months=[7], hours=[12])
    assert out.count() == 2 * 1 * 1 * 2
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "2023-01-01" in plan  # the year list reaches the scan as a range


@pytest.mark.parametrize("tile", [0.3, 1.0, 20.0])
def test_sites_of_cells_equal_a_plain_loop(spark, site_dim, tile):
    extra = spark.createDataFrame(
        [("Overlap", 11.0, 77.0, 0, "x", 45.0, 11.25, 12.0, 77.0, 79.0),
         ("South", -33.0, -70.0, 0, "x", 45.0, -33.5, -32.5, -70.5, -69.5)], schema.SITE_DIM,
    )
    sites_dim = site_dim.unionByName(extra)
    cells = [(lat / 4, lon / 4) for lat in range(40, 50) for lon in range(304, 320)]
    cells += [(-33.5, -70.5), (-33.51, -70.0), (-32.5, -69.5), (27.5, 70.5), (None, 77.0)]
    df = spark.createDataFrame(cells, "latitude double, longitude double")
    got = sorted(tuple(r) for r in grids.assign_sites(df, sites_dim, tile).select("site", "latitude", "longitude").collect())
    want = sorted(
        (s["city"], la, lo) for s in sites_dim.collect() for la, lo in cells
        if la is not None and s["lat_min"] <= la <= s["lat_max"] and s["lon_min"] <= lo <= s["lon_max"]
    )
    assert got == want and len(want) > 30


@pytest.mark.parametrize("most", [grids.MAX_BOXES, 10])
def test_many_sites_do_not_move_the_cells(spark, monkeypatch, most):
    """Boxes whose tiles are too many to be broadcast, though the boxes are not; ``most``: as if they were."""
    monkeypatch.setattr(grids, "MAX_BOXES", most)
    rng = np.random.default_rng(4)
    south, west = rng.integers(-400, 400, 50_000) / 8, rng.integers(-800, 800, 50_000) / 8
    north, east = south + rng.integers(4, 20, 50_000) / 8, west + rng.integers(4, 20, 50_000) / 8
    sites = spark.createDataFrame(
        pd.DataFrame({"city": np.arange(50_000), "lat_min": south, "lat_max": north, "lon_min": west, "lon_max": east})
    )
    places = rng.integers(-440, 440, 300) / 8, rng.integers(-880, 880, 300) / 8
    cells = spark.createDataFrame([*zip(*(p.tolist() for p in places)), (None, 1.0), (1.0, None)], "latitude double, longitude double")
    want = sorted(
        (int(i), la, lo) for la, lo in zip(*(p.tolist() for p in places))
        for i in np.flatnonzero((south <= la) & (la <= north) & (west <= lo) & (lo <= east))
    )
    monkeypatch.setattr(grids, "attach", lambda *a, **k: joined.append(k.get("small")) or attach(*a, **k))
    joined = []
    out = grids.assign_sites(cells, sites)
    assert out.columns == ["latitude", "longitude", "site"]
    assert sorted((r["site"], r["latitude"], r["longitude"]) for r in out.collect()) == want and len(want) > 900
    assert joined == [most > 10]  # broadcast, or shuffled with the cells


def test_spatial_mean_does_not_depend_on_partitioning(spark, readings):
    grid = spark.createDataFrame(readings, schema.GRID)
    one = grids.spatial_mean(grid.repartition(1)).orderBy("site", "timestamp").toPandas()
    many = grids.spatial_mean(grid.repartition(13)).orderBy("site", "timestamp").toPandas()
    for c in ("t2m", "ssrd", "tcc"):
        assert one[c].round(6).equals(many[c].round(6))


def test_humidity_formula(spark):
    got = column(spark, meteo.relative_humidity(F.col("t"), F.col("d")),
                 [(20.0, 20.0), (30.0, 20.0), (10.0, 20.0), (None, 1.0)], "t double, d double")
    assert got[0] == pytest.approx(100.0) and got[1] == pytest.approx(55.1, abs=0.2)
    assert got[2] == 100.0 and got[3] is None
