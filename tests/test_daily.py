"""Daily table: gaps, missing values, first values, lags, and both fusion paths."""

import datetime as dt
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sunmelt.operators import daily, fuse
from sunmelt.plans import fusion

DAY = dt.datetime(2021, 5, 1)


def make_hours():
    rnd = random.Random(5)
    rows = []
    for city in ("a", "b"):
        for d in range(12):
            if d == 4:
                continue  # a missing day
            for h in range(24):
                ghi = None if d == 6 else round(rnd.uniform(0, 900), 2)
                t_amb = None if rnd.random() < 0.2 else round(rnd.uniform(10, 40), 2)
                label = None if h < 3 else f"p{d % 3}"
                code = None if h < 5 else d
                rows.append((city, DAY + dt.timedelta(days=d, hours=h), ghi, t_amb, label, code, 5.0))
    rows.append((None, DAY, 1.0, 1.0, "x", 1, 5.0))
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def hours(spark):
    ddl = ("city string, timestamp timestamp_ntz, GHI double, T_amb double, pcm_label string, "
           "season_code int, demand_L_per_hr double")
    return spark.createDataFrame(make_hours(), ddl)


@pytest.fixture(scope="module")
def table(hours):
    out = daily.forecast_columns(daily.daily_rollup(hours))
    return out.toPandas().sort_values(["city", "date"]).reset_index(drop=True)


def sql_daily():
    """The same table by SQL in another engine."""
    rows = pd.DataFrame(make_hours(), columns=["city", "ts", "GHI", "T_amb", "label", "code", "litres"])
    con = duckdb.connect()
    con.register("hours", rows)
    return con.execute("""
        WITH days AS (
          SELECT city, ts::DATE AS date, avg("GHI") AS "GHI_mean", max("GHI") AS "GHI_max", avg("T_amb") AS "T_amb_mean",
            min("T_amb") AS "T_amb_min", arg_min(label, ts) FILTER (label IS NOT NULL) AS label,
            (arg_min(code, ts) FILTER (code IS NOT NULL))::INTEGER AS code, sum(litres) AS litres, coalesce(sum("GHI"), 0) AS "GHI_sum"
          FROM hours WHERE city IS NOT NULL GROUP BY ALL)
        SELECT *, lag("GHI_mean", 1) OVER w AS "GHI_mean_lag1", lag("GHI_mean", 2) OVER w AS "GHI_mean_lag2",
          lag("GHI_mean", 7) OVER w AS "GHI_mean_lag7", lead("GHI_mean") OVER w AS next,
          avg("GHI_mean") OVER (PARTITION BY city ORDER BY date ROWS 6 PRECEDING) AS roll
        FROM days WINDOW w AS (PARTITION BY city ORDER BY date) ORDER BY city, date""").df()


def test_daily_table_equals_sql(table):
    want = sql_daily()
    assert len(table) == len(want) == 22
    pairs = {
        "GHI_mean": "GHI_mean", "GHI_max": "GHI_max", "T_amb_mean": "T_amb_mean",
        "T_amb_min": "T_amb_min", "season_code": "code", "demand_total_L": "litres",
        "GHI_mean_lag1": "GHI_mean_lag1", "GHI_mean_lag2": "GHI_mean_lag2",
        "GHI_mean_lag7": "GHI_mean_lag7", "GHI_mean_roll7": "roll", "GHI_next_day": "next",
    }
    for mine, theirs in pairs.items():
        np.testing.assert_allclose(table[mine].astype(float), want[theirs].astype(float), rtol=1e-12)
    np.testing.assert_allclose(table["GHI_daily_kWh_m2"], want["GHI_sum"] / 1000, rtol=1e-12)
    assert (table["pcm_label"] == want["label"]).all()
    assert "W_spd_mean" not in table.columns


def test_a_day_without_readings_sums_to_zero(table):
    empty = table[(table["city"] == "a") & (table["date"] == dt.date(2021, 5, 7))].iloc[0]
    assert empty["GHI_daily_kWh_m2"] == 0.0 and np.isnan(empty["GHI_mean"])


def test_numeric_rollup_uses_hash_aggregation(hours):
    plan = daily.daily_rollup(hours.drop("pcm_label"))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_forecast_columns_shuffle_once(hours):
    rolled = daily.daily_rollup(hours.drop("pcm_label"))
    plan = daily.forecast_columns(rolled)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # one for the days, one for the windows


def test_result_does_not_depend_on_partitioning(hours, table):
    again = daily.forecast_columns(daily.daily_rollup(hours.repartition(17))).toPandas()
    again = again.sort_values(["city", "date"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(again.round(9), table.round(9))


@pytest.fixture(scope="module")
def climate(spark):
    rows = []
    rnd = random.Random(3)
    for city, t_set, zone in (("a", 45.0, "humid"), ("b", 55.0, "arid"), ("c", 50.0, "cold")):
        for d in range(0, 200, 4):
            for h in (0, 6, 12, 18):
                ts = DAY + dt.timedelta(days=d, hours=h)
                season = "pre-monsoon" if ts.month == 5 else "monsoon" if ts.month < 10 else "post-monsoon"
                rows.append((city, ts, h, ts.month, season, rnd.uniform(0, 900), rnd.uniform(10, 40),
                             float(rnd.randrange(8)), t_set, zone))
    ddl = ("city string, timestamp timestamp_ntz, hour int, month int, season string, GHI double, "
           "T_amb double, RRTDHS double, T_set double, climate_zone string")
    return spark.createDataFrame(rows, ddl)


def test_joining_after_the_rollup_gives_the_same_daily_table(spark, climate):
    materials = spark.createDataFrame(
        [(i, f"m{i}", 40.0 + 4 * i, 0.1 * i, 100.0 + i, i % 2) for i in range(6)],
        "material_id int, product string, Tm_melting double, pcm_suitability_score double, "
        "latent_heat_melting double, is_flammable int",
    )
    labels = fusion.label_map(climate, materials)
    # site c has no label: it gets the label "unknown"
    labels = labels.where(F.col("city") != "c")
    sites = climate.select("city", "climate_zone").distinct()
    late = fusion.daily_from_climate(climate, materials, labels, sites).toPandas()
    early = fusion.daily_features(fusion.fused_hourly(climate, materials, labels)).toPandas()
    assert sorted(late.columns) == sorted(early.columns)
    late = late[sorted(late.columns)].sort_values(["city", "date"]).reset_index(drop=True)
    early = early[sorted(early.columns)].sort_values(["city", "date"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(late, early, check_exact=False, rtol=1e-12)
    assert set(late.loc[late["city"] == "c", "pcm_label"]) == {"unknown"}
    codes = dict(zip(late["pcm_label"], late["pcm_label_code"]))
    assert [codes[x] for x in sorted(codes)] == list(range(len(codes)))


def test_a_product_listed_twice_doubles_the_rows(spark):
    df = spark.createDataFrame([("p",), ("q",), (None,)], "best_pcm_product string")
    materials = spark.createDataFrame([("p", 1.0), ("p", 2.0)], "product string, Tm_melting double")
    assert fuse.join_materials(df, materials).count() == 4


@pytest.mark.parametrize("parts", [1, 3, 5, 16])
def test_first_values_do_not_depend_on_partitioning(spark, parts):
    day = dt.datetime(2021, 5, 1)
    rows = [("a", day, None, "z", 1.0)]
    rows += [("a", day + dt.timedelta(hours=1), 900 - i, f"n{i:03d}", float(i)) for i in range(500)]
    rows += [("a", day + dt.timedelta(hours=2), 1, "a", 0.0)]
    df = spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, month int, season string, GHI double")
    got = daily.daily_rollup(df.repartition(parts)).first()
    assert (got["month"], got["season"]) == (401, "z")
    assert got["GHI_mean"] == pytest.approx((1 + sum(range(500))) / 502)


def test_both_fusion_paths_follow_a_shifted_clock(spark):
    """Hours after 18:30 UTC belong to the next day, month and season of a clock 330 minutes ahead."""
    late = spark.range(48).select(
        F.lit("a").alias("city"), F.expr("timestamp_ntz'2021-05-30 12:00:00' + make_dt_interval(0, cast(id as int))").alias("timestamp"), F.col("id").cast("double").alias("GHI"),
    )
    from sunmelt.functions import calendar as cal
    from sunmelt.plans.climate import time_features

    late = time_features(late.withColumn("local_time", cal.local_time(F.col("timestamp"), 330)), "local_time")
    by_day = daily.daily_rollup(late, ts=fusion.clock_of(late), stats={"GHI": ("mean",)}, firsts=("month", "season"))
    got = {(str(r["date"]), r["month"], r["season"]) for r in by_day.collect()}
    assert {(d, m) for d, m, _ in got} == {("2021-05-30", 5), ("2021-05-31", 5), ("2021-06-01", 6)}
    assert {s for _, _, s in got} == {"pre-monsoon", "monsoon"}


def test_first_of_large_and_near_values_does_not_depend_on_partitions(spark):
    tiny = 5e-324
    groups = {
        "large": [4e9, 2e9, 5e9, 3e9], "near": [1.0 + 2**-52, 1.0, 1.0 + 2**-51], "edge": [2.0, 2.0 - 2**-52, 2.0 + 2**-51],
        "below": [-3e9, -2e300, -1e-300], "small": [2 * tiny, tiny, 1e-310], "signs": [1e-200, -1e-200, 0.0],
        "ends": [float("inf"), 1.7976931348623157e308, 1e308], "least": [float("-inf"), -1.7976931348623157e308],
    }
    rows = [(g, dt.datetime(2021, 1, 1, 5), v) for g, values in groups.items() for v in values * 3]
    rows += [(g, dt.datetime(2021, 1, 1, 6), -9e307) for g in groups]
    df = spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, RRTDHS double")
    whole = df.withColumn("season_code", (F.col("RRTDHS") > 0).cast("int") * F.lit(2**62) + F.lit(1))
    for parts in (1, 2, 5, 16):
        got = daily.daily_rollup(whole.repartition(parts), stats={}, firsts=["RRTDHS", "season_code"]).collect()
        assert {r["city"]: r["RRTDHS"] for r in got} == {g: min(values) for g, values in groups.items()}
        assert {r["city"]: r["season_code"] for r in got} == {g: 2**62 + 1 if min(v) > 0 else 1 for g, v in groups.items()}


def test_doubles_are_ordered_exactly(spark):
    rnd = random.Random(6)
    values = [rnd.choice([-1, 1]) * 2.0 ** rnd.randrange(-1074, 1023) * rnd.uniform(1, 2) for _ in range(2000)]
    values += [v for e in range(-1074, 1024, 7) for p in [2.0**e] for v in (p, np.nextafter(p, 0), np.nextafter(p, np.inf), -p, -np.nextafter(p, np.inf))]
    values = sorted({float(v) for v in values} | {0.0, float("inf"), float("-inf")})
    df = spark.createDataFrame([(v,) for v in values], "x double")
    keys = {r["x"]: r["k"] for r in df.select("x", daily._ordered(F.col("x")).alias("k")).collect()}
    places = [keys[v] for v in values]
    assert all(a < b for a, b in zip(places, places[1:]))
