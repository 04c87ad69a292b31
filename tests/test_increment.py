"""Stored days against the rollup of all hours."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from sunmelt.operators import daily
from sunmelt.plans import increment


@pytest.fixture(scope="module")
def hours(spark):
    rnd, rows = random.Random(9), []
    for day in range(70):
        for h in range(24):
            at = dt.datetime(2021, 12, 1) + dt.timedelta(days=day, hours=h)
            for city in ("A", "b/c", None):
                known = rnd.random() < 0.8
                rows.append((city, at if rnd.random() < 0.97 else None, rnd.choice([1e9, 3e9, 3e9 + 2**-20]) if known else None,
                             rnd.choice(["dry", "wet", None]), rnd.randrange(5) if known else None))
    rows += rows[:200]  # repeated rows count as often as they come
    return spark.createDataFrame(rows, "city string, timestamp timestamp_ntz, GHI double, climate_zone string, RRTDHS int").cache()


def table(df):
    return sorted((tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_new_days_and_late_hours_equal_the_whole_rollup(spark, hours, tmp_path):
    path = str(tmp_path / "days")
    day = F.coalesce(F.to_date("timestamp"), F.lit(dt.date(1970, 1, 1)))
    last, late = day == F.lit(dt.date(2022, 2, 8)), F.hour("timestamp") % 7 == 3
    for part in (~last & ~F.coalesce(late, F.lit(False)), ~last & late, last):
        increment.update_days(hours.where(part), path)
    want = daily.daily_rollup(hours)
    got = increment.stored_days(spark, path, hours)
    assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
    assert table(got) == table(want) and got.count() == 140


def test_a_new_day_touches_only_its_month(spark, hours, tmp_path):
    path = str(tmp_path / "days")
    last = F.to_date("timestamp") == F.lit(dt.date(2022, 2, 8))
    increment.update_days(hours.where(~last), path)
    stamps = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if "/_" not in d.replace("_month", "")}
    before = stamps()
    assert sorted(increment.update_days(hours.where(last), path)) == ["city=A/_month=2022-02", "city=b%2Fc/_month=2022-02"]
    after = stamps()
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if "2022-02" in f} and len(before) > 6
    assert table(increment.stored_days(spark, path, hours)) == table(daily.daily_rollup(hours))


def test_days_may_be_redone(spark, hours, tmp_path):
    path = str(tmp_path / "days")
    increment.update_days(hours, path)
    january = F.month("timestamp") == 1
    increment.update_days(hours.where(january), path, redo=True)
    assert table(increment.stored_days(spark, path, hours)) == table(daily.daily_rollup(hours))
    doubled = hours.where(january & (F.dayofmonth("timestamp") == 5))
    increment.update_days(doubled, path)
    got = {(r["city"], r["date"]): r for r in increment.stored_days(spark, path, hours).collect()}
    once = {(r["city"], r["date"]): r for r in daily.daily_rollup(hours).collect()}
    key = ("A", dt.date(2022, 1, 5))
    assert got[key]["GHI_daily_kWh_m2"] == pytest.approx(2 * once[key]["GHI_daily_kWh_m2"])


def test_no_new_hours_change_nothing(spark, hours, tmp_path):
    path = str(tmp_path / "days")
    increment.update_days(hours, path)
    assert increment.update_days(hours.limit(0), path) == []
    assert increment.stored_days(spark, path, hours).count() == 140
