"""The whole job from input tables to output folders."""

import datetime as dt
import math
import os

import golden
import pandas as pd
import pytest

from sunmelt import schema
from sunmelt.plans import outputs


@pytest.fixture(scope="module")
def inputs(spark):
    start = dt.datetime(2021, 12, 30)
    rows = []
    for site, lat, lon in (("Coimbatore", 11.0, 77.0), ("Jaisalmer", 26.9, 70.9)):
        for h in range(24 * 8):
            sun = max(0.0, math.sin((h % 24 - 1) / 12 * math.pi))
            for step in (0.0, 0.25):
                rows.append(
                    (site, start + dt.timedelta(hours=h), lat + step, lon, 298.0 + 6 * sun, 290.0,
                     sun * 3.0e6, sun * 600.0, 1.2e6, 2.0, 1.0, 0.0, 0.2, 98000.0)
                )
    sites = [("Coimbatore", 11.0, 77.0, 411, "hot-humid", 45.0, 10.5, 11.5, 76.5, 77.5),
             ("Jaisalmer", 26.9, 70.9, 225, "hot-arid", 55.0, 26.5, 27.5, 70.5, 71.5)]
    turbidity = [(s[0], m, 3.5) for s in sites for m in range(1, 13)]
    raw = pd.DataFrame(golden.RAW, columns=golden.RAW_COLUMNS).replace({"": None, "N/A": None})
    return (
        spark.createDataFrame(rows, schema.GRID), spark.createDataFrame(sites, schema.SITE_DIM),
        spark.createDataFrame(turbidity, schema.TURBIDITY),
        spark.createDataFrame(raw.astype(object).values.tolist(), ", ".join(f"`{c}` string" for c in raw)),
    )


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_job_writes_every_table(spark, inputs, tmp_path, fmt):
    out = str(tmp_path / "out")
    outputs.build_tables(*inputs, out, fmt)
    assert set(os.listdir(out)) == {
        "climate_hourly", "materials_clean", "label_map", "fused_hourly", "label_classes",
        "daily_features", "daily_columns", "daily_nulls", "materials_summary",
        "heating_index_summary", "materials_missing", "materials_stages",
    }
    read = spark.read.option("header", True).format(fmt)
    fused = read.load(f"{out}/fused_hourly")
    assert fused.count() == 2 * 24 * 8
    assert fused.where("best_pcm_product is null").count() == 0
    daily = read.load(f"{out}/daily_features")
    assert daily.count() == 2 * 8
    assert daily.where("GHI_next_day is null").count() == 2
    assert {"W_spd_mean", "GHI_mean_lag7", "T_amb_mean_roll7", "pcm_label_code", "climate_zone"} <= set(daily.columns)
    assert read.load(f"{out}/label_map").count() == 2  # all days lie in winter
    classes = {r["pcm_label"] for r in read.load(f"{out}/label_classes").collect()}
    assert classes == {r["pcm_label"] for r in daily.select("pcm_label").distinct().collect()}
    assert read.load(f"{out}/materials_clean").count() == 18
    stages = {r["stage"]: int(r["rows"]) for r in read.load(f"{out}/materials_stages").collect()}
    assert stages == {"input": 18, "in_range": 18, "complete": 18}
    assert {r["city"] for r in read.load(f"{out}/heating_index_summary").collect()} == {"Coimbatore", "Jaisalmer"}
    assert set(os.listdir(f"{out}/climate_hourly/city=Jaisalmer")) >= {"year=2021", "year=2022"}


def test_job_slices_a_grid_without_sites(spark, inputs, tmp_path):
    grid, *rest = inputs
    out = str(tmp_path / "out")
    outputs.build_tables(grid.drop("site"), *rest, out, impute_rounds=1, part={"years": [2022], "hours": list(range(0, 24, 2))})
    climate = spark.read.parquet(f"{out}/climate_hourly")
    assert climate.count() == 2 * 12 * 6 and {r["year"] for r in climate.select("year").distinct().collect()} == {2022}


def test_rerun_of_one_year_leaves_the_other_alone(spark, inputs, tmp_path):
    grid, *rest = inputs
    out = str(tmp_path / "out")
    outputs.build_tables(grid, *rest, out, impute_rounds=1, keep_others=True)
    stamps = lambda: {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{out}/climate_hourly") for f in names if "/_" not in d
    }
    before = stamps()
    warmer = grid.withColumn("t2m", grid["t2m"] + 5.0)
    outputs.build_tables(warmer, *rest, out, impute_rounds=1, part={"years": [2022]}, keep_others=True)
    after = stamps()
    assert {f for f in before if "year=2021" in f} == {f for f in before if after.get(f) == before[f]}
    climate = spark.read.parquet(f"{out}/climate_hourly")
    assert climate.count() == 2 * 24 * 8
    means = {r["year"]: r["t"] for r in climate.groupBy("year").agg({"T_amb": "avg"}).withColumnRenamed("avg(T_amb)", "t").collect()}
    assert means[2022] - means[2021] == pytest.approx(5.0, abs=0.5)
    assert spark.read.parquet(f"{out}/daily_features").count() == 2 * 8
