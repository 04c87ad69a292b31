"""Schema operators, profiles, sources and sinks."""

import os
import random

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sunmelt.operators import columns, filters, grid, profile, sketches
from sunmelt.sources import tables


def test_find_alias_prefers_whole_names():
    names = ["wsp", "sp_flag", "sp", "2m_temperature", "tp"]
    assert columns.find_alias(names, columns.WEATHER_ALIASES["sp"]) == "sp"
    assert columns.find_alias(["surface_pressure_pa"], columns.WEATHER_ALIASES["sp"]) == "surface_pressure_pa"
    assert columns.find_alias(["W_spd", "expver"], columns.WEATHER_ALIASES["sp"]) is None
    assert columns.find_alias(["D2M"], columns.WEATHER_ALIASES["d2m"]) == "D2M"


def test_resolve_alias_keeps_wind_speed(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], ["total_cloud_cover", "W_spd", "tp"])
    assert columns.resolve_alias(df).columns == ["tcc", "W_spd", "tp"]


def test_rename_dedupe_select_drop(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b", "c"])
    same = columns.rename(df, {"b": "a"})
    assert same.columns == ["a", "a", "c"]
    one = columns.dedupe_columns(same)
    assert one.columns == ["a", "c"] and tuple(one.first()) == (1, 3)
    assert columns.select_known(df, ["c", "x", "a", "c"]).columns == ["c", "a"]
    assert columns.drop(df, ["a"], containing=["c"]).columns == ["b"]
    assert columns.present(df, ["z", "b"]) == ["b"]


def test_nan_to_null(spark):
    df = spark.createDataFrame([(float("nan"), "x", 1), (2.0, None, 2)], "a double, b string, c int")
    assert [r["a"] for r in columns.nan_to_null(df).collect()] == [None, 2.0]


def test_classify_columns(spark):
    df = spark.createDataFrame([(1,) * 5], ["GHI_mean", "pcm_label", "month", "GHI_next_day", "other"])
    got = {(r["column_name"], r["column_group"]) for r in columns.classify_columns(df).collect()}
    assert got == {
        ("GHI_mean", "climate"), ("GHI_next_day", "climate"), ("pcm_label", "material"),
        ("month", "time"), ("GHI_next_day", "target"), ("pcm_label", "target"),
    }


def test_filters(spark):
    df = spark.createDataFrame([(35.0, 1.0), (75.0, None), (34.9, 1.0), (None, 1.0)], "t double, l double")
    kept = filters.filter_range(df, "t")
    assert sorted(r["t"] for r in kept.collect()) == [35.0, 75.0]
    assert filters.drop_missing(kept, ["t", "l"]).count() == 1
    filled = filters.fill_when(df, "l", F.col("l").isNull(), F.lit(9.0))
    assert [r["l"] for r in filled.collect()] == [1.0, 9.0, 1.0, 1.0]
    stages = profile.count_stages(df, {"range": F.col("t").between(35, 75), "full": F.col("l").isNotNull()})
    assert {r["stage"]: r["rows"] for r in stages.collect()} == {"input": 4, "range": 2, "full": 1}


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([(2.5, 2)], "d double, i int")
    got = grid.union_tables([a, b])
    assert got.columns == ["i", "s", "d"]
    assert [tuple(r) for r in got.orderBy("i").collect()] == [(1, "x", None), (2, None, 2.5)]


def test_describe_equals_pandas(spark):
    rnd = random.Random(2)
    pdf = pd.DataFrame(
        {
            "a": [rnd.choice([1.0, 1.0, 1.0, rnd.uniform(-5, 5)]) for _ in range(997)],
            "b": [None if rnd.random() < 0.3 else rnd.lognormvariate(0, 3) for _ in range(997)],
            "c": np.arange(997),
        }
    )
    df = columns.nan_to_null(spark.createDataFrame(pdf).repartition(5))
    got = profile.describe(df).toPandas().set_index("column_name")
    want = pdf.describe().T
    for mine, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                         ("max", "max"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%")]:
        np.testing.assert_allclose(got.loc[want.index, mine].astype(float), want[theirs], rtol=1e-9)


@pytest.mark.parametrize("values", [[7.0], [1.0, 2.0], [3.0] * 50, [1.0] * 30 + [2.0] * 30])
def test_quantiles_of_small_and_constant_columns(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    r = profile.quantiles(df, ["x"]).first()
    assert (r["q25"], r["q50"], r["q75"]) == pytest.approx(tuple(np.percentile(values, [25, 50, 75])))


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    got = {r["column_name"]: r["q50"] for r in profile.describe(df).collect()}
    assert got == {"x": None, "y": 1.0}


def test_null_profiles(spark):
    before = spark.createDataFrame([(1.0, None, None), (None, None, "s")], "a double, b double, c string")
    assert {r[0]: r[1] for r in profile.null_profile(before).collect()} == {"a": 1, "b": 2, "c": 1}
    after = before.fillna(0.0, ["b"])
    diff = {r[0]: (r[1], r[2]) for r in profile.missing_diff(before, after).collect()}
    assert diff == {"a": (1, 1), "b": (2, 0), "c": (1, 1)}
    assert profile.null_profile(after.select("b")).count() == 0


def test_read_csv(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text(
        'name,value,when\n"a, b",1.5,2021-03-04 05:06:07\nN/A,x,\nshort,2\nlong,1,2021-01-01,surplus\nné,NaN,2021-02-03\n',
        encoding="utf-8",
    )
    text = tables.read_csv(spark, str(path), ts_cols=["when"])
    assert dict(text.dtypes) == {"name": "string", "value": "string", "when": "timestamp_ntz"}
    rows = {r["name"]: r for r in text.collect()}
    assert set(rows) == {"a, b", None, "short", "né"}
    assert str(rows["a, b"]["when"]) == "2021-03-04 05:06:07" and rows[None]["when"] is None
    assert rows["short"]["when"] is None and rows["né"]["value"] is None
    typed = tables.read_csv(spark, str(path), "value double, name string", ts_cols=["when"])
    got = {r["name"]: r["value"] for r in typed.collect()}
    assert got == {"a, b": 1.5, None: None, "short": 2.0, "né": None}


def test_write_and_read_back(spark, tmp_path):
    df = spark.range(100).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("city"), "id",
        F.when(F.col("id") == 5, None).otherwise(F.col("id") / 2).alias("x"),
    )
    path = str(tmp_path / "out")
    tables.write_table(df, path, partition_by=["city"], sort_by=["id"])
    assert sorted(d for d in os.listdir(path) if d.startswith("city=")) == ["city=cold", "city=hot"]
    assert spark.read.parquet(path).count() == 100
    tables.write_table(df.limit(1), path, if_exists="skip")
    assert spark.read.parquet(path).count() == 100
    tables.write_table(df.limit(7), path)
    assert spark.read.parquet(path).count() == 7
    flat = str(tmp_path / "csv")
    tables.write_table(df, flat, fmt="csv")
    back = tables.read_csv(spark, flat, "city string, id long, x double")
    assert back.count() == 100 and back.where("x is null").count() == 1


def test_read_grid(spark, tmp_path):
    path = str(tmp_path / "grid")
    spark.createDataFrame([("s", float("nan")), ("t", 1.0)], "time string, t2m double").write.parquet(path)
    got = tables.read_grid(spark, path)
    assert got.columns == ["timestamp", "t2m"] and got.where("t2m is null").count() == 1


def test_csv_files_with_other_headers_and_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("city,x,y\nA,1,2\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("city,y,x\nB,4,3\n", encoding="utf-8")
    got = tables.read_csv(spark, str(tmp_path), "city string, x int, y int").collect()
    assert sorted((r["city"], r["x"], r["y"]) for r in got) == [("A", 1, 2), ("B", 3, 4)]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "q.csv").write_text('city,x\n"A\nB",1\nC,2\n', encoding="utf-8")
    got = tables.read_csv(spark, str(tmp_path / "c"), multi_line=True).collect()
    assert sorted((r["city"], r["x"]) for r in got) == [("A\nB", "1"), ("C", "2")]


def test_spatial_mean_averages_every_numeric_type(spark):
    rows = [("s", 1, 1.0, 1.5, 3), ("s", 1, 2.0, 2.5, 4)]
    df = spark.createDataFrame(rows, "site string, timestamp int, latitude double, f float, n int")
    df = df.withColumn("longitude", F.lit(0.0)).withColumn("d", F.col("n").cast("decimal(6,2)"))
    got = grid.spatial_mean(df).first()
    assert (got["f"], got["n"], float(got["d"])) == (2.0, 3.5, 3.5)


def test_quartiles_by_group_and_with_narrow_brackets(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(f"g{i % 3}", rnd.gauss(0, 1) if i % 5 else float("nan"), float(rnd.randrange(4))) for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    for whole in (profile.WHOLE, 0):
        monkeypatch.setattr(profile, "WHOLE", whole)
        got = profile.describe(df, by=["g"]).toPandas().set_index(["g", "column_name"])
        for (g, c), r in got.iterrows():
            want = pdf[pdf["g"] == g][c].dropna()
            assert r["count"] == len(want) and r["mean"] == pytest.approx(want.mean())
            for name, q in profile.QUARTILES.items():
                assert r[name] == pytest.approx(want.quantile(q), abs=1e-12)


def test_quartiles_shuffle_only_bracketed_values(spark):
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("x"))
    got = profile.describe(df).first()
    want = np.quantile(np.arange(1_000_000) * 7919 % 1_000_003, [0.25, 0.5, 0.75])
    assert [got["q25"], got["q50"], got["q75"]] == pytest.approx(list(want))


def test_a_box_meets_few_row_groups(spark, tmp_path):
    from sunmelt.workload.queries import world_grid

    path, cells = str(tmp_path / "curve"), world_grid(spark, "/root/testdata/sf0.1")
    tables.write_grid(cells, path, row_group=32 * 1024)
    north, west, south, east = box = (50.0, -20.0, 10.0, 60.5)  # 5 % of the globe's degrees
    met = total = 0
    for name in os.listdir(path):
        if name.endswith(".parquet"):
            meta = pq.ParquetFile(os.path.join(path, name)).metadata
            place = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
            for g in range(meta.num_row_groups):
                lat, lon = (meta.row_group(g).column(place[c]).statistics for c in ("latitude", "longitude"))
                met += lat.max >= south and lat.min <= north and lon.max >= west and lon.min <= east
                total += 1
    assert total > 100 and met < 0.1 * total
    got = grid.slice_grid(spark.read.parquet(path), box=box)
    assert got.count() == grid.slice_grid(cells, box=box).count() > 20_000


def test_cell_keys_of_the_edges_and_of_both_ways_to_count_longitudes(spark):
    rows = [(-90.0, -180.0), (90.0, 179.99), (0.0, 0.0), (0.0, 350.0), (0.0, -10.0), (None, 1.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, o double").select(tables.cell_key(F.col("a"), F.col("o"))).collect()]
    assert got[0] == 0 and got[1] > 0xF0000000 and got[2] == 0xC0000000 and got[3] == got[4] and got[5] is None


@pytest.mark.parametrize("part", ["years", "months", "days", "hours"])
def test_an_empty_list_keeps_nothing(spark, part):
    df = spark.sql("SELECT timestamp'2021-01-01 00:00:00' AS timestamp")
    assert grid.slice_grid(df, **{part: []}).count() == 0 and grid.slice_grid(df).count() == 1


def test_quartiles_of_the_null_group(spark, monkeypatch):
    rows = [(None if i % 3 == 0 else f"g{i % 3}", None if i % 2 else i % 4, float(i * 7 % 101)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, k int, x double")
    pdf = pd.DataFrame(rows, columns=["g", "k", "x"])
    for small in (profile.SMALL_WINDOW, 0):
        monkeypatch.setattr(profile, "SMALL_WINDOW", small)
        got = {(r["g"], r["k"]): r for r in profile.describe(df, ["x"], by=["g", "k"]).collect()}
        want = {(g, None if k != k else int(k)): part["x"] for (g, k), part in pdf.astype({"k": object}).fillna({"g": "?"}).groupby(["g", "k"], dropna=False)}
        assert len(got) == len(want) == 9
        for (g, k), values in want.items():
            r = got[None if g == "?" else g, k]
            assert r["count"] == len(values) and [r["q25"], r["q50"], r["q75"]] == pytest.approx(list(values.quantile([0.25, 0.5, 0.75])))


def test_sketches_of_days_merge_to_quantiles_of_any_period(spark):
    rnd = random.Random(12)
    rows = [(rnd.choice(["A", None]), f"2021-{rnd.randrange(1, 13):02d}-{rnd.randrange(1, 29):02d}", rnd.lognormvariate(0, 2) if i % 9 else float("nan"), None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "city string, day string, x double, y double").withColumn("timestamp", F.to_timestamp_ntz("day"))
    days = sketches.day_sketches(df, ["x", "y"])
    assert {r["column_name"] for r in days.select("column_name").distinct().collect()} == {"x"}
    summer = days.where("month(date) in (6, 7, 8)")
    got = {r["city"]: r for r in sketches.sketched_quantiles(sketches.merged_sketches(summer, ["city"]), {"q10": 0.1, "q50": 0.5, "q99": 0.99}).collect()}
    assert set(got) == {"A", None}
    for city, r in got.items():
        values = np.array([x for c, d, x, _ in rows if c == city and d[5:7] in ("06", "07", "08") and x == x])
        assert r["count"] == len(values) and r["min"] == values.min() and r["max"] == values.max()
        for name, q in (("q10", 0.1), ("q50", 0.5), ("q99", 0.99)):
            assert abs((values <= r[name]).mean() - q) < 0.01


def test_stages_are_counted_by_the_job_that_writes(spark, tmp_path):
    df = spark.range(100).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("i"))
    filters = {"known": F.col("i").isNotNull(), "large": F.col("i") > 50, "none": F.lit(False)}
    counted, seen = profile.observe_stages(df, filters)
    counted.write.parquet(str(tmp_path / "t"))
    want = {r["stage"]: r["rows"] for r in profile.count_stages(df, filters).collect()}
    assert {r["stage"]: r["rows"] for r in profile.observed_stages(spark, seen).collect()} == want == {"input": 100, "known": 90, "large": 45, "none": 0}
