"""Sinks that are written in parts, and CSV read back from folders."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from sunmelt.sources import sinks, tables
from sunmelt.sources.folders import Folders, folder_values

FOLDERS = ["city", "year"]


def rows(spark, cities, value, years=(2020, 2021)):
    data = [(c, y, i, float(value)) for c in cities for y in years for i in range(3)]
    return spark.createDataFrame(data, "city string, year int, i int, v double")


def held(spark, path, fmt="parquet"):
    df = spark.read.option("header", True).schema("i int, v double, city string, year int").format(fmt).load(path)
    return sorted((r["city"] or "", r["year"], r["i"], r["v"]) for r in df.collect())


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if "/_" not in d}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_new_city_is_written_and_old_ones_stay(spark, tmp_path, fmt):
    path = str(tmp_path / "t")
    odd = ["A b/c", "é", None]
    assert len(sinks.write_missing(rows(spark, odd, 1), path, FOLDERS, fmt=fmt)) == 3
    before = files(path)
    assert sinks.write_missing(rows(spark, [*odd, "new"], 2), path, FOLDERS, fmt=fmt) == ["city=new"]
    assert {f: t for f, t in files(path).items() if "city=new" not in f} == {f: t for f, t in before.items()}
    want = rows(spark, odd, 1).unionByName(rows(spark, ["new"], 2))
    assert held(spark, path, fmt) == sorted((r["city"] or "", r["year"], r["i"], r["v"]) for r in want.collect())
    assert sinks.write_missing(rows(spark, odd, 3), path, FOLDERS, fmt=fmt) == []


def test_a_half_written_city_is_written_again(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_missing(rows(spark, ["A"], 1), path, FOLDERS)
    tables.write_table(rows(spark, ["B"], 9, [2020, 1999]).drop("city"), f"{path}/city=B", partition_by=["year"])
    assert sinks.write_missing(rows(spark, ["A", "B"], 2), path, FOLDERS) == ["city=B"]
    assert {(c, y, v) for c, y, _, v in held(spark, path)} == {("A", 2020, 1), ("A", 2021, 1), ("B", 2020, 2), ("B", 2021, 2)}


def test_one_year_is_replaced_and_other_files_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_parts(rows(spark, ["A", "B"], 1), path, FOLDERS)
    before = files(path)
    assert sinks.replace_parts(rows(spark, ["A"], 2, [2021]).limit(1), path, FOLDERS) == ["city=A/year=2021"]
    after = files(path)
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if "city=A/year=2021" in f}
    assert [r for r in held(spark, path) if r[0] == "A" and r[1] == 2021] == [("A", 2021, 0, 2.0)]
    # A whole city: years that it has no longer go too.
    sinks.replace_parts(rows(spark, ["B"], 3, [2022]), path, FOLDERS, depth=1)
    assert {(y, v) for c, y, _, v in held(spark, path) if c == "B"} == {(2022, 3.0)}


def test_a_table_may_be_rebuilt_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_parts(rows(spark, ["A", "B"], 1), path, FOLDERS)
    mine = spark.read.parquet(path).where("city = 'A'").withColumn("v", F.col("v") + 1)
    sinks.replace_parts(mine, path, FOLDERS)
    assert {(c, v) for c, _, _, v in held(spark, path)} == {("A", 2.0), ("B", 1.0)}


def test_an_interrupted_commit_is_finished_and_an_unfinished_one_dropped(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_missing(rows(spark, ["A", "B"], 1), path, FOLDERS)
    # Complete but not moved: A was deleted for its new version, B not yet touched.
    staged = f"{path}/{sinks.STAGED}/x-1"
    tables.write_table(rows(spark, ["A", "B"], 2), staged, partition_by=FOLDERS)
    Folders(spark).delete(f"{path}/city=A")
    Folders(spark).delete(f"{path}/{sinks.MARKS}/city%3DA")
    broken = f"{path}/{sinks.STAGED}/y-1"
    tables.write_table(rows(spark, ["C"], 7), broken, partition_by=FOLDERS)
    os.remove(f"{broken}/_SUCCESS")
    assert sinks.write_missing(rows(spark, ["A", "C"], 3), path, FOLDERS) == ["city=C"]
    assert {(c, v) for c, _, _, v in held(spark, path)} == {("A", 2.0), ("B", 2.0), ("C", 3.0)}
    assert Folders(spark).names(f"{path}/{sinks.STAGED}") == []


def test_nothing_to_write(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.write_missing(rows(spark, ["A"], 1).limit(0), path, FOLDERS) == []
    assert sinks.committed(spark, path, ["city"]).count() == 0
    with pytest.raises(ValueError):
        sinks.replace_parts(rows(spark, ["A"], 1), path, FOLDERS, depth=0)


def test_folder_values():
    assert folder_values("x/city=A%2Fb/year=2020/f") == {"city": "A/b", "year": "2020"}
    assert folder_values("city=__HIVE_DEFAULT_PARTITION__") == {"city": None}


def test_partitioned_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv dir")
    df = spark.createDataFrame(
        [("007", "a,b", 1.5, 2020), ("007", None, None, 2021), ("x/y", "q\"r", 2.0, 2020), (None, "z", 3.0, 2020)],
        "city string, s string, v double, year int",
    )
    tables.write_table(df, path, "csv", ["city", "year"])
    back = tables.read_csv(spark, path, "city string, s string, v double, year int")
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, back.select(*df.columns).collect()), key=key) == sorted(map(tuple, df.collect()), key=key)
    text = tables.read_csv(spark, path)
    assert dict(text.dtypes) == {"s": "string", "v": "string", "city": "string", "year": "string"}
    one = tables.read_csv(spark, f"{path}/city=007/*/*.csv")
    assert one.columns == ["s", "v", "year"] and one.count() == 2


def test_headers_of_compressed_and_empty_files_and_a_folder_column_in_the_file(spark, tmp_path):
    (tmp_path / "city=A").mkdir()
    with gzip.open(tmp_path / "city=A" / "a.csv.gz", "wt", encoding="utf-8") as f:
        f.write("x,city\n1,other\n")
    (tmp_path / "city=A" / "e.csv").write_text("")
    (tmp_path / "city=B").mkdir()
    (tmp_path / "city=B" / "b.csv").write_text("y,x\n2,3\n")
    got = tables.read_csv(spark, str(tmp_path), "city string, x int, y int").collect()
    assert sorted((r["city"], r["x"], r["y"]) for r in got) == [("A", 1, None), ("B", 3, 2)]


def test_reading_headers_runs_no_sort_and_no_scan_of_all_lines(spark, tmp_path):
    tables.write_table(spark.range(1000).withColumn("c", F.col("id") % 2), str(tmp_path / "t"), "csv", ["c"])
    df = tables.read_csv(spark, str(tmp_path / "t"), "id long, c long")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and plan.count("FileScan") == 1
    assert df.agg(F.sum("id"), F.sum("c")).first()[:] == (499500, 500)
