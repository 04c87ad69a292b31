"""Joins with hot keys, size checks, row numbers, checkpoints."""

import os

import pytest
from pyspark.sql import functions as F

from sunmelt import runtime
from sunmelt.operators import encode


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def fact(spark):
    # key 7 holds a third of the rows, and some rows have no key
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 400)
    return spark.range(6000).select("id", key.cast("int").alias("k"))


@pytest.fixture(scope="module")
def dim(spark):
    once = spark.range(300).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    twice = spark.range(7, 9).select(F.col("id").cast("int").alias("k"), (F.col("id") * 3).alias("v"))
    return once.unionByName(twice)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_attach_gives_the_plain_join_with_and_without_broadcast(fact, dim, how):
    want = rows(fact.join(dim, ["k"], how))
    assert rows(runtime.attach(fact, dim, ["k"], how)) == want
    assert rows(runtime.attach(fact, dim, ["k"], how, max_rows=10)) == want
    assert rows(runtime.attach(fact, dim, ["k"], how, spread_by=["id"], max_rows=10)) == want


def test_attach_spreads_keys_by_their_rows(spark, fact, dim):
    want = rows(fact.join(dim, ["k"], "left"))
    joined = runtime.attach(fact, dim, ["k"], spread_by=["id"], small=False, rows_per_task=300)
    assert "_salt" in joined._jdf.queryExecution().optimizedPlan().toString()
    assert rows(joined) == want
    hot = {r["k"]: r["_salts"] for r in runtime.hot_keys(fact, ["k"], rows_per_task=300).collect()}
    assert set(hot) == {7} and 4 <= hot[7] <= 10


def test_attach_with_one_key_of_most_rows_and_several_small_ones(spark):
    key = F.when(F.col("id") % 10 < 6, 0).otherwise(F.col("id") % 110)
    fact = spark.range(20000).select("id", key.alias("k"))
    dim = spark.range(120).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    for how in ("left", "inner"):
        spread = runtime.attach(fact, dim, ["k"], how, small=False, rows_per_task=100)
        assert rows(spread) == rows(fact.join(dim, ["k"], how))


@pytest.mark.parametrize("how", ["right", "full", "left_anti"])
def test_attach_refuses_other_joins(fact, dim, how):
    with pytest.raises(ValueError):
        runtime.attach(fact, dim, ["k"], how)


def test_size_check_moves_no_rows(spark):
    seen = []
    df = spark.range(1000).select(F.col("id"), F.lit("x").alias("s"))
    agg = df.agg(F.count(F.lit(1)), F.sum(F.octet_length("s")))
    seen.append(agg._jdf.queryExecution().executedPlan().toString())
    assert "Limit" not in seen[0] and runtime.fits_broadcast(df)


def test_hot_keys_are_few_by_construction(spark, monkeypatch):
    monkeypatch.setattr(runtime, "MAX_HOT_KEYS", 20)
    table = spark.range(100000).select((F.col("id") % 1000).alias("k"))
    assert runtime.hot_keys(table, ["k"], rows_per_task=1).count() <= 20


def test_fits_broadcast_counts_rows_and_bytes(spark):
    df = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("s"), F.array(F.col("id")).alias("a"))
    assert runtime.fits_broadcast(df)
    assert not runtime.fits_broadcast(df, max_rows=99)
    assert not runtime.fits_broadcast(df, max_bytes=50_000)


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x")).repartition(7)
    got = {r["x"]: r["n"] for r in runtime.number_rows(df, ["x"], "n", start=1).collect()}
    assert got == {x: x + 1 for x in range(1000)}


def test_label_dictionary_small_and_large_agree(spark, monkeypatch):
    df = spark.createDataFrame(
        [(s,) for s in ["b", "a", "é", "Z", None, "a", "aa"] * 3], "s string"
    )
    small = rows(encode.label_dictionary(df, "s", "code"))
    monkeypatch.setattr(encode, "SMALL_DICTIONARY", 1)
    large = rows(encode.label_dictionary(df, "s", "code"))
    assert small == large
    assert [v for _, v in sorted(small)] == sorted(["b", "a", "é", "Z", "Unknown", "aa"])


def test_label_encode_fills_missing(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "i int, s string")
    got = {r["i"]: (r["s"], r["code"]) for r in encode.label_encode(df, "s", "code").collect()}
    assert got == {1: ("b", 2), 2: ("Unknown", 0), 3: ("a", 1)}


def test_checkpoints_go_to_the_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert configured in runtime.checkpoint_dir(spark)
    table = runtime.written_table(spark.range(5))
    assert configured in table.inputFiles()[0] and table.count() == 5


def test_written_tables_can_be_deleted(spark):
    table = runtime.written_table(spark.range(5))
    folder = table.inputFiles()[0].rpartition("/")[0].removeprefix("file:")
    assert os.path.isdir(folder)
    runtime.delete_table(table)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("pick, step", [(F.min, 1), (F.max, -1)])
def test_running_value_small_and_spread_agree(spark, pick, step):
    # group 1 holds most rows; values repeat and some are missing
    df = spark.range(3000).select(
        F.when(F.col("id") % 5 == 0, F.col("id") % 7).otherwise(1).alias("g"),
        (F.col("id") * 37 % 3001).alias("x"),
        F.when(F.col("id") % 4 != 0, F.col("id") * 91 % 1009).alias("v"),
    )
    order = [F.col("x").asc() if step > 0 else F.col("x").desc()]
    small = runtime.running(df, ["g"], order, F.col("v"), pick, "r")
    spread = runtime.running(df, ["g"], order, F.col("v"), pick, "r", small=False)
    assert rows(small) == rows(spread)
    assert spread.count() == 3000


@pytest.mark.parametrize("limit", [encode.SMALL_DICTIONARY, 0])
def test_codes_of_several_columns_equal_those_of_each(spark, monkeypatch, limit):
    df = spark.createDataFrame([("b", None), ("a", "x"), (None, "y"), ("b", "x"), ("é", "Z")], "p string, q string")
    one = encode.label_encode(encode.label_encode(df, "p", "p_code"), "q", "q_code")
    monkeypatch.setattr(encode, "SMALL_DICTIONARY", limit)
    both = encode.label_encode_all(df, {"p": "p_code", "q": "q_code"})
    assert dict(both.dtypes) == dict(one.dtypes)
    assert sorted(map(tuple, both.select(one.columns).collect())) == sorted(map(tuple, one.collect()))


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext, conf = Context(), {}  # noqa: N815

    Context.getConf = staticmethod(lambda: type("Conf", (), {"contains": staticmethod(lambda key: False)}))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.checkpoint_dir(Session())


def test_costly_rows_are_spread_by_their_number(spark):
    rows = spark.range(45_000).coalesce(1)  # one small file is one task
    spread = runtime.spread_rows(rows)
    assert spread.rdd.getNumPartitions() == 3
    assert spread.agg(F.count(F.lit(1)), F.sum("id")).first() == (45_000, 45_000 * 44_999 // 2)
    assert runtime.spread_rows(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 1
