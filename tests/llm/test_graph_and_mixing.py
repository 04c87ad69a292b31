import random

import numpy as np
import pytest
from edge import documents, empty
from pyspark.sql import functions as F

from sunmelt.llm import graph, mixing


def test_components_equal_union_find(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    links += [(2000, 2000 + i) for i in range(1, 200)]
    parent = {n: n for link in links for n in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {n: find(n) for link in links if link[0] != link[1] for n in link}
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_targets_equal_resharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300, "é": 40}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df, (3, 1, 2), 1.5, 2.0).collect()}
    names = sorted(x for x in sizes if x) + [None]
    weight = {n: (3, 1, 2)[i % 3] for i, n in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:  # share by weight, cap, and share the rest again
        rest = total - sum(2 * sizes[n] for n in capped)
        free = [n for n in names if n not in capped]
        share = {n: rest * weight[n] / sum(weight[m] for m in free) for n in free}
        over = {n for n in free if share[n] > 2 * sizes[n]}
        if not over:
            break
        capped |= over
    want = share | {n: 2 * sizes[n] for n in capped}
    assert got == pytest.approx(want)


def test_mix_meets_targets_and_quotas(spark):
    rnd = random.Random(4)
    rows = [(i, f"s{i % 3}" if i % 7 else "hot", rnd.randrange(0, 400)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    draws, targets = mixing.mix(df, shard_words=20_000, block_words=2_000)
    got, want = draws.toPandas(), targets.toPandas().set_index("source")
    assert got["shard"].notna().all() and got["shard"].nunique() > 8
    taken = got.groupby("source")["words"].sum()
    assert np.allclose(taken, want["target"][taken.index], atol=1)
    per_doc = got.groupby("doc_id").agg(words=("words", "sum"), size=("size", "first"))
    assert (per_doc["words"] <= 2 * per_doc["size"]).all()
    again = mixing.mix(df.repartition(5), shard_words=20_000, block_words=2_000)[0].toPandas()
    key = ["doc_id", "copy"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_splitting_tree_keeps_every_block(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 7), ("c", 0), ("d", 333)], "source string, blocks long").where("blocks > 0")
    got = mixing.split_quotas(quotas, 1 << 9, seed=1).toPandas()
    assert got.groupby("source")["quota"].sum().to_dict() == {"a": 1000, "b": 7, "d": 333}
    by_shard = got.groupby("shard")["quota"].sum().reindex(range(512), fill_value=0)
    assert by_shard.between(1340 // 512 - 4, 1340 // 512 + 6).all()


def test_mix_of_odd_documents(spark):
    docs = documents(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.where("trim(translate(text, '\n\t', '')) = ''").count() == 0
    assert mixing.mixed_documents(empty(spark)).count() == 0
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    assert {r["doc_id"]: r["size"] for r in sized.collect()}[4] == 40_000
