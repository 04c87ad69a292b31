"""Regression trees against a brute-force tree, and the distributed levels against the local ones."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sunmelt.operators import forest, impute


def brute(x, y, w, depth):
    """Values that a tree gives its own rows: the best cut of each node, tried one by one."""
    value = np.average(y, weights=w)
    best = (1e-12, None)
    error = lambda s: (w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum()
    if depth:
        for f in range(x.shape[1]):
            for at in np.unique(x[:, f])[:-1]:
                low = x[:, f] <= at
                gain = error(np.full(len(y), True)) - error(low) - error(~low)
                if gain > best[0] + 1e-9:
                    best = (gain, low)
    if best[1] is None:
        return np.full(len(y), value)
    out = np.zeros(len(y))
    for side in (best[1], ~best[1]):
        out[side] = brute(x[side], y[side], w[side], depth - 1)
    return out


@pytest.mark.parametrize("depth, rows", [(0, 9), (1, 12), (3, 40), (10, 25)])
def test_a_tree_equals_brute_force(depth, rows):
    rnd = np.random.default_rng(rows)
    x, y = rnd.integers(0, 9, (rows, 3)).astype(float), rnd.normal(size=rows) * 100
    w = rnd.integers(1, 4, rows)
    tree = forest.grow(x, y, w, depth)
    np.testing.assert_allclose(tree.value[tree.leaves(x)], brute(x, y, w, depth), rtol=1e-9)


def test_trees_of_constant_and_single_rows():
    for x, y in ((np.ones((5, 2)), np.arange(5.0)), (np.arange(10.0).reshape(5, 2), np.full(5, 3.0)), (np.ones((1, 1)), np.array([7.0]))):
        tree = forest.grow(x, y, np.ones(len(y), np.int64), 10)
        assert tree.feature.tolist() == [-1] and tree.value[0] == pytest.approx(y.mean())


def test_sample_weights_are_poisson_and_do_not_depend_on_order():
    ids = np.arange(200_000)
    w = forest.sample_weights(ids, 3, 42)
    assert w.mean() == pytest.approx(1.0, abs=0.02) and w.var() == pytest.approx(1.0, abs=0.03)
    assert (forest.sample_weights(ids[::-1], 3, 42)[::-1] == w).all()
    assert (forest.sample_weights(ids, 4, 42) != w).any()


def reader():
    def plain(batch):  # defined here, so that workers need not import the tests
        values = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        return values | {"_known": values["_row"] % 10 != 0}

    return plain


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(3000):
        a, b, c = rnd.randrange(12), rnd.randrange(7), rnd.randrange(5)
        rows.append((i, float(a), float(b), float(c), 3.0 * a + (b > 3) * 20.0 - c * (a > 5) + rnd.gauss(0, 0.5)))
    return spark.createDataFrame(rows, "_row long, a double, b double, c double, y double").repartition(6).cache()


@pytest.mark.parametrize("local_rows", [300, 1])
def test_levels_split_by_jobs_equal_the_local_tree(table, local_rows):
    edges = {c: np.arange(12.0) for c in "abc"}  # every value an edge, so both ways know the same cuts
    fit = lambda rows: forest.fit_forest(table, reader(), ["a", "b", "c"], "y", "_known", edges, 2700, 0.0, 3, 4, 11, rows)
    whole, parts = fit(10_000), fit(local_rows)
    x = np.array([[a, b, c] for a in range(12) for b in range(7) for c in range(5)], dtype=float)
    for one, other in zip(whole, parts, strict=True):
        seen = np.isclose(one.value[one.leaves(x)], other.value[other.leaves(x)], rtol=1e-9)
        assert seen.mean() > 0.99  # cuts between values that a node lacks may lie elsewhere


def test_imputation_recovers_a_dependence_and_ignores_partitioning(spark, table):
    holed = table.select("_row", "a", "b", "c", F.when(F.col("_row") % 4 != 1, F.col("y")).alias("z"), "y").coalesce(1).sortWithinPartitions("_row")
    fills = []
    for local_rows in (None, 500):
        out = impute.chained_impute(holed, ["a", "b", "c", "z"], rounds=2, local_rows=local_rows)
        assert out.where("_row % 4 <> 1 and z <> y").count() == 0
        errors = out.where("_row % 4 = 1").select(F.avg(F.abs(F.col("z") - F.col("y"))), F.max(F.abs(F.col("z") - F.col("y")))).first()
        assert errors[0] < 1.0
        fills.append({r["_row"]: r["z"] for r in out.collect()})
    again = impute.chained_impute(holed, ["a", "b", "c", "z"], rounds=2)
    assert {r["_row"]: r["z"] for r in again.collect()} == fills[0]


def test_a_level_without_a_possible_cut_keeps_the_mean(spark):
    df = spark.createDataFrame([(1.0, 5.0 if i % 2 else None) for i in range(40)], "a double, b double")
    out = impute.chained_impute(df, ["a", "b"], rounds=1, local_rows=3)
    assert {r["b"] for r in out.collect()} == {5.0}


def test_histograms_are_one_table_a_task(spark):
    """Sums of bins leave a task once, and not once a batch."""
    rng = np.random.default_rng(3)
    table = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal()), True) for i in range(6_000)], "_row long, a double, y double, known boolean")
    table = table.coalesce(1).localCheckpoint()
    edges = forest.bin_edges(table, ["a"])
    batches, sent = table.toArrow().to_batches(max_chunksize=500), []

    class Table:
        def mapInArrow(self, run, layout):
            sent.extend(run(iter(batches)))
            return spark.createDataFrame(pa.Table.from_batches(sent))

    def read(batch):
        return {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}

    grown = {0: forest.Tree.leaf(0.0), 1: forest.Tree.leaf(0.0)}
    got = forest._best_splits(Table(), read, ["a"], "y", "known", edges, grown, {(0, 0), (1, 0)}, 5)
    assert sum(b.num_rows for b in sent) == 2 * (len(edges["a"]) + 1)
    again = forest._best_splits(table, read, ["a"], "y", "known", edges, grown, {(0, 0), (1, 0)}, 5)
    assert [pytest.approx(s) for s in sorted(got)] == sorted(again)
