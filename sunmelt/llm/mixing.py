"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is dealt into blocks of about ``block_words`` words by a hash of the row, and
the blocks are drawn in a pseudo-random order, all of them once more for every further
epoch, until the source has given its target. How many of the drawn blocks of each source
go to which output shard is decided by a splitting tree: the exact block counts of a node
are split between its two children by a multivariate hypergeometric draw, down to the
shards. A shard then takes its share as a run of each source's drawn blocks, so that the
runs are disjoint, and is shuffled inside by a seeded hash.

Nothing holds a source's rows in one task: sizes are aggregated, blocks have a bounded
number of words, and only the rows of the block at which a source meets its target are put
in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunmelt.llm.common import WORD
from sunmelt.runtime import attach, cut_lineage, number_rows, written_table

BLOCK_WORDS = 16_384
SUPER_BLOCK = 1_024  # blocks whose words are summed up before a running sum over a source
LEVELS_A_TASK = 8  # levels of the splitting tree that one task works off
EPS = 1e-9


def word_count(text: Column) -> Column:
    """Number of words; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, max_repeat: float
) -> DataFrame:
    """Words wanted of each source: columns source, source_size, weight, target.

    Sources are numbered by code point (null last) and take ``weights`` in turn. Together
    they are to give ``share`` of all words, each at most ``max_repeat`` times its own; what
    is above goes to the others by weight. With ``L`` words a unit of weight, a source gives
    min(weight * L, max_repeat * size); ``L`` is found by rounds that each see only sums.
    """
    numbered = number_rows(sizes, [F.col("source").asc_nulls_last()], "_no")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = cut_lineage(
        numbered.withColumn("weight", F.element_at(cycle, (F.col("_no") % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
        .drop("_no")
    )
    level, capped = -1.0, 0
    while True:
        full = F.col("_cap") <= F.col("weight") * F.lit(level)
        row = table.agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)).alias("given"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(full, 1)).alias("capped"),
        ).first()
        if not row["open"] or (level >= 0 and row["capped"] == capped):
            break
        level, capped = ((row["all"] or 0) * share - row["given"]) / row["open"], row["capped"]
    if not row["open"]:
        level = float("inf")
    target = F.when(F.col("_cap") <= F.col("weight") * F.lit(level), F.col("_cap")).otherwise(
        F.col("weight") * F.lit(level)
    )
    return table.withColumn("target", target).drop("_cap")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Blocks of each source for each of ``shards`` shards: columns source, shard, quota.

    ``quotas`` has one row per source with its number of drawn blocks. A task splits the
    counts of its node over up to ``2**LEVELS_A_TASK`` descendants, which the next round's
    tasks split further. Zero quotas are left out, so there are never more rows than blocks.
    """
    depth = max(0, math.ceil(math.log2(max(1, shards))))
    nodes = quotas.select("source", F.lit(0).cast("long").alias("node"), F.col("blocks").alias("quota"))
    for level in range(0, depth, LEVELS_A_TASK):
        split = _splitter(level, min(LEVELS_A_TASK, depth - level), seed)
        nodes = nodes.groupBy("node").applyInPandas(split, "source string, node long, quota long")
    return nodes.select("source", F.col("node").alias("shard"), "quota")


def _splitter(level: int, steps: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Splits one node of the tree into its descendants ``steps`` levels below."""

    def split(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("source", na_position="last", kind="stable")
        names, node = frame["source"].to_numpy(dtype=object), int(frame["node"].iloc[0])
        found = [(node, frame["quota"].to_numpy(dtype=np.int64))]
        for step in range(steps):
            below = []
            for at, counts in found:
                rng = np.random.default_rng([seed, level + step, at])
                total = int(counts.sum())
                # An odd block goes to either side by a fair coin, so that no shard is favoured.
                half = total // 2 + (int(rng.integers(2)) if total % 2 else 0)
                left = rng.multivariate_hypergeometric(counts, half, method="marginals")
                below += [(2 * at, left), (2 * at + 1, counts - left)]
            found = below
        return pd.concat(
            [pd.DataFrame({"source": names[c > 0], "node": at, "quota": c[c > 0]}) for at, c in found]
        )

    return split


def mix(
    sized: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_repeat: float = 2.0,
    shard_words: int = 4_194_304,
    block_words: int = BLOCK_WORDS,
    cut: bool = True,
    seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """Draw a mix from ``sized`` (doc_id, source, size); further columns are ignored.

    Returns ``(draws, targets)``. A row of ``draws`` is one use of a document: doc_id,
    source, size, copy (0, 1, ...), words, shard, place. Ordering a shard by ``place`` gives
    its shuffled order. With ``cut`` the last document drawn of a source gives only its first
    ``words`` words, so that the source meets its target to the word; otherwise documents are
    used whole, and a source misses its target by less than its last document. ``targets``
    has source, source_size, weight, target, blocks.

    Null sources are one source, last in order. Null sizes count as 0. Documents without
    words are in no draw. Rows that repeat a doc_id are told apart by nothing, so they are
    used side by side. Equal seeds give equal draws; an empty table gives none.
    """
    base = sized.select(
        "doc_id", "source", F.greatest(F.coalesce(F.col("size").cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("size")
    )
    targets = source_targets(
        base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeat
    )
    targets = cut_lineage(
        targets.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + EPS)).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    )
    keyed = base.where("size > 0").withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    # The hash is uniform, so counting blocks from 0 up is a random permutation of the rows' blocks.
    dealt = (
        attach(keyed, targets.select("_key", "blocks", "epochs", "rest"), ["_key"], "inner")
        .withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
        .withColumn("group", F.expr(f"block div {SUPER_BLOCK}"))
    )
    edge = _edge_block(dealt)
    marked = attach(dealt, edge, ["_key"], "left")
    inside = Window.partitionBy("_key", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size")
    on_edge = (
        marked.where(F.col("block") == F.col("edge"))
        .withColumn("_before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_left", F.col("wanted") - F.coalesce(F.col("_before"), F.lit(0)))
    )
    partly = F.least(F.col("size"), F.greatest(F.lit(0), F.round("_left"))).cast("long")
    if not cut:  # used if that comes nearer to the target than leaving it out
        partly = F.when(F.col("_left") * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0)).cast("long")
    extra = (
        on_edge.withColumn("_extra", partly).drop("_before", "_left")
        .unionByName(
            marked.where("edge is null or block <> edge").withColumn(
                "_extra", F.when(F.col("block") < F.col("edge"), F.col("size")).otherwise(0).cast("long")
            )
        )
    )
    copies = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("epochs")),
        lambda e: F.struct(e.alias("copy"), F.when(e < F.col("epochs"), F.col("size")).otherwise(F.col("_extra")).alias("words")),
    )
    draws = (
        extra.withColumn("_use", F.explode(copies)).where("_use.words > 0")
        .select("_key", "doc_id", "source", "size", "blocks", F.col("_use.copy").alias("copy"), F.col("_use.words").alias("words"), "block")
        .withColumn("draw", F.col("copy") * F.col("blocks") + F.col("block"))
    )
    return _deal(draws, targets, edge, shard_words, seed), targets.drop("_key", "epochs", "rest")


def _edge_block(dealt: DataFrame) -> DataFrame:
    """For each source: the block in which its unfinished epoch ends (edge) and the words
    wanted of that block. Running sums go over groups of blocks, then over one group."""
    words = written_table(
        dealt.groupBy("_key", "group", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    )
    groups = words.groupBy("_key", "group").agg(F.sum("words").alias("words"), F.first("rest").alias("rest"))
    up_to = Window.partitionBy("_key").orderBy("group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = (
        groups.withColumn("_sum", F.sum("words").over(up_to))
        .where(F.col("_sum") + EPS >= F.col("rest"))
        .groupBy("_key").agg(F.min_by(F.struct("group", (F.col("_sum") - F.col("words")).alias("before")), "group").alias("_g"))
        .select("_key", "_g.group", "_g.before")
    )
    within = Window.partitionBy("_key").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        attach(words, reached, ["_key", "group"], "inner")
        .withColumn("_sum", F.col("before") + F.sum("words").over(within))
        .where(F.col("_sum") + EPS >= F.col("rest"))
        .groupBy("_key").agg(F.min_by(F.struct("block", (F.col("rest") - F.col("_sum") + F.col("words")).alias("wanted")), "block").alias("_b"))
    )
    return cut_lineage(found.select("_key", F.col("_b.block").alias("edge"), F.col("_b.wanted").alias("wanted")))


def _deal(draws: DataFrame, targets: DataFrame, edge: DataFrame, shard_words: int, seed: int) -> DataFrame:
    """Give every drawn block its shard by the splitting tree, and every row its place."""
    quotas = targets.join(edge, "_key", "left").select(
        F.col("_key").alias("source"),
        (F.col("epochs") * F.col("blocks") + F.coalesce(F.col("edge") + 1, F.lit(0))).alias("blocks"),
    ).where("blocks > 0")
    wanted = targets.agg(F.sum("target")).first()[0] or 0
    shards = 1 << max(0, math.ceil(math.log2(max(1.0, wanted / shard_words))))
    split = split_quotas(quotas, shards, seed)
    order = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    owner = (
        split.withColumn("_start", F.coalesce(F.sum("quota").over(order), F.lit(0)))
        .withColumn("draw", F.explode(F.expr("sequence(_start, _start + quota - 1)")))
        .select(F.col("source").alias("_key"), "draw", "shard")
    )
    return (
        attach(draws, cut_lineage(owner), ["_key", "draw"], "left")
        .withColumn("place", F.xxhash64("doc_id", "copy", F.lit(seed + 2)))
        .select("doc_id", "source", "size", "copy", "words", "shard", "place")
    )


def mixed_documents(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """Documents used whole by the mix, one row per use, with the columns of ``docs``.

    ``docs`` needs doc_id, source and ``text``; rows of one doc_id are used alike.
    """
    sized = written_table(docs.select("doc_id", "source", word_count(F.col(text)).alias("size")))
    draws, _ = mix(sized, cut=False, **options)
    uses = draws.groupBy(F.col("doc_id").alias("_id")).agg(F.max("copy").alias("_copies"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # names that no column can clash with
    renamed = docs.toDF(*names)
    number = F.col(names[docs.columns.index("doc_id")])
    kept = renamed.join(uses, number.eqNullSafe(F.col("_id")))
    return kept.withColumn("_use", F.explode(F.expr("sequence(0, _copies)"))).select(names).toDF(*docs.columns)
