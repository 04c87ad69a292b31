"""Merkle manifest of a dataset: a hash tree over its rows, a proof for each row, verification.

The rows of a group are leaves in a given order. Every ``arity`` consecutive nodes (the last
run may be shorter, even a single node) become the SHA-256 of their digests, as hex text, until
one is left; the tops of the groups, in order of group, form one more tree of the same kind.

A tree is computed where its nodes lie, by windows: at level k a node stands in the row of its
first leaf, its siblings are the values that a lag or lead by a fixed multiple of arity**k
reaches, masked by the node's slot in its run and by the length of the run, and the row of the
first child hashes the parent. Runs never cross blocks of arity**levels rows, so ``levels``
levels need one shuffle by block, no window sees more than a block, and a group that holds
most rows is as many blocks as its size asks for. The tops of blocks are the nodes of the next
tier; proofs are handed down from tier to tier by joins in which a key has a block's rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunmelt.runtime import attach, cut_lineage, written_table

ARITY = 2
LEVELS = 10  # levels computed by one shuffle


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*values: Column) -> Column:
    """Digest of a row: each value as its UTF-8 bytes, a colon and itself; null as a dash."""
    texts = [v.cast("string") for v in values]
    size = lambda t: F.octet_length(t).cast("string")
    return digest(*[F.coalesce(F.concat(size(t), F.lit(":"), t), F.lit("-")) for t in texts])


def fold(start: Column, proof: Column) -> Column:
    """The top that a proof leads to from ``start``."""
    return F.aggregate(proof, start, lambda h, step: digest(step["left"], h, step["right"]))


def siblings(proof: Column) -> Column:
    """All digests of a proof in one text, from the leaf upwards, each level from left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(rows: DataFrame, order: Sequence[str], group: str = "lang", leaves: str = "leaf", arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """``rows`` with ``subroot``, ``root`` and ``proof``: per level the digests ``left`` and
    ``right`` of the node, in one text each.

    Leaves follow ``order`` (nulls first), then their digest; rows alike in all of that are
    interchangeable and each is a leaf. Groups follow the order of their UTF-8 bytes, the null
    group first. A group of one row has its leaf as subroot, and a single subroot is the root.
    An empty table gives no rows. ``rows`` is read several times and should be a written table;
    its columns must not begin with an underscore. Runs jobs when called.
    """
    kept = rows.columns
    keyed = rows.withColumns({"_group": F.coalesce(F.concat(F.lit("s"), F.col(group)), F.lit("n")), "_h": F.col(leaves)})
    nodes = _placed(keyed, [F.col(c).asc_nulls_first() for c in order], [*kept, "_group", "_h"])
    tiers = _tiers(nodes, arity, levels)
    tops = tiers[-1].where("_at = 0").select("_group", F.col("_up").alias("_h"))
    subroots = _placed(tops.select(F.lit("").alias("_group"), F.col("_group").alias("_name"), "_h"), [F.col("_name")], ["_group", "_name", "_h"])
    above = _tiers(subroots, arity, levels)
    root = above[-1].where("_at = 0").select("_group", F.col("_up").alias("root"))
    # A tier's last join but one has at most a block's rows for a key, the group or the whole.
    whole = attach(above[-1], root, ["_group"], small=True)
    heads = _handed_down(above, whole, arity**levels, ["root"])
    heads = written_table(heads.select(F.col("_name").alias("_group"), F.col("_path").alias("_rest"), F.col("_h").alias("subroot"), "root"))
    last = attach(tiers[-1], heads, ["_group"]).withColumn("_path", F.concat("_path", "_rest")).drop("_rest")
    found = _handed_down(tiers, last, arity**levels, ["subroot", "root"])
    return found.select(*kept, "subroot", "root", F.col("_path").alias("proof"))


def _placed(rows: DataFrame, order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """``_at``, the place of each row in its group, and ``_n``, the rows of the group.

    One range-partitioned sort; a place is what earlier partitions hold of the group and the
    place inside the partition. The last sort key parts rows that are alike otherwise.
    """
    tie = F.monotonically_increasing_id()
    ordered = rows.withColumn("_tie", tie).orderBy("_group", *order, "_h", "_tie").select(*keep)
    placed = written_table(ordered.withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumns({"_part": F.shiftrightunsigned("_id", 33), "_pos": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    runs = placed.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_pos").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        "_group", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy("_group")).alias("_n"),
    )
    both = attach(placed, cut_lineage(runs), ["_group", "_part"])
    return both.withColumn("_at", F.col("_before") + F.col("_pos")).select(*keep, "_at", "_n")


def _tiers(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """Tables of nodes, ``levels`` levels apart, until each group has a single block."""
    width = arity**levels
    largest = nodes.agg(F.max("_n")).first()[0] or 0
    tiers = [written_table(_climbed(nodes, arity, levels))]
    while largest > width:
        largest = -(-largest // width)
        tops = tiers[-1].where(F.col("_at") % width == 0)
        upper = tops.select(
            "_group", F.col("_up").alias("_h"), F.expr(f"_at div {width}").alias("_at"), F.expr(f"(_n + {width - 1}) div {width}").alias("_n")
        )
        tiers.append(written_table(_climbed(upper, arity, levels)))
    return tiers


def _climbed(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """``_path`` of each node through the levels of its block and, in a block's first row,
    ``_up``: the block's top."""
    width = arity**levels
    nodes = nodes.withColumn("_block", F.expr(f"_at div {width}"))
    block = Window.partitionBy("_group", "_block").orderBy("_at")
    at, n, h, nothing = F.col("_at"), F.col("_n"), F.col("_h"), F.lit("")
    given = nodes.columns
    nodes = nodes.withColumn("_up", h)
    steps = []
    for k in range(levels):
        step = arity**k
        up, slot, several = F.col("_up"), F.expr(f"(_at div {step}) % {arity}"), n > step
        offsets = range(1, arity)
        nodes = nodes.withColumns(
            {f"_lag{o}": F.lag(up, o * step).over(block) for o in offsets} | {f"_lead{o}": F.lead(up, o * step).over(block) for o in offsets}
        )
        # A node further right exists if its first leaf does; the run may end before the slot does.
        inside = lambda o: (slot + o < arity) & (at + o * step < n)
        left = F.concat(*[F.when(slot >= o, F.col(f"_lag{o}")).otherwise(nothing) for o in reversed(offsets)])
        right = F.concat(*[F.when(inside(o), F.col(f"_lead{o}")).otherwise(nothing) for o in offsets])
        is_node = several & (at % step == 0)
        parent = F.when(at % (step * arity) == 0, F.when(several, digest(up, right)).otherwise(up))
        nodes = nodes.select(*given, *[f"_step{j}" for j in range(k)], F.when(is_node, F.struct(left.alias("left"), right.alias("right"))).alias(f"_step{k}"), parent.alias("_up"))
        steps.append(f"_step{k}")
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = nodes.withColumns({s: F.last(s, ignorenulls=True).over(so_far) for s in steps})
    return nodes.withColumn("_path", F.filter(F.array(*steps), lambda s: s.isNotNull())).drop(*steps)


def _handed_down(tiers: list[DataFrame], top: DataFrame, width: int, facts: Sequence[str]) -> DataFrame:
    """The lowest tier with whole paths and ``facts``, given the topmost tier with them."""
    for tier in reversed(tiers[:-1]):
        upper = written_table(top.select("_group", F.col("_at").alias("_block"), F.col("_path").alias("_rest"), *facts))
        top = attach(tier, upper, ["_group", "_block"]).withColumn("_path", F.concat("_path", "_rest")).drop("_rest")
    return top
