"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmelt.runtime import cut_lineage


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns ``node`` and ``root`` (smallest node reachable) of every node that has a link.

    ``links`` has columns ``a`` and ``b`` of one type; direction, repeats and links of a node
    to itself do not matter. A round links each node's larger neighbours to its smallest one,
    and then its smaller neighbours to their smallest, until nothing changes: about as many
    rounds as the logarithm of the longest path. Minima are aggregated before they are
    shuffled and joined back, so no task holds the neighbours of a node. Each round is
    checkpointed.
    """
    edges = cut_lineage(_tidy(links.select("a", "b").where("a is not null and b is not null and a <> b")))
    mark = _mark(edges)
    for _ in range(max_rounds):
        # Large star: every larger neighbour goes to the smallest of node and neighbours.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: larger end a, smaller end b; all ends of a node go to its smallest.
        down = _tidy(large.where("a <> b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut_lineage(_tidy(small.select("e.a", "e.b").where("a <> b")))
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    """Larger end first, each link once."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
