"""Random forests of regression trees, grown by Spark jobs over a table that does not move.

A tree's rows are a bootstrap sample: every row counts as often as a Poisson number made from
its id says, so no sample is written. Nodes with more than ``LOCAL_ROWS`` rows are split level
by level for all trees at once, by sums over at most ``BINS`` bins of each feature, added up
where the rows are. What is left of a tree below that size goes to one task per node and is
finished there with exact thresholds. A table under that size takes one job a forest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOCAL_ROWS = 100_000  # rows of a node that one task finishes
BINS = 32
# Chances that a Poisson number of mean 1 is at most 0, 1, 2, ...
POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1, 12)]))

#: Values of the named columns of a batch, after whatever has to be applied to it first.
Reader = Callable[[pa.RecordBatch], dict[str, np.ndarray]]


@dataclass
class Tree:
    """Nodes; ``feature`` is -1 at leaves, rows up to ``threshold`` go ``left``."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @classmethod
    def leaf(cls, value: float) -> Tree:
        return cls(np.array([-1]), np.zeros(1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([value]))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row of ``x`` (rows by features) comes to."""
        at = np.zeros(len(x), dtype=np.int64)
        inner = np.flatnonzero(self.feature[at] >= 0)
        while len(inner):
            node = at[inner]
            low = x[inner, self.feature[node]] <= self.threshold[node]
            at[inner] = np.where(low, self.left[node], self.right[node])
            inner = inner[self.feature[at[inner]] >= 0]
        return at

    def grafted(self, subtrees: dict[int, Tree]) -> Tree:
        """With leaves replaced by subtrees."""
        parts = [[self.feature.copy(), self.threshold.copy(), self.left.copy(), self.right.copy(), self.value.copy()]]
        size = len(self.feature)
        for node, sub in sorted(subtrees.items()):
            # The subtree's root takes the leaf's place; its other nodes follow at the end.
            moved = lambda child: child + size - 1
            base = parts[0]
            base[0][node], base[1][node], base[4][node] = sub.feature[0], sub.threshold[0], sub.value[0]
            base[2][node], base[3][node] = moved(sub.left[0]), moved(sub.right[0])
            parts.append([sub.feature[1:], sub.threshold[1:], moved(sub.left[1:]), moved(sub.right[1:]), sub.value[1:]])
            size += len(sub.feature) - 1
        return Tree(*(np.concatenate(columns) for columns in zip(*parts)))


def predict(trees: Sequence[Tree], x: np.ndarray) -> np.ndarray:
    """Mean of the trees' values."""
    return np.mean([t.value[t.leaves(x)] for t in trees], axis=0)


def sample_weights(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row (by id) is in the sample of a tree."""
    z = rows.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z = z ^ (z >> np.uint64(31))
    return np.searchsorted(POISSON, (z >> np.uint64(11)).astype(float) / (1 << 53), side="right")


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int) -> Tree:
    """A tree of least squares with exact thresholds, all nodes of a level at a time."""
    mean = np.average(y, weights=w)
    y = y - mean  # keeps squares small
    # Of each feature: rows in its order, and the place of each row's value among the distinct ones.
    orders = [np.argsort(column, kind="stable") for column in x.T]
    columns = [np.ascontiguousarray(column) for column in x.T]
    ranks = []
    for column, order in zip(columns, orders):
        rank = np.empty(len(y), dtype=np.int32)
        rank[order] = np.cumsum(np.r_[0, np.diff(column[order]) > 0])
        ranks.append(rank)
    w = w.astype(float)
    wy = w * y
    floor = 1e-12 * max(float((wy * y).sum()), 1e-300)
    node = np.zeros(len(y), dtype=np.int64)
    feature, threshold, left, right = [-1], [0.0], [0], [0]
    weight, total = [w.sum()], [(w * y).sum()]
    open_, first = np.array([0]), 0
    for _ in range(depth):
        # Best split of each open node: (gain, feature, threshold) by its place in open_.
        place = np.full(len(feature), -1)
        place[open_] = np.arange(len(open_))
        gain, chosen, limit = np.zeros(len(open_)), np.full(len(open_), -1), np.zeros(len(open_))
        half = [np.zeros(len(open_)), np.zeros(len(open_))]
        where = place[node].astype(np.int16 if len(open_) < 1 << 15 else np.int64)  # short numbers are sorted by digits
        sizes = np.bincount(where[where >= 0], minlength=len(open_))
        # Rows are ordered by node, so all features share the nodes' places.
        slots = np.flatnonzero(sizes)
        ends = np.cumsum(sizes[slots])
        starts = ends - sizes[slots]
        spread = np.repeat(np.arange(len(slots)), sizes[slots])
        all_w, all_y = np.array(weight)[open_][slots], np.array(total)[open_][slots]
        flat, all_w, all_y = (all_y**2 / all_w)[spread], all_w[spread], all_y[spread]
        for f, order in enumerate(orders):
            slot = where[order]
            if (slot < 0).any():
                order = order[slot >= 0]
                slot = where[order]
            order = orders[f] = order[np.argsort(slot, kind="stable")]
            rank, ww, yy = ranks[f][order], w[order], wy[order]
            # Only where a value ends a run of equal ones, and not a node, may a cut follow.
            cut = np.flatnonzero(rank[1:] != rank[:-1])
            cut = cut[spread[cut] == spread[cut + 1]]
            if not len(cut):
                continue
            owner = spread[cut]
            sw, sy = np.cumsum(ww), np.cumsum(yy)
            first = starts[owner]
            lw, ly = sw[cut] - (sw[first] - ww[first]), sy[cut] - (sy[first] - yy[first])
            rw, ry = all_w[cut] - lw, all_y[cut] - ly
            better = ly**2 / lw + ry**2 / np.maximum(rw, 1e-9) - flat[cut]
            heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.maximum.reduceat(better, heads)
            at = np.flatnonzero(better == np.repeat(best, np.diff(np.r_[heads, len(owner)])))
            at = at[np.unique(owner[at], return_index=True)[1]]
            s = slots[owner[at]]
            take = better[at] > np.maximum(gain[s], floor)
            at, s = at[take], s[take]
            gain[s], chosen[s] = better[at], f
            low, high = columns[f][order[cut[at]]], columns[f][order[cut[at] + 1]]
            middle = low + (high - low) / 2  # may round to the upper one
            limit[s] = np.where(middle < high, middle, low)
            half[0][s], half[1][s] = lw[at], ly[at]
        split = np.flatnonzero(chosen >= 0)
        if not len(split):
            break
        first = len(feature)
        children = []
        for i in split.tolist():
            n = int(open_[i])
            feature[n], threshold[n], left[n], right[n] = int(chosen[i]), float(limit[i]), len(feature), len(feature) + 1
            for lw, ly in ((half[0][i], half[1][i]), (weight[n] - half[0][i], total[n] - half[1][i])):
                children.append(len(feature))
                for column, start in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (weight, lw), (total, ly)):
                    column.append(start)
        features, limits, lefts = np.array(feature), np.array(threshold), np.array(left)
        moving = np.flatnonzero((features[node] >= 0) & (node < first))
        n = node[moving]
        node[moving] = lefts[n] + (x[moving, features[n]] > limits[n])
        open_ = np.array(children)
    value = mean + np.array(total) / np.maximum(np.array(weight), 1e-9)
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), value)


def bin_edges(table: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, np.ndarray]:
    """Inner edges of ``bins`` bins of each column, from its quantiles. Runs a job."""
    shares = [i / bins for i in range(1, bins)]
    found = table.agg(*[F.percentile_approx(c, shares, 1000).alias(c) for c in columns]).first()
    return {c: np.unique(np.array(found[c] if found[c] is not None else [0.0])) for c in columns}


def fit_forest(
    table: DataFrame, read: Reader, features: Sequence[str], target: str, known: str, edges: dict[str, np.ndarray],
    rows: int, mean: float, trees: int, depth: int, seed: int, local_rows: int | None = None,
) -> list[Tree]:
    """Trees for ``target`` from the rows whose column ``known`` is true.

    ``read`` gives a batch's values, ``known`` and the row ids ``_row`` among them; ``rows`` and
    ``mean`` are the number of known rows and their mean. Trees whose sample is empty are left
    out. Only nodes reach the driver: their number is bounded by ``trees`` and ``depth``.
    """
    features, local_rows = list(features), local_rows or LOCAL_ROWS
    grown = {t: Tree.leaf(mean) for t in range(trees)}
    sizes = {(t, 0): rows for t in range(trees)}  # nodes that may be split, and their rows
    left = dict.fromkeys(sizes, depth)  # levels that may follow below
    while large := {node for node, n in sizes.items() if n > local_rows and left[node]}:
        splits = _best_splits(table, read, features, target, known, edges, grown, large, seed)
        for node in large:
            del sizes[node]
        for t, node, f, edge, low, high, low_mean, high_mean in splits:
            inner = Tree(
                np.array([f, -1, -1]), np.array([edges[features[f]][edge], 0.0, 0.0]), np.array([1, 0, 0]), np.array([2, 0, 0]),
                np.array([0.0, low_mean, high_mean]),
            )
            at = len(grown[t].feature)
            grown[t] = grown[t].grafted({node: inner})
            sizes |= {(t, at): low, (t, at + 1): high}
            left |= {(t, at): left[t, node] - 1, (t, at + 1): left[t, node] - 1}
    small = {node: left[node] for node in sizes if left[node]}
    below = _finished(table, read, features, target, known, grown, small, seed) if small else {}
    for t in range(trees):
        parts = {node: tree for (owner, node), tree in below.items() if owner == t}
        if (t, 0) in small and not parts:
            del grown[t]
        else:
            grown[t] = grown[t].grafted(parts)
    return list(grown.values())


def _known_rows(batch: pa.RecordBatch, read: Reader, features: list[str], target: str, known: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and row ids of the rows with a known target."""
    values = read(batch)
    use = values[known].astype(bool)
    return np.stack([values[f] for f in features], axis=1)[use], values[target][use], values["_row"][use]


def _sampled(x: np.ndarray, ids: np.ndarray, grown: dict[int, Tree], places: dict[int, np.ndarray], seed: int) -> Iterator[tuple]:
    """(tree, rows, places of their nodes, weights) of the sampled rows that lie in open nodes."""
    for t, place in places.items():
        w = sample_weights(ids, t, seed)
        rows = np.flatnonzero(w)
        at = place[grown[t].leaves(x[rows])]
        rows, at = rows[at >= 0], at[at >= 0]
        if len(rows):
            yield t, rows, at, w[rows]


def _places(grown: dict[int, Tree], nodes: Sequence[tuple[int, int]]) -> dict[int, np.ndarray]:
    """Of each tree with open nodes: a node's place among ``nodes``, -1 for others."""
    found: dict[int, np.ndarray] = {}
    for i, (t, node) in enumerate(nodes):
        found.setdefault(t, np.full(len(grown[t].feature), -1))[node] = i
    return found


def _finished(table, read, features, target, known, grown, depths, seed) -> dict[tuple[int, int], Tree]:
    names = [f"x{i}" for i in range(len(features))]
    order = sorted(depths)
    numbers, places = np.array([n for _, n in order], dtype=np.int64), _places(grown, order)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, ids = _known_rows(batch, read, features, target, known)
            for t, rows, at, w in _sampled(x, ids, grown, places, seed):
                columns = [pa.array(np.full(len(rows), t, np.int32)), pa.array(numbers[at]), pa.array(w.astype(np.int32)), pa.array(y[rows]), *[pa.array(c) for c in x[rows].T]]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "node", "w", "y", *names])

    def finish(group: pa.Table) -> pa.Table:
        get = lambda c: group.column(c).to_numpy()
        x, y, w = np.stack([get(c) for c in names], axis=1), get("y"), get("w")
        order = np.lexsort((w, y, *x.T))  # the same tree in whatever order rows arrive
        row = {"tree": int(get("tree")[0]), "node": int(get("node")[0])}
        tree = grow(x[order], y[order], w[order], depths[row["tree"], row["node"]])
        parts = {k: getattr(tree, k).tolist() for k in ("feature", "threshold", "left", "right", "value")}
        return pa.Table.from_pylist([row | {"feature": parts["feature"], "threshold": parts["threshold"], "lower": parts["left"], "upper": parts["right"], "value": parts["value"]}], schema=layout)

    ints, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    layout = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("feature", ints), ("threshold", doubles), ("lower", ints), ("upper", ints), ("value", doubles)])
    dealt = table.mapInArrow(deal, "tree int, node bigint, w int, y double" + "".join(f", {n} double" for n in names))
    found = dealt.groupBy("tree", "node").applyInArrow(
        finish, "tree int, node bigint, feature array<bigint>, threshold array<double>, lower array<bigint>, upper array<bigint>, value array<double>"
    )
    return {(r["tree"], r["node"]): Tree(*(np.array(r[c]) for c in ("feature", "threshold", "lower", "upper", "value"))) for r in found.collect()}


def _best_splits(table, read, features, target, known, edges, grown, large, seed) -> list[tuple]:
    """(tree, node, feature, edge, rows and mean below, rows and mean above) of the large nodes that can be split.

    Below an edge are the bins up to it; sums are of bins, made per task and then per table.
    """
    limits = [edges[f] for f in features]
    order = sorted(large)
    owners, numbers = np.array([t for t, _ in order], dtype=np.int32), np.array([n for _, n in order], dtype=np.int64)
    places = _places(grown, order)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One table of sums a feature for all nodes: their number is bounded by trees and depth.
        sums = [np.zeros((3, len(order) * (len(limit) + 1))) for limit in limits]
        for batch in batches:
            x, y, ids = _known_rows(batch, read, features, target, known)
            bins = [np.searchsorted(limit, column, side="left") for limit, column in zip(limits, x.T)]
            for _, rows, at, w in _sampled(x, ids, grown, places, seed):
                wy = w * y[rows]
                low, high = at.min(), at.max() + 1
                for found, limit, bin_of in zip(sums, limits, bins):
                    size = len(limit) + 1
                    cell = (at - low) * size + bin_of[rows]
                    for total, v in zip(found, (w, wy, wy * y[rows])):
                        total[low * size : high * size] += np.bincount(cell, weights=v, minlength=(high - low) * size)
        for f, (found, limit) in enumerate(zip(sums, limits)):
            at = np.flatnonzero(found[0])
            place, size = at // (len(limit) + 1), len(limit) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(owners[place]), pa.array(numbers[place]), pa.array(np.full(len(at), f, np.int32)), pa.array((at % size).astype(np.int32)), *[pa.array(s[at]) for s in found]],
                names=["tree", "node", "f", "bin", "w", "s", "q"],
            )

    cells = table.mapInArrow(histogram, "tree int, node bigint, f int, bin int, w double, s double, q double")
    cells = cells.groupBy("tree", "node", "f", "bin").agg(F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    whole = Window.partitionBy("tree", "node", "f")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = F.col
    cells = cells.select(
        "tree", "node", "f", "bin", F.sum("w").over(upto).alias("lw"), F.sum("s").over(upto).alias("ls"),
        F.sum("w").over(whole).alias("aw"), F.sum("s").over(whole).alias("as"), F.sum("q").over(whole).alias("aq"),
    ).where(c("lw") < c("aw"))
    gain = c("ls") ** 2 / c("lw") + (c("as") - c("ls")) ** 2 / (c("aw") - c("lw")) - c("as") ** 2 / c("aw")
    best = cells.withColumn("gain", gain).where(c("gain") > F.lit(1e-12) * c("aq")).groupBy("tree", "node").agg(
        F.max(F.struct("gain", -c("f"), -c("bin"), "lw", "ls", "aw", "as")).alias("b")
    )
    return [
        (r["tree"], r["node"], -b[1], -b[2], b[3], b[5] - b[3], b[4] / b[3], (b[6] - b[4]) / (b[5] - b[3]))
        for r in best.collect() for b in [tuple(r["b"])]
    ]
