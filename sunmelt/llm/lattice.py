"""Embedding near-duplicates by E8 lattice hashing.

A table projects unit vectors at random to two blocks of eight coordinates, and each block is
decoded to the nearest point of the E8 lattice: the pair of points is the vector's cell. A
vector also probes the neighbouring cells it lies closest to. Two vectors meet if one's cell
is among those of the other in any of the tables; what meets is verified by cosine.

Vectors close together are first gathered in balls: whoever lies within half the linking angle
of the smallest vector of its cell is in its ball, so all of a ball's vectors are linked with
each other without looking at pairs. Meeting balls are linked or told apart as a whole where
their radii allow it. Otherwise blocks of their vectors are multiplied inside a task, which
gives counts; pairs of vectors are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmelt.llm.graph import components
from sunmelt.runtime import cut_lineage, written_table

TABLES = 14
SCALE = 1.75
PROBES = 3  # neighbouring points probed in each block
ROUNDS = 3  # tables used to gather balls
BLOCK = 512
SAFE = 1e-7  # no decision by angles this close to the limit


@cache
def _roots() -> np.ndarray:
    """The 240 shortest vectors of the lattice."""
    found = []
    for i in range(8):
        for j in range(i):
            for a in (1.0, -1.0):
                for b in (1.0, -1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    found.append(v)
    for signs in range(256):
        if signs.bit_count() % 2 == 0:
            found.append(np.array([-0.5 if signs >> k & 1 else 0.5 for k in range(8)]))
    return np.array(found)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows of eight coordinates (ties go to the integer points)."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


@cache
def _table(dim: int, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([17, dim, number])
    odd = rng.integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return rng.normal(0, SCALE / np.sqrt(8), (dim, 16)), rng.random(16), odd


def cells(unit: np.ndarray, number: int, probes: int = PROBES) -> np.ndarray:
    """Keys of a table, one row a vector: its own cell first, then the probed ones."""
    project, shift, odd = _table(unit.shape[1], number)
    placed = unit @ project + shift
    parts = []
    for block in range(2):
        x = placed[:, 8 * block : 8 * block + 8]
        home = decode(x)
        steps = _roots()[np.argsort(-((x - home) @ _roots().T), axis=1, kind="stable")[:, :probes]]
        points = np.concatenate([home[:, None], home[:, None] + steps], axis=1)
        parts.append(((2 * points).astype(np.int64).view(np.uint64) * odd[8 * block : 8 * block + 8]).sum(axis=2, dtype=np.uint64))
    a, b = parts
    keys = np.concatenate([a[:, :1] + b[:, :1], a[:, 1:] + b[:, :1], a[:, :1] + b[:, 1:]], axis=1)
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(number * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + np.uint64(unit.shape[1])
    return keys.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _by_dim(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of each length that occurs."""
    lengths = np.asarray(column.value_lengths())
    for dim in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dim)
        yield rows, _matrix(column.take(pa.array(rows)))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors; null where a vector is null, empty, zero or has components without a value."""
    for batch in batches:
        found = []
        for vector in batch.column("vec").to_pylist():
            values = np.array([np.nan if x is None else x for x in vector or []], dtype=np.float64)
            size = np.sqrt((values**2).sum()) if len(values) else 0.0
            if len(values) and np.isfinite(values).all() and size and not np.isfinite(size):
                values, size = values / np.abs(values).max(), 1.0  # squares overflow
                size = np.sqrt((values**2).sum())
            elif len(values) and not size and values.any() and np.isfinite(values).all():
                values = values / np.abs(values).max()  # squares underflow
                size = np.sqrt((values**2).sum())
            found.append(values / size if len(values) and np.isfinite(values).all() and size else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("row"), pa.array(found, pa.list_(pa.float64()))], names=["vec_id", "row", "unit"])


def _own_cell(number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, unit in _by_dim(batch.column("unit")):
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells(unit, number, 1)[:, 0])], names=[*part.schema.names, "cell"])

    return run


def _gather(loose: DataFrame, number: int, half: float) -> DataFrame:
    """Rows with the ball they are in: that of their cell's smallest row, or their own."""
    placed = written_table(loose.select("row", "unit").mapInArrow(_own_cell(number), "row long, unit array<double>, cell long"))
    centres = placed.groupBy("cell").agg(F.min_by("unit", "row").alias("centre"), F.min("row").alias("ball"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = placed.join(centres, "cell", "left")
    dot = F.aggregate(F.zip_with("unit", "centre", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))
    inside = F.col("centre").isNotNull() & ((angle <= half - SAFE) | (F.col("row") == F.col("ball")))
    return joined.select(
        "row", "unit", F.when(inside, F.col("ball")).alias("ball"), F.when(inside & (F.col("row") != F.col("ball")), angle).otherwise(F.lit(0.0)).alias("far")
    )


def _all_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, unit in _by_dim(batch.column("unit")):
            balls = batch.column("ball").to_numpy(zero_copy_only=False)[rows]
            for i in range(0, len(rows), 1024):
                for number in range(TABLES):
                    keys = cells(unit[i : i + 1024], number)
                    home = np.zeros(keys.shape, dtype=bool)
                    home[:, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(balls[i : i + 1024], keys.shape[1])), pa.array(keys.ravel()), pa.array(home.ravel())], names=["ball", "cell", "home"]
                    )


def _multiply(least: float):
    """Links between two blocks of vectors: for each vector of either the number it has in the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (np.asarray(batch.column(c)[i].values.flatten(), dtype=np.float64) for c in ("units_a", "units_b"))
                ra, rb = (np.asarray(batch.column(c)[i].values) for c in ("rows_a", "rows_b"))
                linked = a.reshape(len(ra), -1) @ b.reshape(len(rb), -1).T >= least
                rows, counts = np.r_[ra, rb], np.r_[linked.sum(axis=1), linked.sum(axis=0)]
                has = counts > 0
                n = int(has.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[has]), pa.array(counts[has].astype(np.int64)), *(pa.array(np.full(n, batch.column(c)[i].as_py(), dtype=np.int64)) for c in ("a", "b"))],
                    names=["row", "links", "a", "b"],
                )

    return run


def near_duplicates(table: DataFrame, vector: str = "embedding", key: str = "vec_id", least: float = 0.9) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row; other columns are dropped.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with
    nothing; vectors of different lengths never link. Repeated rows are vectors of their own.
    A null vec_id takes part like others, but names no component.
    """
    numbered = written_table(table.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"), F.monotonically_increasing_id().alias("row")))
    kind = table.schema[key].dataType.simpleString()
    units = written_table(numbered.mapInArrow(_units, f"vec_id {kind}, row long, unit array<double>"))
    limit = float(np.arccos(least))
    loose, parts = units.where("unit is not null").select("row", "unit"), []
    for number in range(ROUNDS):
        gathered = written_table(_gather(loose, number, limit / 2))
        parts.append(gathered.where("ball is not null"))
        loose = gathered.where("ball is null").select("row", "unit")
    parts.append(loose.select("row", "unit", F.col("row").alias("ball"), F.lit(0.0).alias("far")))
    members = parts[0]
    for part in parts[1:]:
        members = members.unionByName(part)
    members = written_table(members.join(units.select("row", "vec_id"), "row"))
    balls = cut_lineage(members.groupBy("ball").agg(F.count(F.lit(1)).alias("size"), F.max("far").alias("radius"), F.min("vec_id").alias("first"), F.min_by("unit", F.col("row") != F.col("ball")).alias("centre")))

    keys = members.select("ball", "unit").mapInArrow(_all_cells, "ball long, cell long, home boolean")
    keys = written_table(keys.groupBy("cell", "ball").agg(F.max("home").alias("home")))
    shared = keys.join(keys.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("any")).where("n > 1 and any").select("cell"), "cell")
    left, right = (shared.select("cell", F.col("ball").alias(c), F.col("home").alias(f"home_{c}")) for c in ("a", "b"))
    pairs = left.join(right, "cell").where("a < b and (home_a or home_b)").select("a", "b").distinct()
    sides = [balls.select(F.col("ball").alias(c), F.col("size").alias(f"size_{c}"), F.col("radius").alias(f"radius_{c}"), F.col("centre").alias(f"centre_{c}")) for c in ("a", "b")]
    dot = F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot)))
    reach = F.col("radius_a") + F.col("radius_b")
    judged = written_table(
        pairs.join(sides[0], "a").join(sides[1], "b")
        .select("a", "b", "size_a", "size_b", (angle + reach <= limit - SAFE).alias("all"), (angle - reach > limit + SAFE).alias("none"))
        .where("not none")
    )
    asked = judged.where("not all").select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    sizes = members.join(asked, "ball").join(balls.select("ball", "size"), "ball").withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / BLOCK)))
    blocks = cut_lineage(sizes.groupBy("ball", "block").agg(F.collect_list("row").alias("rows"), F.collect_list("unit").alias("units")))
    ends = [blocks.select(F.col("ball").alias(c), F.col("rows").alias(f"rows_{c}"), F.col("units").alias(f"units_{c}")) for c in ("a", "b")]
    met = written_table(
        judged.where("not all").select("a", "b").join(ends[0], "a").join(ends[1], "b").mapInArrow(_multiply(least), "row long, links long, a long, b long")
    )
    whole = judged.where("all")
    by_ball = whole.select(F.col("a").alias("ball"), F.col("size_b").alias("n")).unionByName(whole.select(F.col("b").alias("ball"), F.col("size_a").alias("n"))).groupBy("ball").agg(F.sum("n").alias("of_ball"))
    by_row = met.groupBy("row").agg(F.sum("links").alias("of_row"))
    found = components(whole.select("a", "b").unionByName(met.select("a", "b").distinct())).withColumnRenamed("node", "ball")
    rooted = cut_lineage(balls.join(found, "ball", "left").join(by_ball, "ball", "left").select("ball", "size", "first", F.coalesce("root", "ball").alias("root"), F.coalesce("of_ball", F.lit(0)).alias("of_ball")))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("ball", "size", "of_ball", "component_id")
    facts = members.select("row", "ball").join(named, "ball").join(by_row, "row", "left").select(
        "row", (F.col("size") - 1 + F.col("of_ball") + F.coalesce("of_row", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("known")
    )
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return units.select("vec_id", "row").join(facts, "row", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
