"""Cluster concerns shared by the operators: cutting lineage, size-checked
broadcasts, joins that survive hot keys, and row numbers without a one-task window."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
ROWS_PER_TASK = 1_000_000  # rows of one key that one task of a join may get
MAX_HOT_KEYS = 50_000  # keys that may be told apart as hot, so that they can be broadcast
HOT_SAMPLE = 0.05
SMALL_WINDOW = 50_000  # rows that one window task may hold
COSTLY_ROWS = 20_000  # rows of a task where every row is costly, as in a table of texts to parse
NULL_SALTS = 4_096  # parts over which rows without a key are spread; they match nothing


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` is set by the cluster. Where it is not, the folder lies in the
    warehouse, which all executors share as well. A cluster that names neither has no folder
    that is known to be shared, and is refused: the default warehouse is the driver's own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local") and not sc.getConf().contains("spark.sql.warehouse.dir"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc.getCheckpointDir()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Let a job's checkpoints and written tables go to a folder of its own in the shared
    checkpoint folder, which is deleted at the end."""
    base = checkpoint_dir(spark)
    folder = f"{base}/job-{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(folder)
    try:
        yield
    finally:
        spark.sparkContext.setCheckpointDir(base)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder (survives lost executors)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written_table(df: DataFrame) -> DataFrame:
    """Like :func:`cut_lineage` for big tables: written as Parquet to the same shared folder,
    so later reads take only the columns and rows they need."""
    path = f"{checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_rows(df: DataFrame, rows_per_task: int = COSTLY_ROWS) -> DataFrame:
    """``df`` in as many parts as its number of rows asks for, for work that is costly a row:
    scans are cut by bytes, and a small file of very many short rows is one task. Counts rows."""
    parts = -(-df.count() // rows_per_task)
    return df if parts <= 1 else df.repartition(parts)


def delete_table(table: DataFrame) -> None:
    """Delete the files of a :func:`written_table` that nothing reads any more."""
    spark = table.sparkSession
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> bool:
    """True if ``df`` is proven small: rows and bytes are counted where the rows are, and one
    row a task is added up."""
    width = F.lit(16 * len(df.columns))
    for field in df.schema:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            value = F.to_json(F.struct(value))
        elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
            continue
        width = width + F.coalesce(F.octet_length(value), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def hot_keys(
    df: DataFrame, keys: Sequence[str], rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Keys that seem to hold more than ``rows_per_task`` rows, and ``_salts``: the number of
    parts that brings each under that.

    Judged on a sample, because the answer only decides how a join is spread out and never
    what it returns. In a table so large that more than ``MAX_HOT_KEYS`` keys could be hot,
    the parts grow instead of the list.
    """
    sample = df.select(*keys).where(_all_set(keys)).sample(HOT_SAMPLE, seed=1)
    counts = sample.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(HOT_SAMPLE)).alias("_n"))
    counts = cut_lineage(counts.where(F.col("_n") * F.lit(2) > F.lit(rows_per_task)))
    total = counts.agg(F.sum("_n")).first()[0] or 0.0
    limit = max(float(rows_per_task), total / MAX_HOT_KEYS)
    return counts.where(F.col("_n") > F.lit(limit)).select(
        *keys, F.ceil(F.col("_n") / F.lit(limit)).alias("_salts")
    )


def attach(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread_by: Sequence[str] | None = None,
    max_rows: int = BROADCAST_ROWS,
    small: bool | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi-join (left or inner) of a big table to a smaller one.

    A side proven small is broadcast, so the big table never moves; ``small`` says so where
    the size is known by construction. Otherwise both sides are shuffled, and the rows of a
    hot key are dealt to as many parts as its number of rows asks for, by a hash of
    ``spread_by`` (all other columns if not given); only the dimension rows of those keys are
    copied. Null keys match nothing in both ways. Both sides are read more than once, so a
    costly one should be a written table.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"attach cannot do a {how} join")
    keys = list(keys)
    if small or (small is None and fits_broadcast(dim, max_rows)):
        return fact.join(F.broadcast(dim), keys, how)
    spread_by = list(spread_by or [c for c in fact.columns if c not in keys])
    hot = hot_keys(fact, keys, rows_per_task)  # at most MAX_HOT_KEYS rows
    spread = F.xxhash64(*spread_by)
    salts = F.when(_all_set(keys), F.coalesce("_salts", F.lit(1))).otherwise(F.lit(NULL_SALTS))
    fact = (
        fact.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.pmod(spread, salts))
        .drop("_salts")
    )
    last = F.coalesce("_salts", F.lit(1)) - 1
    dim = (
        dim.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .drop("_salts")
    )
    return fact.join(dim, [*keys, "_salt"], how).drop("_salt")


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str, start: int = 0) -> DataFrame:
    """Add the global position of each row under ``order`` as ``name`` (bigint).

    The sort is range partitioned; a position is the offset of its partition plus the place
    inside it, so no task sees more than its own range. The offsets table has one row per
    sort partition.
    """
    placed = written_table(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftrightunsigned("_id", 33)).withColumn(
        "_pos", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_pos") + F.lit(start))
        .drop("_id", "_part", "_pos", "_offset")
    )


def running(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], value: Column,
    pick: Callable[[Column], Column], name: str, small: bool | None = None,
) -> DataFrame:
    """Add the running ``pick`` (``F.min`` or ``F.max``) of ``value`` within each group.

    A table proven small (by the caller, or counted here) is one window. A larger one is range partitioned by group and
    order, so that even a group holding most rows is spread over tasks: each part runs on
    its own and then takes in what the group's earlier parts found.
    """
    groups = list(groups)
    if fits_broadcast(df, SMALL_WINDOW) if small is None else small:
        w = Window.partitionBy(*groups).orderBy(*order)
        return df.withColumn(name, pick(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = written_table(
        df.repartitionByRange(*groups, *order).withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy(*groups, "_part").orderBy(*order)
    here = parts.withColumn(
        "_here", pick(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    # One row per group and part it reaches into: a group has no more rows than there are parts.
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        parts.groupBy(*groups, "_part")
        .agg(pick(value).alias("_found"))
        .select(*groups, "_part", pick("_found").over(before).alias("_before"))
    )
    joined = attach(here, cut_lineage(found), [*groups, "_part"])
    both = F.array(F.col("_here"), F.col("_before"))
    last = F.array_max if pick is F.max else F.array_min
    return joined.withColumn(name, last(both)).drop("_here", "_before", "_part")


def _all_set(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for key in keys:
        cond = cond & F.col(key).isNotNull()
    return cond
