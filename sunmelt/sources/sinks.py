"""Partitioned tables that are written in parts: sites written once, years replaced.

A part is what lies under the first ``depth`` partition folders. New parts are written to a
folder of their own first. Only when that is complete are they moved into the table, one part
after the other, and each gets a mark in ``_commits``. A job that ends early leaves either
a staged folder without ``_SUCCESS``, which the next writer deletes, or a complete one, whose
moves the next writer finishes. A part without a mark counts as not written. One writer at a
time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunmelt.sources.folders import Folders, folder_values
from sunmelt.sources.tables import write_table

MARKS, STAGED = "_commits", "_staged"


def write_missing(df: DataFrame, path: str, partition_by: Sequence[str], depth: int = 1, fmt: str = "parquet", sort_by: Sequence[str] = ()) -> list[str]:
    """Write the parts of ``df`` that the table does not hold yet; the others stay as they are.

    Rows of parts that are there are filtered out before anything is shuffled. Half-written
    parts (without a mark) are written again. Returns the folders of the parts written.
    """
    recover(df.sparkSession, path)
    keys = list(partition_by[:depth])
    done = committed(df.sparkSession, path, keys)
    same = [F.col(c).cast("string").eqNullSafe(F.col(f"_done_{c}")) for c in keys]
    match = same[0]
    for condition in same[1:]:
        match = match & condition
    there = done.toDF(*[f"_done_{c}" for c in keys])
    return _commit(df.join(there, match, "left_anti"), path, partition_by, depth, fmt, sort_by)


def replace_parts(df: DataFrame, path: str, partition_by: Sequence[str], depth: int | None = None, fmt: str = "parquet", sort_by: Sequence[str] = ()) -> list[str]:
    """Replace the parts that ``df`` has rows of, with all they held; the others stay as they are.

    ``depth`` is the number of partition columns that make a part (all, if not given). ``df``
    may read the table itself: parts are moved after the new ones are complete. Returns the
    folders of the parts written.
    """
    recover(df.sparkSession, path)
    return _commit(df, path, partition_by, len(partition_by) if depth is None else depth, fmt, sort_by)


def committed(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The finished parts as texts of their partition columns ``keys``."""
    marks = Folders(spark).names(f"{path}/{MARKS}")
    values = [folder_values(unquote(m)) for m in marks]
    layout = T.StructType([T.StructField(c, T.StringType()) for c in keys])
    return spark.createDataFrame([tuple(v[c] for c in keys) for v in values if list(v) == list(keys)], layout)


def recover(spark: SparkSession, path: str) -> None:
    """Finish the moves of a complete staged folder, delete the others."""
    folders = Folders(spark)
    for name in folders.names(f"{path}/{STAGED}"):
        staged = f"{path}/{STAGED}/{name}"
        if folders.exists(f"{staged}/_SUCCESS"):
            _move(folders, staged, path, int(name.rpartition("-")[2]))
        folders.delete(staged)


def _commit(df: DataFrame, path: str, partition_by: Sequence[str], depth: int, fmt: str, sort_by: Sequence[str]) -> list[str]:
    if not 0 < depth <= len(partition_by):
        raise ValueError("a part needs at least one partition column")
    folders = Folders(df.sparkSession)
    staged = f"{path}/{STAGED}/{uuid.uuid4().hex}-{depth}"
    write_table(df, staged, fmt, partition_by, sort_by)
    moved = _move(folders, staged, path, depth)
    folders.delete(staged)
    return moved


def _move(folders: Folders, staged: str, path: str, depth: int) -> list[str]:
    parts = [""]
    for _ in range(depth):
        parts = [f"{part}/{name}".lstrip("/") for part in parts for name in folders.names(f"{staged}/{part}" if part else staged) if "=" in name]
    for part in parts:
        mark = f"{path}/{MARKS}/{quote(part, safe='')}"
        folders.delete(mark)
        folders.delete(f"{path}/{part}")
        folders.move(f"{staged}/{part}", f"{path}/{part}")
        folders.touch(mark)
    return parts
