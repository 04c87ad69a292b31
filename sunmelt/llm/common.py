"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whole texts that an executor and a Python worker hold at once; Spark's 10,000 take tens of MB on both sides.
TEXTS = 1_000
#: Words are runs of anything but the ASCII blank and the ASCII controls tab to return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def short_batches(spark: SparkSession, rows: int = TEXTS) -> Iterator[None]:
    """Let jobs that run inside hand ``rows`` rows at most to a Python worker at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fold(doc_id: Column | str, folds: int) -> Column:
    """Fold of a row: the unsigned CRC-32 of its id as text, modulo ``folds`` (null id: null)."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), folds)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def int_lists(chunks: list[bytes]) -> pa.ListArray:
    """An Arrow list<int32> column from one little-endian 32-bit buffer per row."""
    offsets = np.zeros(len(chunks) + 1, dtype=np.int64)
    np.cumsum([len(c) // 4 for c in chunks], out=offsets[1:])
    values = pa.array(np.frombuffer(b"".join(chunks), dtype="<i4"), type=pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Slices of ``batch`` whose ``column`` has at most about ``limit`` bytes (one row at least).

    Arrow batches are bounded by rows, not bytes; very long texts would otherwise make the
    arrays that are built from a batch as long as they like.
    """
    sizes = batch.column(column)
    lengths = np.fromiter((0 if v is None else v for v in _lengths(sizes)), dtype=np.int64, count=len(sizes))
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _lengths(column: pa.Array) -> list:
    import pyarrow.compute as pc

    measure = pc.list_value_length if pa.types.is_list(column.type) else pc.binary_length
    return measure(column).to_pylist()
