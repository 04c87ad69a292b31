"""Reading and writing the tables of the pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunmelt.operators.columns import nan_to_null
from sunmelt.sources.folders import Folders, folder_values

# Cell texts that mean "missing".
MISSING_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
_SURPLUS = "_surplus"
ROW_GROUP = 16 * 1024 * 1024  # bytes


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None,
    ts_cols: Sequence[str] = (), encoding: str = "UTF-8", multi_line: bool = False,
) -> DataFrame:
    """Header CSV with missing-value texts as NULL.

    Files may differ in the order and set of their columns: they are read by header and
    united by name. Folders named ``column=value`` below a path give columns too, also over a
    column of that name in the files. Lines with more fields than the header are skipped,
    shorter ones are padded with NULL. Without a schema all columns are text (except
    ``ts_cols``); with one, its columns and ``ts_cols`` are kept and cells that do not parse
    become NULL. ``multi_line`` allows line breaks inside quotes; such files cannot be split.

    To find the headers, every file is opened and its first line read; data lines are read once.
    """
    options = {"header": True, "encoding": encoding, "multiLine": multi_line, "quote": '"', "escape": '"'}
    tables = []
    for root in [path] if isinstance(path, str) else list(path):
        groups = _by_header(spark, root, encoding)
        base = {"basePath": _base(spark, root)}
        tables += [_read_alike(spark, options | base, files, folders, schema, ts_cols) for folders, files in groups]
        if not groups:
            tables.append(_read_alike(spark, options, [root], (), schema, ts_cols))
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


def _base(spark: SparkSession, root: str) -> str:
    """The folder below which folder names are columns."""
    parts = root.rstrip("/").split("/")
    plain = next((i for i, part in enumerate(parts) if set(part) & set("*?[{")), len(parts))
    base = "/".join(parts[:plain])
    return base if plain < len(parts) or Folders(spark).is_folder(base) else base.rpartition("/")[0]


def _by_header(spark: SparkSession, root: str, encoding: str) -> list[tuple[tuple[str, ...], list[str]]]:
    """Files and the columns of their folders, one group a header and list of columns."""
    files = sorted(spark.read.text(root).inputFiles())
    base = _base(spark, root)
    below = len([part for part in urlparse(base).path.split("/") if part])
    groups: dict[tuple, list[str]] = {}
    for name, header in zip(files, Folders(spark).first_lines([unquote(f) for f in files], encoding)):
        parts = [part for part in urlparse(name).path.split("/") if part][below:-1]
        if header is not None:
            groups.setdefault((header, tuple(folder_values(unquote("/".join(parts))))), []).append(unquote(name))
    return [(folders, group) for (_, folders), group in sorted(groups.items())]


def _read_alike(
    spark: SparkSession, options: dict, paths: list[str], folders: Sequence[str], schema, ts_cols: Sequence[str]
) -> DataFrame:
    alone = {k: v for k, v in options.items() if k != "basePath"}
    names = spark.read.options(**alone).csv(paths[:1]).columns
    hidden = [f"_hidden{i}" if n in folders else n for i, n in enumerate(names)]
    layout = T.StructType([T.StructField(n, T.StringType()) for n in [*hidden, _SURPLUS, *folders]])
    rows = spark.read.options(**options).schema(layout).csv(paths)
    rows = rows.where(F.col(f"`{_SURPLUS}`").isNull()).drop(_SURPLUS)
    columns = {n: F.when(~F.col(f"`{n}`").isin(*MISSING_TEXTS), F.col(f"`{n}`")) for n in names if n not in folders}
    columns |= {n: F.col(f"`{n}`") for n in folders}
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        for field in wanted:
            if field.name in columns:
                columns[field.name] = columns[field.name].try_cast(field.dataType)
        kept = [f.name for f in wanted if f.name in columns]
        columns = {n: columns[n] for n in dict.fromkeys([*kept, *ts_cols])}
    for name in ts_cols:
        columns[name] = columns[name].try_cast(T.TimestampNTZType())
    return rows.select(*[c.alias(n) for n, c in columns.items()])


def read_grid(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Long-form grid (site, time, latitude, longitude, variables) with NaN as NULL."""
    grid = spark.read.parquet(*([path] if isinstance(path, str) else path))
    return nan_to_null(grid.withColumnsRenamed({"time": "timestamp"}))


def cell_key(lat: Column, lon: Column) -> Column:
    """Place of a cell on a Z-shaped curve over the globe: cells near each other mostly have
    near places. The bits of 16-bit latitude and longitude in turn; null for a null place.
    Longitudes may count from -180 or from 0."""

    def spread(x: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    def step(share: Column) -> Column:
        bounded = F.least(F.greatest(F.floor(share * 65536.0), F.lit(0)), F.lit(65535)).cast("long")
        return F.when(share.isNotNull(), bounded)

    north = step((lat.cast("double") + 90.0) / 180.0)
    east = step(F.pmod(lon.cast("double") + 180.0, F.lit(360.0)) / 360.0)
    return F.shiftleft(spread(north), 1).bitwiseOR(spread(east))


def write_grid(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), lat: str = "latitude", lon: str = "longitude",
    ts: str = "timestamp", row_group: int = ROW_GROUP, if_exists: str = "overwrite",
) -> None:
    """Write a grid so that a box of latitudes and longitudes reads only the row groups it meets.

    Rows are range partitioned and sorted by their cell's place on a curve, then by time, so
    a row group of about ``row_group`` bytes covers a small area, which its statistics state.
    A cell with many readings is spread over as many partitions as its share of the table.
    """
    order = [*partition_by, "_cell", ts]
    keyed = df.withColumn("_cell", cell_key(F.col(lat), F.col(lon)))
    sorted_ = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_cell")
    writer = sorted_.write.mode(if_exists).option("parquet.block.size", row_group)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (), if_exists: str = "overwrite",
) -> None:
    """Write a table; with ``partition_by`` one folder per value serves both as the table of
    that site and as part of the combined table.

    Rows are first rebalanced by the partition columns, which adaptive execution splits
    where one value holds most rows. ``if_exists="skip"`` leaves an existing output alone.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode({"skip": "ignore"}.get(if_exists, if_exists)).format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, quote='"', escape='"')  # as read_csv reads it
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
