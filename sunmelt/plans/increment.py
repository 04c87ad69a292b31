"""The daily table kept up to date: stored parts of days, to which only new hours are added.

A part holds what days are made of: sums, counts, extremes, first values and how early they
are. Parts lie in folders by key and month. New hours become parts first; they are then
added to the stored parts of the months that they touch, and only those folders are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunmelt.operators.daily import DAILY_FIRSTS, DAILY_STATS, add_parts, dated, merge_rollup, partial_rollup, rollup_columns
from sunmelt.runtime import attach, written_table
from sunmelt.sources.folders import Folders
from sunmelt.sources.sinks import MARKS, recover, replace_parts

MONTH = "_month"


def update_days(
    hours: DataFrame, path: str, keys: Sequence[str] = ("city",), ts: str = "timestamp",
    stats: Mapping[str, Sequence[str]] = DAILY_STATS, firsts: Sequence[str] = DAILY_FIRSTS, redo: bool = False,
) -> list[str]:
    """Add ``hours`` to the stored days at ``path``; returns the folders written.

    Every hour must come once: hours that are sent again count again. With ``redo`` the days
    in ``hours`` are made anew from them, whatever was stored of those days. All calls must
    name the same columns, with the same types. Rows without a key or a time are left out.
    """
    spark, keys = hours.sparkSession, list(keys)
    stats, values, text = rollup_columns(hours, keys, stats, firsts)
    day, folders = [*keys, "date"], [*keys, MONTH]
    new = partial_rollup(dated(hours, keys, ts), [*day, *text], stats, values, ts)
    new = written_table(new.withColumn(MONTH, F.date_format("date", "yyyy-MM")))
    recover(spark, path)
    if Folders(spark).names(f"{path}/{MARKS}"):
        old = _stored(spark, path, new.schema)
        touched = new.select(*folders).distinct()
        old = attach(old, touched, folders, "inner", spread_by=["date", *text])
        if redo:
            old = old.join(new.select(*day).distinct(), day, "left_anti")
        new = add_parts(new.unionByName(old), [*day, *text, MONTH])
    return replace_parts(new, path, folders, sort_by=["date"])


def stored_days(
    spark: SparkSession, path: str, like: DataFrame, keys: Sequence[str] = ("city",), ts: str = "timestamp",
    stats: Mapping[str, Sequence[str]] = DAILY_STATS, firsts: Sequence[str] = DAILY_FIRSTS,
) -> DataFrame:
    """The daily table of the stored parts, as ``daily_rollup`` gives it for all hours.

    ``like`` has the columns of the hours; its rows are not read.
    """
    keys = list(keys)
    stats, values, text = rollup_columns(like, keys, stats, firsts)
    layout = partial_rollup(dated(like, keys, ts), [*keys, "date", *text], stats, values, ts).schema
    parts = _stored(spark, path, T.StructType([*layout, T.StructField(MONTH, T.StringType())]))
    return merge_rollup(parts.drop(MONTH), [*keys, "date"], stats, values, text, combine=bool(text))


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*[f.name for f in schema])
