"""Integer codes for text categories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunmelt.runtime import attach, fits_broadcast, number_rows, written_table

SMALL_DICTIONARY = 10_000


def label_dictionary(
    df: DataFrame, column: str, code: str, missing: str = "Unknown"
) -> DataFrame:
    """(code, value) rows; the code is the place among the sorted distinct values, from 0.

    Values sort by code point. A dictionary proven small is numbered in one window, a
    larger one by a range-partitioned sort. Runs jobs when called.
    """
    value = F.coalesce(F.col(column), F.lit(missing))
    values = written_table(df.select(value.alias(column)).distinct())
    if fits_broadcast(values, SMALL_DICTIONARY):
        number: Column = F.row_number().over(Window.orderBy(column)) - 1
        coded = values.withColumn(code, number)
    else:
        coded = number_rows(values, [column], code)
    return coded.select(F.col(code).cast("int").alias(code), column)


def label_encode(
    df: DataFrame, column: str, code: str, missing: str = "Unknown",
    dictionary: DataFrame | None = None, spread_by: list[str] | None = None,
) -> DataFrame:
    """Fill missing values of ``column`` and add its alphabetical ``code``."""
    filled = df.withColumn(column, F.coalesce(F.col(column), F.lit(missing)))
    if dictionary is None:
        dictionary = label_dictionary(filled, column, code, missing)
    return attach(filled, dictionary, [column], spread_by=spread_by)


def label_encode_all(df: DataFrame, codes: Mapping[str, str], missing: str = "Unknown") -> DataFrame:
    """:func:`label_encode` of several columns; one job finds the values of all."""
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit(missing)) for c in codes})
    pairs = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).alias("_value")) for c in codes])
    values = written_table(filled.select(F.explode(pairs).alias("p")).select("p.*").distinct())
    small = fits_broadcast(values, SMALL_DICTIONARY)
    for column, code in codes.items():
        mine = values.where(F.col("_column") == column).select(F.col("_value").alias(column))
        if small:
            coded = mine.withColumn(code, F.row_number().over(Window.orderBy(column)) - 1)
        else:
            coded = number_rows(mine, [column], code)
        coded = coded.select(column, F.col(code).cast("int").alias(code))
        filled = attach(filled, coded, [column], small=small or None)
    return filled
