"""Quantile sketches of sites and days, stored once and merged to any period.

A sketch is a few kilobytes, whatever the number of values, and sketches of days merge to one
of a month, a season or all years, without the hourly rows. A quantile read from one has a
rank that is off by a small share of the values at most: about 1.7 / ``k`` with high
probability, in merged sketches too. ``profile.quantiles`` gives exact ones from the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmelt.functions.nulls import no_nan
from sunmelt.operators.profile import QUARTILES

K = 800


def day_sketches(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("city",), ts: str = "timestamp", k: int = K) -> DataFrame:
    """One row per value of ``keys`` (null is one), day and column: ``count``, ``min``, ``max`` and ``sketch``.

    NaN counts as missing; days without any value of a column have no row of it.
    """
    fields = []
    for c in columns:
        x = no_nan(F.col(c).cast("double"))
        fields.append(
            F.struct(
                F.lit(c).alias("column_name"), F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"),
                F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"),
            )
        )
    days = df.withColumn("date", F.to_date(ts)).groupBy(*keys, "date").agg(F.array(*fields).alias("s"))
    return days.select(*keys, "date", F.inline("s")).where("count > 0")


def merged_sketches(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of the same ``by`` and column as one, with ``count``, ``min`` and ``max``."""
    return sketches.groupBy(*by, "column_name").agg(
        F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("sketch")
    )


def sketched_quantiles(sketches: DataFrame, points: Mapping[str, float] = QUARTILES) -> DataFrame:
    """Quantiles of each sketch as columns, instead of the sketch."""
    found = {name: F.kll_sketch_get_quantile_double(F.col("sketch"), F.lit(q)) for name, q in points.items()}
    return sketches.withColumns(found).drop("sketch")
