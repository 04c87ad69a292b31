"""Profiles of a table: statistics, missing values, row counts through filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunmelt.functions.nulls import no_nan
from sunmelt.runtime import SMALL_WINDOW, attach, fits_broadcast, written_table

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
ACCURACY = 10_000  # of the sketch: it is wrong by one rank in so many at most
MARGIN = 2 / ACCURACY  # added to both sides of a bracket
WHOLE = 100_000  # smaller groups are bracketed whole


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def describe(
    df: DataFrame, columns: Sequence[str] | None = None, quartiles: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row per numeric column, and per value of ``by``: count, mean, std, min, max and
    exact quartiles. NaN counts as missing.

    Everything but the quartiles is one pass of partial aggregates (see :func:`quantiles`).
    """
    by = list(by)
    columns = list(columns or [c for c in numeric_columns(df) if c not in by])
    fields = []
    for c in columns:
        x = no_nan(F.col(c).cast("double"))
        fields.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(x).alias("count"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
            )
        )
    stats = df.groupBy(*by).agg(F.array(*fields).alias("s")).select(*by, F.inline("s"))
    if not quartiles:
        return stats
    points = quantiles(df, columns, QUARTILES, by)
    points = points.withColumnsRenamed({c: f"_q_{c}" for c in [*by, "column_name"]})
    match = F.col("column_name") == F.col("_q_column_name")
    for c in by:
        match = match & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return stats.join(points, match, "left").drop(*[f"_q_{c}" for c in [*by, "column_name"]])


def quantiles(
    df: DataFrame, columns: Sequence[str], points: Mapping[str, float] = QUARTILES,
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact quantiles (linear between neighbours) of many columns, per value of ``by`` (null is one).

    A mergeable sketch first brackets each quantile; a bracket holds all values in a group of
    under ``WHOLE`` rows and a few ten-thousandths of a larger one. Only values inside a
    bracket are shuffled, equal ones counted first, and ranked by range partitions, on top
    of the number of values below the bracket.
    """
    keys = [f"_k{i}" for i in range(len(by))] or ["_all"]
    values = {c: no_nan(F.col(c).cast("double")) for c in columns}
    # Keys are never null, so that joins find the null group too.
    keyed = [F.coalesce(F.concat(F.lit("s"), F.col(c).cast("string")), F.lit("n")).alias(k) for c, k in zip(by, keys)]
    rows = df.select(*by, *(keyed or [F.lit(1).alias("_all")]), *[v.alias(f"_v{i}") for i, v in enumerate(values.values())])
    names = list(points)
    tries = [*(max(0.0, q - MARGIN) for q in points.values()), *(min(1.0, q + MARGIN) for q in points.values())]

    def edges(x: Column) -> Column:
        near = F.percentile_approx(x, tries, ACCURACY)
        few = F.count(x) < WHOLE
        low = [F.when(few, F.min(x)).otherwise(near[i]).alias(f"lo{i}") for i in range(len(names))]
        high = [F.when(few, F.max(x)).otherwise(near[len(names) + i]).alias(f"hi{i}") for i in range(len(names))]
        return F.struct(F.count(x).alias("total"), *low, *high)

    named = written_table(rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in by], *[edges(F.col(f"_v{i}")).alias(f"_b{i}") for i in range(len(columns))]))
    names_of, bounds = named.select(*keys, *by), named.drop(*by)
    bounded = attach(rows.drop(*by), bounds, keys, "inner", small=None if by else True)
    cells = [(i, j) for i in range(len(columns)) for j in range(len(names))]
    labels = {(i, j): [F.lit(columns[i]).alias("column_name"), F.lit(names[j]).alias("point"), F.lit(points[names[j]]).alias("q")] for i, j in cells}
    below = bounded.groupBy(*keys).agg(
        F.array(*[
            F.struct(*labels[i, j], F.max(f"_b{i}.total").alias("total"), F.count_if(F.col(f"_v{i}") < F.col(f"_b{i}.lo{j}")).alias("below"))
            for i, j in cells
        ]).alias("s")
    ).select(*keys, F.inline("s")).where("total > 0")
    inside = F.array(*[
        F.when(F.col(f"_v{i}").between(F.col(f"_b{i}.lo{j}"), F.col(f"_b{i}.hi{j}")), F.struct(*labels[i, j], F.col(f"_v{i}").alias("value")))
        for i, j in cells
    ])
    group = [*keys, "column_name", "point"]
    counts = (
        bounded.select(*keys, F.explode(F.array_compact(inside)).alias("p"))
        .groupBy(*keys, "p.column_name", "p.point", "p.value").agg(F.count(F.lit(1)).alias("n"))
    )
    counts, below = written_table(counts), written_table(below)
    place = F.col("q") * (F.col("total") - 1)
    ranks = F.array_distinct(F.array(F.floor("place"), F.ceil("place")))
    if fits_broadcast(counts, SMALL_WINDOW):  # few values: one window a group
        up_to = Window.partitionBy(*group).orderBy("value")
        ranked = counts.withColumn("end", F.sum("n").over(up_to))
        joined = attach(ranked, below, group, "inner").withColumn("end", F.col("end") + F.col("below")).withColumn("place", place)
        found = joined.withColumn("rank", F.explode(ranks))
    else:
        found = _ranked_parts(counts, below, group, place, ranks)
    found = found.where((F.col("rank") >= F.col("end") - F.col("n")) & (F.col("rank") < F.col("end")))
    low = F.min("value")
    at_points = found.groupBy(*group, "place").agg(
        (low + (F.max("value") - low) * (F.col("place") - F.floor("place"))).alias("value")
    )
    wide = at_points.groupBy(*keys, "column_name").agg(
        *[F.max(F.when(F.col("point") == p, F.col("value"))).alias(p) for p in names]
    )
    return attach(wide, names_of, keys, "inner").drop(*keys) if by else wide.drop("_all")


def _ranked_parts(counts: DataFrame, below: DataFrame, group: Sequence[str], place: Column, ranks: Column) -> DataFrame:
    """Values that may hold an asked rank, with ``end``, the rank after them: each range
    partition is ranked by itself on top of what lies before it."""
    ranged = written_table(
        counts.repartitionByRange(*group, "value").withColumn("part", F.spark_partition_id())
    )
    up_to = Window.partitionBy(*group).orderBy("part")
    parts = ranged.groupBy(*group, "part").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(up_to) - F.col("n"))
    asks = (
        attach(parts, below, group, "inner")
        .select(*group, "part", "n", (F.col("below") + F.col("before")).alias("start"), place.alias("place"))
        .withColumn("rank", F.explode(ranks))
        .where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("n")))
        .groupBy(*group, "part", "start", "place").agg(F.collect_list("rank").alias("ranks"))
    )
    within = Window.partitionBy(*group, "part").orderBy("value")
    return (
        attach(ranged, written_table(asks), [*group, "part"], "inner")
        .withColumn("end", F.col("start") + F.sum("n").over(within))
        .withColumn("rank", F.explode("ranks"))
    )


def null_profile(
    df: DataFrame, columns: Sequence[str] | None = None, only_missing: bool = True
) -> DataFrame:
    """Number of NULLs per column, by default only of columns that have any."""
    columns = list(columns or df.columns)
    counts = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.count_if(F.col(c).isNull()).alias("null_count"),
                )
                for c in columns
            ]
        ).alias("s")
    ).select(F.inline("s"))
    return counts.where(F.col("null_count") > 0) if only_missing else counts


def missing_diff(
    before: DataFrame, after: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """NULLs per column before and after a fill."""
    columns = list(columns or [c for c in before.columns if c in set(after.columns)])
    first = null_profile(before, columns, only_missing=False)
    second = null_profile(after, columns, only_missing=False)
    return first.withColumnRenamed("null_count", "null_before").join(
        second.withColumnRenamed("null_count", "null_after"), "column_name"
    )


def _stage_counts(filters: Mapping[str, Column], start: str) -> dict[str, Column]:
    passed, counts = F.lit(True), {start: F.count(F.lit(1))}
    for name, condition in filters.items():
        passed = passed & condition
        counts[name] = F.count_if(passed)
    return counts


def count_stages(df: DataFrame, filters: Mapping[str, Column], start: str = "input") -> DataFrame:
    """Rows left after each of a series of filters, all counted in one pass."""
    fields = [F.struct(F.lit(name).alias("stage"), n.alias("rows")) for name, n in _stage_counts(filters, start).items()]
    return df.agg(F.array(*fields).alias("s")).select(F.inline("s"))


def observe_stages(df: DataFrame, filters: Mapping[str, Column], start: str = "input") -> tuple[DataFrame, Observation]:
    """Like :func:`count_stages`, but counted by the job that first runs ``df`` (its writing, say):
    ``df`` to be used from then on, and what :func:`observed_stages` reads after that job."""
    seen = Observation()
    return df.observe(seen, *[n.alias(name) for name, n in _stage_counts(filters, start).items()]), seen


def observed_stages(spark: SparkSession, seen: Observation) -> DataFrame:
    """The rows of :func:`count_stages`; waits for the job."""
    return spark.createDataFrame(list(seen.get.items()), "stage string, rows bigint")


def distinct_days(df: DataFrame, keys: Sequence[str] = (), ts: str = "timestamp") -> DataFrame:
    return df.select(*keys, F.to_date(ts).alias("date")).distinct()
