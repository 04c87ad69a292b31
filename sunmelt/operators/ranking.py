"""Multi-criteria scores over a whole table, and ranking by score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmelt.operators.columns import present
from sunmelt.runtime import number_rows

# Weight of each criterion (all of them better when larger).
WEIGHTS: dict[str, float] = {
    "latent_heat_melting": 0.40,
    "TC_both": 0.25,
    "Cp_avg": 0.10,
    "rho_H_MJ_m3": 0.15,
    "cycles_confidence": 0.10,
}
EPSILON = 1e-8


def _known(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _column_summary(df: DataFrame, criteria: Sequence[str]) -> Column:
    """Norm, maximum and minimum of every criterion as one scalar subquery."""
    fields = []
    for c in criteria:
        x = _known(c)
        fields.append(
            F.struct(
                F.sqrt(F.sum(x * x)).alias("norm"),
                F.max(x).alias("hi"),
                F.min(x).alias("lo"),
            ).alias(c)
        )
    return df.agg(F.struct(*fields).alias("summary")).scalar()


def topsis(
    df: DataFrame, weights: Mapping[str, float] = WEIGHTS, score: str = "pcm_suitability_score"
) -> DataFrame:
    """Closeness to the ideal row: distance from the worst over the sum of both distances.

    Scaling a column keeps its order, so the ideal and the worst value follow from the raw
    maximum and minimum and one pass of partial aggregates is all the table needs.
    """
    criteria = present(df, list(weights))
    out = df.withColumn("_s", _column_summary(df, criteria))
    best, worst = [], []
    for c in criteria:
        scale = F.col(f"_s.{c}.norm") + F.lit(EPSILON)

        def weighted(x: Column, scale: Column = scale, w: float = weights[c]) -> Column:
            return x / scale * F.lit(w)

        value = weighted(_known(c))
        best.append(F.pow(value - weighted(F.col(f"_s.{c}.hi")), F.lit(2.0)))
        worst.append(F.pow(value - weighted(F.col(f"_s.{c}.lo")), F.lit(2.0)))
    return (
        out.withColumns({"_best": F.sqrt(_total(best)), "_worst": F.sqrt(_total(worst))})
        .withColumn(score, F.col("_worst") / (F.col("_best") + F.col("_worst") + F.lit(EPSILON)))
        .drop("_s", "_best", "_worst")
    )


def minmax_score(
    df: DataFrame, weights: Mapping[str, float] = WEIGHTS, score: str = "pcm_suitability_score"
) -> DataFrame:
    """Weighted sum of min-max scaled criteria; a constant criterion adds nothing."""
    criteria = present(df, list(weights))
    out = df.withColumn("_s", _column_summary(df, criteria))
    parts = []
    for c in criteria:
        lo, hi = F.col(f"_s.{c}.lo"), F.col(f"_s.{c}.hi")
        scaled = F.coalesce(F.try_divide(_known(c) - lo, hi - lo), F.lit(0.0))
        parts.append(F.lit(weights[c]) * scaled)
    return out.withColumn(score, _total(parts)).drop("_s")


def rank_materials(
    df: DataFrame, score: str = "pcm_suitability_score", tie_break: str = "product",
    rank: str | None = None,
) -> DataFrame:
    """Best score first. With ``rank`` the position from 1 is added as a column."""
    order = [F.desc_nulls_last(score), F.asc(tie_break)]
    if rank is None:
        return df.orderBy(*order)
    return number_rows(df, order, rank, start=1)
