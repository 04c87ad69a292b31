"""Row filters and masked updates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmelt.functions.text import KEYWORDS, mentions

# Melting range of materials that suit solar water heating.
MELTING_MIN = 35.0
MELTING_MAX = 75.0
CRITICAL = ("Tm_melting", "latent_heat_melting")


def filter_range(
    df: DataFrame, column: str = "Tm_melting", lo: float = MELTING_MIN, hi: float = MELTING_MAX
) -> DataFrame:
    """Keep rows with ``lo <= column <= hi``; NULL fails."""
    return df.where(F.col(column).between(lo, hi))


def drop_missing(df: DataFrame, subset: Sequence[str] = CRITICAL) -> DataFrame:
    return df.dropna(subset=list(subset))


def fill_when(df: DataFrame, target: str, condition: Column, value: Column) -> DataFrame:
    """Set ``target`` to ``value`` where the condition holds."""
    return df.withColumn(target, F.when(condition, value).otherwise(F.col(target)))


def filter_keywords(
    df: DataFrame, column: str, keywords: tuple[str, ...] = KEYWORDS
) -> DataFrame:
    return df.where(mentions(F.col(column), keywords))
