"""Choice of the best material for each site and season."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmelt.runtime import SMALL_WINDOW, attach, fits_broadcast, running, written_table

# Shift of the wanted melting point from the setpoint, share of the site's
# base index, by season; index from which the narrow tolerance holds; both tolerances.
SEASON_OFFSETS = {"winter": -3.0, "pre-monsoon": 2.0, "monsoon": -1.0, "post-monsoon": 0.0}
SEASON_FACTORS = {"winter": 0.7, "pre-monsoon": 1.0, "monsoon": 0.5, "post-monsoon": 0.85}
INDEX_THRESHOLD = 5.7
TOLERANCE_LOW = 6.0
TOLERANCE_HIGH = 4.0


def _by_season(season: Column, values: dict[str, float]) -> Column:
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), season)


def season_index(
    hourly: DataFrame, site: str = "city", season: str = "season", index: str = "RRTDHS",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Measured mean heating index per site and season, with site constants to ``keep``."""
    constants = [F.max(c).alias(c) for c in keep]
    return hourly.groupBy(site, season).agg(F.avg(index).alias("rrtdhs_approx"), *constants)


def approximate_index(sites: DataFrame, base: str = "base_index") -> DataFrame:
    """Heating index of each season from one base value per site, where none is measured."""
    season = F.explode(F.array(*[F.lit(s) for s in SEASON_FACTORS]))
    return sites.withColumn("season", season).withColumn(
        "rrtdhs_approx", F.col(base) * _by_season(F.col("season"), SEASON_FACTORS)
    )


def wanted_melting_point(t_set: Column, season: Column) -> Column:
    return t_set + _by_season(season, SEASON_OFFSETS)


def assign_labels(
    site_season: DataFrame,
    materials: DataFrame,
    tol_low: float = TOLERANCE_LOW,
    tol_high: float = TOLERANCE_HIGH,
    material_id: str = "material_id",
    cell: float | None = None,
) -> DataFrame:
    """Best-scoring material within the tolerance of the wanted melting point, else the
    nearest one; ties go to the product name.

    ``site_season`` has city, season, T_set and rrtdhs_approx; ``materials`` has product,
    Tm_melting, pcm_suitability_score and an id. A low-resource site (index below 5.7) takes
    the wider tolerance.

    No pair of site and material is formed. Materials shrink to the best one per melting
    point and sites to their distinct targets; the temperature axis is cut into cells no
    wider than a tolerance. A tolerance band is then whole cells (one summary row each) plus
    two cut cells, answered by a running best inside the cell. Both shrunk tables are
    written once, and no step needs a whole cell, or the whole axis, in one task.
    """
    width = cell or min(tol_low, tol_high)
    if width <= 0 or width > min(tol_low, tol_high):
        raise ValueError("cell must be positive and no wider than a tolerance")

    def cell_of(x: Column) -> Column:
        return F.floor(x / F.lit(width)).cast("long")

    wide = F.col("rrtdhs_approx") < F.lit(INDEX_THRESHOLD)
    sites = site_season.withColumns(
        {
            "optimal_Tm_target": wanted_melting_point(F.col("T_set"), F.col("season")),
            "_tol": F.when(wide, F.lit(tol_low)).otherwise(F.lit(tol_high)),
        }
    )
    wanted = written_table(
        sites.select(F.col("optimal_Tm_target").alias("target"), F.col("_tol").alias("tol"))
        .where(F.col("target").isNotNull())
        .distinct()
    )

    # Orders by score from the best down, then by name; unscored materials come last.
    worse = F.coalesce(-F.col("pcm_suitability_score"), F.lit(float("inf"))).alias("worse")
    name, number = F.col("product").alias("name"), F.col(material_id).alias("id")
    tm = F.col("Tm_melting").cast("double").alias("tm")
    score = F.col("pcm_suitability_score").alias("score")
    points = written_table(
        materials.where(F.col("Tm_melting").isNotNull())
        .select(
            tm,
            F.struct(worse, name, number, tm, score).alias("best"),
            F.struct(name, worse, number, tm, score).alias("named"),
        )
        .groupBy("tm")
        .agg(F.min("best").alias("best"), F.min("named").alias("named"))
        .withColumn("cell", cell_of(F.col("tm")))
    )
    # Every table ordered below has at most one row per melting point and two per target.
    third = SMALL_WINDOW // 3
    small = fits_broadcast(points, third) and fits_broadcast(wanted, third)
    summary = points.groupBy("cell").agg(
        F.min("best").alias("best"),
        F.min_by("named", "tm").alias("lowest"),
        F.max_by("named", "tm").alias("highest"),
    )

    band = wanted.withColumns(
        {"lo": F.col("target") - F.col("tol"), "hi": F.col("target") + F.col("tol")}
    ).withColumns({"lo_cell": cell_of(F.col("lo")), "hi_cell": cell_of(F.col("hi"))})
    inner = band.where(F.col("hi_cell") - F.col("lo_cell") >= 2).select(
        "target", "tol",
        F.explode(F.sequence(F.col("lo_cell") + 1, F.col("hi_cell") - 1)).alias("cell"),
    )
    known_small = small or None
    whole = attach(
        inner, summary.select("cell", "best"), ["cell"], "inner", spread_by=["target", "tol"], small=known_small
    ).select("target", "tol", "best")

    def cut(edge: str, ascending: bool) -> DataFrame:
        """Best material of the edge's cell on the inner side of the edge."""
        ask = band.select(
            F.col(f"{edge}_cell").alias("cell"), F.col(edge).alias("x"), F.lit(1).alias("ask"),
            F.lit(None).cast(points.schema["best"].dataType).alias("best"), "target", "tol",
        )
        have = points.select(
            "cell", F.col("tm").alias("x"), F.lit(0).alias("ask"), "best",
            F.lit(None).cast("double").alias("target"), F.lit(None).cast("double").alias("tol"),
        )
        x = F.col("x").asc() if ascending else F.col("x").desc()
        best = running(
            have.unionByName(ask), ["cell"], [x, F.col("ask")], F.col("best"), F.min, "found",
            small,
        )
        return best.where((F.col("ask") == 1) & F.col("found").isNotNull()).select(
            "target", "tol", F.col("found").alias("best")
        )

    matched = written_table(
        whole.unionByName(cut("lo", ascending=False))
        .unionByName(cut("hi", ascending=True))
        .groupBy("target", "tol")
        .agg(F.min("best").alias("pick"))
    )

    # A target without candidates lies in an empty cell, so the nearest material is the
    # highest of the nearest cell before or the lowest of the nearest cell after.
    lonely = wanted.join(matched, ["target", "tol"], "left_anti").withColumn(
        "cell", cell_of(F.col("target"))
    )
    axis = summary.select("cell", "lowest", "highest").unionByName(
        lonely.select("cell").distinct(), allowMissingColumns=True
    ).withColumn("axis", F.lit(0))
    for side, step, pick in (("highest", F.col("cell").asc(), F.max), ("lowest", F.col("cell").desc(), F.min)):
        nearest_cell = F.when(F.col(side).isNotNull(), F.struct("cell", side))
        axis = running(axis, ["axis"], [step], nearest_cell, pick, f"near_{side}", small)
    neighbours = axis.select(
        "cell", F.col("near_highest.highest").alias("below"), F.col("near_lowest.lowest").alias("above")
    )
    gap_below = F.col("target") - F.col("below.tm")
    gap_above = F.col("above.tm") - F.col("target")
    take_below = (
        F.col("above").isNull()
        | (gap_below < gap_above)
        | ((gap_below == gap_above) & (F.col("below.name") <= F.col("above.name")))
    )
    near = F.when(F.col("below").isNotNull() & take_below, F.col("below")).otherwise(F.col("above"))
    nearest = (
        attach(lonely, neighbours, ["cell"], "inner", spread_by=["target", "tol"], small=known_small)
        .withColumn("near", near)
        .where(F.col("near").isNotNull())
        .select("target", "tol", *[F.col(f"near.{f}").alias(f) for f in ("name", "id", "tm", "score")])
    )
    picks = written_table(
        matched.select(
            "target", "tol", *[F.col(f"pick.{f}").alias(f) for f in ("name", "id", "tm", "score")]
        )
        .unionByName(nearest)
        .select(
            F.col("target").alias("optimal_Tm_target"), F.col("tol").alias("_tol"),
            F.col("name").alias("best_pcm_product"), F.col("id").alias("best_pcm_id"),
            F.col("tm").alias("best_pcm_Tm"), F.col("score").alias("best_pcm_score"),
        )
    )
    keep = [c for c in sites.columns if c not in ("optimal_Tm_target", "_tol")]
    return attach(sites, picks, ["optimal_Tm_target", "_tol"], spread_by=keep).select(
        *keep, "optimal_Tm_target", "best_pcm_product", "best_pcm_id", "best_pcm_Tm",
        "best_pcm_score",
    )
