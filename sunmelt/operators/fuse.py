"""Hourly climate rows joined with demand, the chosen material and its properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmelt.functions import demand
from sunmelt.operators.columns import rename, select_known
from sunmelt.operators.encode import label_dictionary, label_encode
from sunmelt.runtime import attach

# Columns carried over from the label map and from the material table.
LABEL_PAYLOAD = (
    "best_pcm_product", "best_pcm_id", "best_pcm_Tm", "optimal_Tm_target", "rrtdhs_approx",
)
MATERIAL_PAYLOAD = (
    "product", "Tm_melting", "Tm_freezing", "Tm_nucleation", "latent_heat_melting",
    "latent_heat_freezing", "heat_storage_Wh_kg", "density_liquid", "density_solid",
    "Cp_liquid", "Cp_solid", "TC_liquid", "TC_solid", "TC_both", "volume_expansion",
    "max_op_temp", "flash_point", "cycles_tested", "rho_H_MJ_m3", "TC_ratio", "Cp_avg",
    "density_avg", "pcm_type_code", "pcm_suitability_score", "is_flammable",
    "cycles_confidence",
)
UNKNOWN_LABEL = "unknown"


def with_demand(df: DataFrame, hour: str = "hour") -> DataFrame:
    """Add the hot-water demand of the hour, its level and code, and the peak flags."""
    h = F.col(hour)
    return (
        df.withColumn("demand_L_per_hr", demand.demand_litres(h))
        .withColumn("demand_level", demand.demand_level(F.col("demand_L_per_hr")))
        .withColumns(
            {
                "demand_code": demand.demand_code(F.col("demand_level")),
                "is_morning_peak": demand.peak_flag(h, demand.MORNING_PEAK),
                "is_evening_peak": demand.peak_flag(h, demand.EVENING_PEAK),
            }
        )
    )


def with_index_bin(df: DataFrame, index: str = "RRTDHS") -> DataFrame:
    return df.withColumn("rrtdhs_bin", demand.index_bin(F.col(index)))


def join_labels(
    df: DataFrame, label_map: DataFrame, spread_by: list[str] | None = None
) -> DataFrame:
    """Left join of the label map on city and season."""
    payload = select_known(label_map, ["city", "season", *LABEL_PAYLOAD])
    return attach(df, payload, ["city", "season"], spread_by=spread_by)


def join_materials(
    df: DataFrame, materials: DataFrame, spread_by: list[str] | None = None
) -> DataFrame:
    """Left join of the chosen material's numeric properties on its product name.

    A product listed twice doubles the rows, as in any left join.
    """
    props = rename(select_known(materials, MATERIAL_PAYLOAD), {"product": "best_pcm_product"})
    return attach(df, props, ["best_pcm_product"], spread_by=spread_by)


def with_label_code(
    df: DataFrame, dictionary: DataFrame | None = None, spread_by: list[str] | None = None
) -> DataFrame:
    """Add ``pcm_label`` (missing -> unknown) and its alphabetical ``pcm_label_code``."""
    labelled = df.withColumn("pcm_label", F.col("best_pcm_product"))
    return label_encode(
        labelled, "pcm_label", "pcm_label_code", UNKNOWN_LABEL, dictionary, spread_by
    )


def label_classes(df: DataFrame) -> DataFrame:
    """(pcm_label_code, pcm_label) of a table with chosen materials, for later inference."""
    labelled = df.withColumn("pcm_label", F.col("best_pcm_product"))
    return label_dictionary(labelled, "pcm_label", "pcm_label_code", UNKNOWN_LABEL)
