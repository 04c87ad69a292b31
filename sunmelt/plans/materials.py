"""Raw material catalogue to a clean, scored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunmelt.functions import materials as props
from sunmelt.functions.nulls import known_flag
from sunmelt.functions.text import messy_number
from sunmelt.operators.columns import (
    MATERIAL_HEADERS,
    dedupe_columns,
    drop,
    material_header_map,
    present,
    rename,
    select_known,
)
from sunmelt.operators.encode import label_encode_all
from sunmelt.operators.filters import drop_missing, filter_range
from sunmelt.operators.impute import chained_impute, fallback_fill, rule_fill
from sunmelt.operators.ranking import topsis
from sunmelt.runtime import spread_rows, written_table

# Catalogue columns that hold numbers, and descriptive text that is dropped.
NUMERIC_COLUMNS = (
    "Tm_melting", "Tm_freezing", "Tm_nucleation", "latent_heat_melting",
    "latent_heat_freezing", "heat_storage_Wh_kg", "density_liquid", "density_solid",
    "Cp_liquid", "Cp_solid", "TC_liquid", "TC_solid", "TC_both", "volume_expansion",
    "max_op_temp", "flash_point", "cycles_tested",
)
DESCRIPTIVE = ("manufacturer", "appearance")


def standard_columns(raw: DataFrame) -> DataFrame:
    """Known headers renamed and ordered; unknown columns and repeats dropped."""
    named = dedupe_columns(rename(raw, material_header_map()))
    return select_known(named, list(MATERIAL_HEADERS.values()))


def parse_numbers(df: DataFrame) -> DataFrame:
    return df.withColumns({c: messy_number(F.col(c)) for c in present(df, NUMERIC_COLUMNS)})


def filled_materials(raw: DataFrame, rounds: int | None = None) -> DataFrame:
    """Parsed catalogue without holes; ``flash_point_known`` is taken before the fill."""
    # Written, as what follows uses every parsed cell more than once.
    df = written_table(parse_numbers(standard_columns(spread_rows(raw))))
    if "flash_point" in df.columns:
        df = df.withColumn("flash_point_known", known_flag(F.col("flash_point")))
    df = rule_fill(df)
    df = chained_impute(df) if rounds is None else chained_impute(df, rounds=rounds)
    return fallback_fill(df)


def suited_materials(filled: DataFrame) -> DataFrame:
    """Materials with a suitable melting point; after the fill, which learns from every row."""
    return drop_missing(filter_range(filled))


def derived_properties(df: DataFrame) -> DataFrame:
    """Derived numeric properties and category codes."""
    c = F.col
    top = df.agg(F.max(F.coalesce(c("cycles_tested"), F.lit(0.0)))).scalar()
    df = df.withColumns(
        {
            "latent_per_degree": props.latent_per_degree(
                c("latent_heat_melting"), c("Tm_melting"), c("Tm_freezing")
            ),
            "latent_heat_avg": props.latent_mean(
                c("latent_heat_melting"), c("latent_heat_freezing")
            ),
            "Tm_range": props.hysteresis(c("Tm_melting"), c("Tm_freezing")),
            "heat_storage_Wh_kg": props.storage_capacity(
                c("heat_storage_Wh_kg"), c("latent_heat_melting")
            ),
            "TC_ratio": props.conductivity_ratio(c("TC_liquid"), c("TC_solid"), c("TC_both")),
            "Cp_avg": props.specific_heat_mean(c("Cp_liquid"), c("Cp_solid")),
            "density_avg": props.density_mean(c("density_liquid"), c("density_solid")),
            "cycles_confidence": props.cycles_confidence(c("cycles_tested"), top),
            "is_flammable": props.flammable_flag(c("flammability")),
        }
    ).withColumn(
        "rho_H_MJ_m3", props.volumetric_enthalpy(c("density_solid"), c("latent_heat_avg"))
    )
    if "flash_point_known" not in df.columns:
        df = df.withColumn("flash_point_known", known_flag(c("flash_point")))
    return drop(df, DESCRIPTIVE)


def material_codes(df: DataFrame) -> DataFrame:
    return label_encode_all(df, {"pcm_type": "pcm_type_code", "flammability": "flammability_enc"})


def scored_materials(suited: DataFrame) -> DataFrame:
    """Derived values, codes and scores; each step reads the one before more than once, so
    both are written first."""
    derived = written_table(derived_properties(written_table(suited)))
    return topsis(material_codes(derived))


def materials_clean(raw: DataFrame, rounds: int | None = None) -> DataFrame:
    """Whole path from the raw catalogue to the scored table."""
    return scored_materials(suited_materials(filled_materials(raw, rounds)))
