"""Derived properties of one material row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sunmelt.functions.nulls import ratio

# Stand-ins used when a property is missing.
DENSITY_LIQUID_DEFAULT = 800.0
DENSITY_SOLID_DEFAULT = 850.0
DENSITY_SOLID_ENTHALPY_DEFAULT = 800.0
SPECIFIC_HEAT_DEFAULT = 2.0
FREEZING_GAP = 2.0
RANGE_EPSILON = 1e-6
KJ_PER_WH = 3.6


def latent_per_degree(latent: Column, melting: Column, freezing: Column) -> Column:
    gap = melting - F.coalesce(freezing, melting - F.lit(FREEZING_GAP)) + F.lit(RANGE_EPSILON)
    return ratio(latent, gap)


def latent_mean(melting: Column, freezing: Column) -> Column:
    return (F.coalesce(melting, F.lit(0.0)) + F.coalesce(freezing, F.lit(0.0))) / F.lit(2.0)


def hysteresis(melting: Column, freezing: Column) -> Column:
    return melting - freezing


def storage_capacity(storage: Column, latent: Column) -> Column:
    return F.coalesce(storage, latent / F.lit(KJ_PER_WH))


def volumetric_enthalpy(density_solid: Column, latent: Column) -> Column:
    density = F.coalesce(density_solid, F.lit(DENSITY_SOLID_ENTHALPY_DEFAULT))
    return density * latent / F.lit(1000.0)


def conductivity_ratio(liquid: Column, solid: Column, both: Column) -> Column:
    return ratio(F.coalesce(liquid, both), F.coalesce(solid, both))


def specific_heat_mean(liquid: Column, solid: Column) -> Column:
    default = F.lit(SPECIFIC_HEAT_DEFAULT)
    return (F.coalesce(liquid, default) + F.coalesce(solid, default)) / F.lit(2.0)


def density_mean(liquid: Column, solid: Column) -> Column:
    low, high = F.lit(DENSITY_LIQUID_DEFAULT), F.lit(DENSITY_SOLID_DEFAULT)
    return (F.coalesce(liquid, low) + F.coalesce(solid, high)) / F.lit(2.0)


def cycles_confidence(cycles: Column, max_cycles: Column) -> Column:
    """Log-scaled share of the best-tested material; 0.5 if none was ever tested."""
    tested = F.log1p(F.coalesce(cycles, F.lit(0.0)))
    return F.when(max_cycles > 0, tested / F.log1p(max_cycles)).otherwise(F.lit(0.5))


def flammable_flag(flammability: Column) -> Column:
    return F.coalesce((flammability == "Yes").cast("int"), F.lit(0))
