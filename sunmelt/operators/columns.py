"""Schema operators. They look at column names and types only and start no job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sunmelt.functions.nulls import no_nan

# Accepted source names of each weather variable, best first. A source column
# matches by its whole name, else by how it starts.
WEATHER_ALIASES: dict[str, tuple[str, ...]] = {
    "t2m": ("2m_temperature", "t2m"),
    "d2m": ("2m_dewpoint_temperature", "d2m", "dewpoint"),
    "u10": ("10m_u_component_of_wind", "u10", "10m_u"),
    "v10": ("10m_v_component_of_wind", "v10", "10m_v"),
    "ssrd": ("surface_solar_radiation_downwards", "ssrd", "surface_solar_radiation"),
    "fdir": (
        "mean_surface_direct_short_wave_radiation_flux",
        "fdir",
        "avg_sdirswrf",
        "msdrswrf",
        "direct_short",
    ),
    "strd": ("surface_thermal_radiation_downwards", "strd", "thermal_radiation"),
    "tcc": ("total_cloud_cover", "tcc", "cloud"),
    "tp": ("total_precipitation", "tp", "precip"),
    "sp": ("surface_pressure", "sp", "pressure"),
}

# Catalogue headers and the column each becomes, in output order.
MATERIAL_HEADERS: dict[str, str] = {
    "PCM": "pcm_id",
    "Product": "product",
    "Manufacturer": "manufacturer",
    "Type": "pcm_type",
    "Appearance": "appearance",
    "Melting Temperature (°C)": "Tm_melting",
    "Freezing/Congealing Temperature (°C)": "Tm_freezing",
    "Nucleation Temperature (°C)": "Tm_nucleation",
    "Latent Heat - Melting (kJ/kg)": "latent_heat_melting",
    "Latent Heat - Freezing (kJ/kg)": "latent_heat_freezing",
    "Heat Storage Capacity (Wh/kg)": "heat_storage_Wh_kg",
    "Density - Liquid (kg/m³)": "density_liquid",
    "Density - Solid (kg/m³)": "density_solid",
    "Specific Heat - Liquid (kJ/kgK)": "Cp_liquid",
    "Specific Heat - Solid (kJ/kgK)": "Cp_solid",
    "Thermal Conductivity - Liquid (W/mK)": "TC_liquid",
    "Thermal Conductivity - Solid (W/mK)": "TC_solid",
    "Thermal Conductivity - Both Phases (W/mK)": "TC_both",
    "Volume Expansion (%)": "volume_expansion",
    "Max Operating Temperature (°C)": "max_op_temp",
    "Flammability": "flammability",
    "Flash Point (°C)": "flash_point",
    "Number of Cycles Tested": "cycles_tested",
}

# Name fragments by which the final table is audited.
AUDIT_GROUPS: dict[str, tuple[str, ...]] = {
    "climate": (
        "GHI", "DNI", "DHI", "T_amb", "RHum", "W_spd", "cloud", "CSI", "SZA", "RRTDHS",
        "ETR", "precip", "P_atm", "sunrise", "sunset", "lag", "roll",
    ),
    "material": (
        "Tm_", "latent", "TC_", "density", "Cp_", "pcm", "rho_H", "heat_storage", "max_op",
        "flash", "cycles",
    ),
    "time": (
        "month", "DOY", "year", "season", "date", "city", "lat", "lon", "alt",
        "climate_zone", "T_set", "demand", "high_solar",
    ),
    "target": ("next_day", "label"),
}


def material_header_map() -> dict[str, str]:
    """Header map including headers whose UTF-8 bytes were once read as Latin-1."""
    out = {}
    for header, name in MATERIAL_HEADERS.items():
        out[header] = name
        out[header.encode("utf-8").decode("latin-1")] = name
    return out


def find_alias(columns: Sequence[str], names: Sequence[str]) -> str | None:
    """First column equal to one of ``names``, else the first one starting with one."""
    by_lower = {c.lower(): c for c in reversed(columns)}
    for name in names:
        if name.lower() in by_lower:
            return by_lower[name.lower()]
    for name in names:
        for column in columns:
            if column.lower().startswith(name.lower()):
                return column
    return None


def resolve_alias(
    df: DataFrame, aliases: Mapping[str, Sequence[str]] = WEATHER_ALIASES
) -> DataFrame:
    """Rename whichever alias of each target is there; absent targets are skipped."""
    found = {target: find_alias(df.columns, names) for target, names in aliases.items()}
    return df.withColumnsRenamed({src: target for target, src in found.items() if src})


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by map. Unlike a chain of renames this may give equal names (see dedupe)."""
    return df.toDF(*[names.get(c, c) for c in df.columns])


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Keep the first of equally named columns."""
    positions: dict[str, int] = {}
    for i, name in enumerate(df.columns):
        positions.setdefault(name, i)
    numbered = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_c{i}").alias(name) for name, i in positions.items()])


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of ``columns`` that ``df`` has, in the given order."""
    have = set(df.columns)
    return [c for c in columns if c in have]


def select_known(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*present(df, list(dict.fromkeys(keep))))


def drop(df: DataFrame, names: Sequence[str] = (), containing: Sequence[str] = ()) -> DataFrame:
    """Drop columns by exact name or by a fragment of the name."""
    gone = [c for c in df.columns if c in set(names) or any(x in c for x in containing)]
    return df.drop(*gone)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating point column."""
    floats = [
        f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: no_nan(F.col(c)) for c in floats})


def classify_columns(df: DataFrame, groups: Mapping[str, Sequence[str]] = AUDIT_GROUPS) -> DataFrame:
    """One row per column and group it belongs to; a column may be in several groups."""
    rows = [
        (name, group)
        for group, fragments in groups.items()
        for name in df.columns
        if any(x in name for x in fragments)
    ]
    return df.sparkSession.createDataFrame(rows, "column_name string, column_group string")
