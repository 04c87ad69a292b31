"""All tables of the pipeline in one Spark job.

``spark-submit sunmelt/plans/outputs.py --grid G --sites S --turbidity T --materials M --out O``
"""

from __future__ import annotations

import argparse
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunmelt import schema
from sunmelt.operators.columns import classify_columns
from sunmelt.operators.filters import CRITICAL, MELTING_MAX, MELTING_MIN
from sunmelt.operators.fuse import label_classes
from sunmelt.operators.grid import assign_sites, slice_grid
from sunmelt.operators.profile import describe, missing_diff, null_profile, observe_stages, observed_stages
from sunmelt.plans.climate import climate_hourly
from sunmelt.plans.fusion import daily_from_climate, fused_hourly, label_map
from sunmelt.plans.materials import (
    filled_materials,
    parse_numbers,
    scored_materials,
    standard_columns,
    suited_materials,
)
from sunmelt.runtime import number_rows, scratch, written_table
from sunmelt.sources.sinks import replace_parts
from sunmelt.sources.tables import read_csv, read_grid, write_table


def with_material_id(materials: DataFrame, name: str = "material_id") -> DataFrame:
    """Number the materials by product name; the order of a source file is not a key."""
    numbered = number_rows(materials, ["product"], name)
    return numbered.withColumn(name, F.col(name).cast("int"))


def build_tables(
    grid: DataFrame, site_dim: DataFrame, turbidity: DataFrame, materials_raw: DataFrame,
    out: str, fmt: str = "parquet", impute_rounds: int | None = None,
    part: Mapping[str, Sequence] | None = None, keep_others: bool = False,
) -> None:
    """Write climate, materials, label map, fused, label classes, daily table and profiles.

    With ``keep_others`` a rerun replaces the cities and years of the hourly tables that its
    grid has, and leaves the others' files as they are; what is not hourly is then made from
    the whole stored climate. The tables must have been written that way from the start.

    ``part`` names what to keep of the grid (box, years, months, days, hours). A grid without
    ``site`` is assigned to the sites whose box holds its cells. Hourly tables have folders
    by city and year, the daily one by city. Each table is written before the next one reads
    it, so no stage is computed twice; what is written in between is deleted at the end.
    """
    with scratch(grid.sparkSession):
        _build(grid, site_dim, turbidity, materials_raw, out, fmt, impute_rounds, part or {}, keep_others)


def _build(
    grid: DataFrame, site_dim: DataFrame, turbidity: DataFrame, materials_raw: DataFrame,
    out: str, fmt: str, impute_rounds: int | None, part: Mapping[str, Sequence], keep_others: bool,
) -> None:
    def save(
        df: DataFrame, name: str, by: Sequence[str] = (), sort: Sequence[str] = ()
    ) -> DataFrame:
        path = f"{out}/{name}"
        if keep_others and by == folders:
            replace_parts(df, path, by, fmt=fmt, sort_by=sort)
            found = df.sparkSession.read.options(header=True, quote='"', escape='"').schema(df.schema).format(fmt).load(path)
            return found.select(*df.columns)
        if fmt != "parquet":
            df = written_table(df)
            write_table(df, path, fmt, by, sort)
            return df
        write_table(df, path, fmt, by, sort)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    folders, hourly = ["city", "year"], ["timestamp"]
    cells = slice_grid(grid, **part)
    if "site" not in cells.columns:
        cells = assign_sites(cells, site_dim)
    climate = save(climate_hourly(cells, site_dim, turbidity), "climate_hourly", folders, hourly)
    parsed = written_table(parse_numbers(standard_columns(materials_raw)))
    in_range = F.col("Tm_melting").between(MELTING_MIN, MELTING_MAX)
    complete = F.lit(True)
    for c in CRITICAL:
        complete = complete & F.col(c).isNotNull()
    counted, seen = observe_stages(filled_materials(materials_raw, impute_rounds), {"in_range": in_range, "complete": complete})
    filled = written_table(counted)
    save(missing_diff(parsed, filled), "materials_missing")
    save(observed_stages(grid.sparkSession, seen), "materials_stages")
    materials = save(with_material_id(scored_materials(suited_materials(filled))), "materials_clean")
    labels = save(label_map(climate, materials), "label_map")
    fused = save(fused_hourly(climate, materials, labels), "fused_hourly", folders, hourly)
    save(label_classes(fused), "label_classes")
    daily = save(
        daily_from_climate(climate, materials, labels, site_dim), "daily_features", ["city"], ["date"]
    )
    save(classify_columns(daily), "daily_columns")
    save(null_profile(daily), "daily_nulls")
    save(describe(materials, quartiles=False), "materials_summary")
    save(describe(climate, ["RRTDHS"], by=["city"]), "heating_index_summary")


def main() -> None:
    parser = argparse.ArgumentParser()
    for name in ("grid", "sites", "turbidity", "materials", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    parser.add_argument("--keep-others", action="store_true")
    parser.add_argument("--box", nargs=4, type=float, metavar=("NORTH", "WEST", "SOUTH", "EAST"))
    for name in ("years", "months", "days", "hours"):
        parser.add_argument(f"--{name}", nargs="+", type=int)
    args = parser.parse_args()
    spark = SparkSession.builder.appName("sunmelt").getOrCreate()
    build_tables(
        read_grid(spark, args.grid),
        read_csv(spark, args.sites, schema.SITE_DIM),
        read_csv(spark, args.turbidity, schema.TURBIDITY),
        read_csv(spark, args.materials),
        args.out,
        args.format,
        keep_others=args.keep_others,
        part={k: getattr(args, k) for k in ("box", "years", "months", "days", "hours") if getattr(args, k)},
    )


if __name__ == "__main__":
    main()
