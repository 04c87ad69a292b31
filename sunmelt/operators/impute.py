"""Filling holes of the material table: by rule, by chained random forests, by fallback."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunmelt.functions.text import text_or
from sunmelt.operators import forest
from sunmelt.operators.columns import nan_to_null, present
from sunmelt.operators.filters import fill_when
from sunmelt.runtime import delete_table, written_table

# Rule constants, columns imputed by forests, and the final fallbacks.
FREEZING_BELOW_MELTING = 1.0
OPERATING_ABOVE_MELTING = 30.0
CHAINED_COLUMNS = (
    "TC_both", "TC_liquid", "TC_solid", "Cp_liquid", "Cp_solid", "density_liquid",
    "density_solid", "heat_storage_Wh_kg", "volume_expansion", "flash_point",
)
TREES = 10
ROUNDS = 10
SEED = 42
MIN_ROWS = 5
TOLERANCE = 1e-3
TEXT_COLUMNS = ("flammability", "appearance", "manufacturer", "pcm_type")
FALLBACK = {
    "TC_both": 0.5, "Cp_liquid": 2.2, "Cp_solid": 2.0, "density_liquid": 850.0,
    "density_solid": 900.0, "heat_storage_Wh_kg": 200.0, "volume_expansion": 10.0,
}
LIQUID_FROM_SOLID = {"Cp": 1.1, "density": 0.9}
SOLID_FROM_LIQUID = {"Cp": 0.9, "density": 1.1}


def _or(column: str, *values: Column | float) -> Column:
    fills = [v if isinstance(v, Column) else F.lit(v) for v in values]
    return F.coalesce(F.col(column), *fills)


def rule_fill(df: DataFrame) -> DataFrame:
    """Fills that follow from other columns of the row. Later rules see earlier fills."""
    if "TC_both" not in df.columns:
        df = df.withColumn("TC_both", F.lit(None).cast("double"))
    both_known = F.col("TC_liquid").isNotNull() & F.col("TC_solid").isNotNull()
    df = fill_when(
        df, "TC_both", F.col("TC_both").isNull() & both_known,
        (F.col("TC_liquid") + F.col("TC_solid")) / F.lit(2.0),
    )
    melting = F.col("Tm_melting")
    df = df.withColumns(
        {
            "latent_heat_freezing": _or("latent_heat_freezing", F.col("latent_heat_melting")),
            "Tm_freezing": _or("Tm_freezing", melting - F.lit(FREEZING_BELOW_MELTING)),
            "max_op_temp": _or("max_op_temp", melting + F.lit(OPERATING_ABOVE_MELTING)),
            "cycles_tested": _or("cycles_tested", 0.0),
        }
    )
    return df.withColumn("Tm_nucleation", _or("Tm_nucleation", F.col("Tm_freezing")))


def fallback_fill(df: DataFrame) -> DataFrame:
    """Physical defaults for whatever is still missing, and ``Unknown`` for missing text."""
    df = df.withColumn(
        "TC_both", _or("TC_both", F.col("TC_liquid"), F.col("TC_solid"), FALLBACK["TC_both"])
    )
    df = df.withColumns({c: _or(c, F.col("TC_both")) for c in ("TC_liquid", "TC_solid")})
    for kind in ("Cp", "density"):
        liquid, solid = f"{kind}_liquid", f"{kind}_solid"
        df = df.withColumn(
            liquid, _or(liquid, F.col(solid) * F.lit(LIQUID_FROM_SOLID[kind]), FALLBACK[liquid])
        )
        df = df.withColumn(
            solid, _or(solid, F.col(liquid) * F.lit(SOLID_FROM_LIQUID[kind]), FALLBACK[solid])
        )
    for c in ("heat_storage_Wh_kg", "volume_expansion"):
        df = df.withColumn(c, _or(c, FALLBACK[c]))
    return df.withColumns({c: text_or(F.col(c)) for c in present(df, TEXT_COLUMNS)})


def chained_impute(
    df: DataFrame,
    columns: Sequence[str] = CHAINED_COLUMNS,
    rounds: int = ROUNDS,
    trees: int = TREES,
    max_depth: int = 10,
    seed: int = SEED,
    tolerance: float = TOLERANCE,
    min_rows: int = MIN_ROWS,
    local_rows: int | None = None,
) -> DataFrame:
    """Fill missing cells by chained equations with random forests.

    Holes start at the column mean. In each round every column with holes, fewest first, is
    modelled on all others from the rows where it was observed, and its holes are
    predicted anew. Rounds end early once no cell moves by more than ``tolerance`` times the
    largest observed value. Observed cells never change. Columns without any value stay
    NULL, and tables under ``min_rows`` rows are returned as they are.

    ``max_depth`` bounds the trees. What goes through the rounds is a row number, the columns
    and their hole flags. A round's forests are applied in the jobs that read the table, which
    is written once a round; the table of the round before is deleted. Nodes of more than
    ``local_rows`` rows (``forest.LOCAL_ROWS``) are split by a job a level. The same table gives
    the same fill however it is partitioned, if its nodes are smaller than that and its rows
    are numbered alike. Runs jobs when called.
    """
    columns = present(df, columns)
    whole = written_table(nan_to_null(df).withColumn("_row", F.monotonically_increasing_id()))
    known = [F.count(c).alias(f"_n_{c}") for c in columns]
    means = [F.avg(c).alias(f"_m_{c}") for c in columns]
    largest = [F.max(F.abs(F.col(c))).alias(f"_x_{c}") for c in columns]
    facts = whole.agg(F.count(F.lit(1)).alias("_rows"), *known, *means, *largest).first()
    rows = facts["_rows"]
    columns = [c for c in columns if facts[f"_n_{c}"] > 0]
    holes = sorted(
        (c for c in columns if facts[f"_n_{c}"] < rows), key=lambda c: rows - facts[f"_n_{c}"]
    )
    if rows < min_rows or not holes:
        return whole.drop("_row")
    stop_at = float(tolerance * max(facts[f"_x_{c}"] for c in columns))
    local_rows = local_rows or forest.LOCAL_ROWS

    # "_h_<col>" marks the holes.
    table = whole.select("_row", *columns, *[F.col(c).isNull().alias(f"_h_{c}") for c in holes])
    start = {c: F.coalesce(F.col(c).cast("double"), F.lit(float(facts[f"_m_{c}"]))) for c in columns}
    table = table.withColumns(start)
    if rows <= local_rows:
        table = table.coalesce(1)  # counted to be small
    table = written_table(table)
    edges = forest.bin_edges(table, columns) if rows > local_rows else {}
    for turn in range(rounds if len(columns) > 1 else 0):
        models: list[tuple[str, list[str], list[forest.Tree]]] = []
        for place, target in enumerate(holes):
            others = [c for c in columns if c != target]
            grown = forest.fit_forest(
                table, _filler(models, target), others, target, "_known", edges, facts[f"_n_{target}"],
                float(facts[f"_m_{target}"]), trees, max_depth, seed + 1_000 * turn + place, local_rows,
            )
            if grown:
                models.append((target, others, grown))
        table, before = written_table(_filled(table, models)), table
        moved = table.agg(F.max("_moved")).first()[0]
        delete_table(before)
        table = table.drop("_moved")
        if moved < stop_at:
            break
    filled = table.select("_row", *[F.col(c).alias(f"_f_{c}") for c in holes])
    value = {c: F.coalesce(F.col(c).cast("double"), F.col(f"_f_{c}")) for c in holes}
    return whole.join(filled, "_row").withColumns(value).select(*df.columns)


def _filler(models: Sequence[tuple[str, list[str], list[forest.Tree]]], target: str | None = None) -> forest.Reader:
    """Reads a batch and predicts the holes of the modelled columns, one after the other;
    ``_known`` are the rows where ``target`` was observed."""
    models = list(models)

    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        values = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        for name, others, trees in models:
            at = np.flatnonzero(values[f"_h_{name}"])
            if len(at):
                values[name] = values[name].copy()
                values[name][at] = forest.predict(trees, np.stack([values[c][at] for c in others], axis=1))
        if target is not None:
            values["_known"] = ~values[f"_h_{target}"].astype(bool)
        return values

    return read


def _filled(table: DataFrame, models: Sequence[tuple[str, list[str], list[forest.Tree]]]) -> DataFrame:
    """The table after a round; ``_moved`` is the farthest that a cell of the row moved."""
    read, names = _filler(models), table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = read(batch)
            moved = np.zeros(batch.num_rows)
            for name, _, _ in models:
                moved = np.maximum(moved, np.abs(values[name] - batch.column(name).to_numpy()))
            columns = [pa.array(values[n]) if n in changed else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(moved)], names=[*names, "_moved"])

    changed = {name for name, _, _ in models}
    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
    return table.mapInArrow(run, f"{layout}, _moved double")
