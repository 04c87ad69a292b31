"""Run queries on Spark and their SQL on DuckDB and compare the results.

``python -m sunmelt.workload.check SF_DIR [name ...]``
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from sunmelt.workload.oracle import oracle_sql
from sunmelt.workload.queries import queries

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _cell(value: object) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, float):
        return repr(value)
    return str(value)


def _rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    columns = [[_cell(v) for v in frame[c].astype(object)] for c in frame.columns]
    return sorted(zip(*columns)) if columns else []


def compare(df: DataFrame, sql: str, sf_dir: str) -> str | None:
    """None if equal, else what differs."""
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    want = con.execute(sql).df()
    got = df.toPandas()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    kinds = [
        c for c in got.columns
        if got[c].dtype.kind != want[c].dtype.kind and {got[c].dtype.kind, want[c].dtype.kind} != {"f", "i"}
        and got[c].notna().any() and "O" not in (got[c].dtype.kind, want[c].dtype.kind)
    ]
    if kinds:
        return "types " + ", ".join(f"{c}: {got[c].dtype} vs {want[c].dtype}" for c in kinds)
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for frame in (got, want):
        for c in frame.columns:
            if "datetime" in str(frame[c].dtype) or c in ("date", "month_start"):
                frame[c] = pd.to_datetime(frame[c])
    a, b = _rows(got), _rows(want)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        names = sorted(got.columns)
        x, y = wrong[0]
        cells = [f"{n}: {p} vs {q}" for n, p, q in zip(names, x, y) if p != q]
        return f"{len(wrong)} of {len(a)} rows, first: {cells[:6]}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sql, bad = oracle_sql(), 0
    for name, build in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in sql:
                problem = compare(df, sql[name], sf_dir)
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
