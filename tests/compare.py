"""Compares a query's rows with its DuckDB SQL over the same Parquet tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf: str = SF) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def _cell(x: object) -> str:
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, bool):
        return str(x)
    return str(x)


def rows_of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(_cell(r[c]) for c in names) for r in df.collect())


def rows_of_sql(c: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    got = c.execute(sql)
    columns = [d[0] for d in got.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[k] for k in order], sorted(tuple(_cell(r[k]) for k in order) for r in got.fetchall())
