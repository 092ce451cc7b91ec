"""Run a query and its SQL on the same tables and compare rows, regardless of order."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

from suite.oracle import ORACLE
from suite.queries import QUERIES

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _cell(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _rows(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(name).to_pylist() for name in names]
    rows = [tuple(_cell(value) for value in row) for row in zip(*columns)]
    return sorted(rows, key=lambda row: tuple((value is None, str(value)) for value in row))


def differences(spark: SparkSession, connection, sf_dir: str, name: str) -> list[str]:
    """What differs between the query and its SQL; empty when they agree exactly."""
    got = QUERIES[name](spark, sf_dir).toArrow()
    want = connection.execute(ORACLE[name]).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return [f"columns {sorted(got.column_names)} instead of {sorted(want.column_names)}"]
    mine, theirs = _rows(got), _rows(want)
    found = [] if len(mine) == len(theirs) else [f"{len(mine)} rows instead of {len(theirs)}"]
    found += [f"{a} instead of {b}" for a, b in zip(mine, theirs) if a != b][:5]
    for column in got.column_names:
        a, b = str(got.schema.field(column).type), str(want.schema.field(column).type)
        if {a, b} != {"large_string", "string"} and a != b:
            found.append(f"type of {column}: {a} instead of {b}")
    return found
