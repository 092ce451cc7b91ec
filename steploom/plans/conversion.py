"""Scan, check, convert and write one table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from steploom.operators.convert import RAISE, ROWS, VALUES, ValueMaps, convert
from steploom.sources.readers import scan_table
from steploom.sources.writers import CSV, sink_converted
from steploom.specs import ColumnRule


def run_conversion(
    spark: SparkSession,
    input_path: str,
    rules: Iterable[ColumnRule],
    output_path: str,
    value_maps: ValueMaps | None = None,
    *,
    list_format: str = ROWS,
    list_style: str = VALUES,
    on_error: str = RAISE,
    file_type: str = CSV,
    read: Callable[[SparkSession, str], DataFrame] = scan_table,
) -> DataFrame:
    """Convert a stored table in one job; returns the (lazy) converted table.

    ``read`` opens the input, for instance ``functools.partial(scan_csv, delimiter=";", multi_line=True)``. A value that
    stops the job leaves an earlier output as it was.
    """
    converted = convert(
        read(spark, input_path),
        rules,
        value_maps,
        list_format=list_format,
        list_style=list_style,
        on_error=on_error,
    )
    sink_converted(converted, output_path, file_type)
    return converted
