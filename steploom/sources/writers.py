"""Writers for converted tables, analysis results and filtered rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steploom.functions.text import col
from steploom.operators.bands import distribution
from steploom.operators.filters import check_thresholds, filter_rate_change
from steploom.operators.lists import list_to_string
from steploom.operators.stages import CLUSTER_KEY, CLUSTER_NULL, OrderBy, first_rows_keyed
from steploom.operators.summary import item_stage_pivot
from steploom.sources.versions import KEEP, TABLE, publish, version_path
from steploom.specs import NB, Band, Comparison, SpecError, check_bands

CSV, PARQUET = "csv", "parquet"
#: The tables of a version that ``sink_impact`` writes.
IMPACT_TABLES = ("merged_data", "summary_table", "band_distribution")


def _write(df: DataFrame, path: str, file_type: str) -> None:
    if file_type == PARQUET:
        df.write.parquet(path)
        return
    arrays = {f.name: list_to_string(col(f.name)) for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    writer = (
        df.withColumns(arrays)
        .write.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    writer.csv(path)


def _check_type(file_type: str) -> None:
    if file_type not in (CSV, PARQUET):
        raise SpecError(f"file type must be {CSV} or {PARQUET}, not {file_type!r}")


def write_table(df: DataFrame, path: str, file_type: str = CSV, keep: int = KEEP) -> str:
    """Publish ``df`` as the current version of the table ``path``; returns where that version is.

    An earlier version stays current until the new one is whole, and readable until ``keep`` later ones are there. The readers
    of this package take ``path`` itself; others take what ``versions.current`` says, or the path returned.
    """
    _check_type(file_type)
    version = publish(df.sparkSession, path, lambda place: _write(df, place(TABLE), file_type), keep)
    return version_path(path, version)


def sink_converted(df: DataFrame, path: str, file_type: str = CSV) -> str:
    """Write with upper-case headers, as ``write_table``."""
    return write_table(df.toDF(*[name.upper() for name in df.columns]), path, file_type)


def sink_stage(df: DataFrame, name: str, id_column: str, order_by: OrderBy, buckets: int, path: str | None = None) -> str:
    """Write the first row per ID as the catalog table ``name``, in ``buckets`` buckets by the ID and whether it is null.

    ``merge_stages`` joins such tables, null IDs too, without a shuffle if their bucket counts are equal; ``scan_stages`` finds
    them by name. Only first rows are stored, so an ID that holds a third of all rows fills no bucket. A table of that name
    must not exist. With ``path`` the files stand there, else in the warehouse.
    """
    if buckets < 1:
        raise SpecError("buckets must be at least 1")
    rows = first_rows_keyed(df, id_column, order_by).repartition(buckets, CLUSTER_KEY, CLUSTER_NULL)
    writer = rows.write.format("parquet").bucketBy(buckets, CLUSTER_KEY, CLUSTER_NULL).sortBy(CLUSTER_KEY, CLUSTER_NULL)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return name


def band_table(df: DataFrame, comparison: Comparison, bands: Sequence[Band], segments: Sequence[str] = (NB,)) -> DataFrame:
    """The distribution under its report headers."""
    rows = distribution(df, comparison, bands, segments)
    return rows.select(
        F.col("item").alias("Item"),
        F.col("step").alias("Step"),
        F.col("step_name").alias("StepName"),
        F.col("segment").alias("Segment"),
        F.col("band").alias("Band"),
        F.col("count").alias("Count"),
        F.col("percentage").alias("Percentage"),
    )


def sink_impact(
    df: DataFrame, comparison: Comparison, bands: Sequence[Band], folder: str, file_type: str = CSV
) -> dict[str, str]:
    """Write merged rows, item-by-stage totals and band distribution; returns their paths.

    The three tables are one version of ``folder``: if any of them fails, all of an earlier version stay current. Merged rows
    are computed once, as parquet; all else reads that. For CSV they stand beside the other tables, as ``merged_rows``: CSV
    would lose the types of the stage columns.
    """
    _check_type(file_type)
    bands, spark = check_bands(bands), df.sparkSession

    def write(place: Callable[[str], str]) -> None:
        rows = place("merged_data" if file_type == PARQUET else "merged_rows")
        _write(df, rows, PARQUET)
        source = spark.read.parquet(rows)
        if file_type != PARQUET:
            _write(source, place("merged_data"), file_type)
        totals = item_stage_pivot(source, comparison).withColumnRenamed("item", "Item")
        _write(totals, place("summary_table"), file_type)
        _write(band_table(source, comparison, bands), place("band_distribution"), file_type)

    version = publish(spark, folder, write)
    return {name: version_path(folder, version, name) for name in IMPACT_TABLES}


def filtered_name(comparison: Comparison, item: str, step: int, segment: str, timestamp: str) -> str:
    def clean(text: str) -> str:
        return text.replace(" ", "_").replace("/", "_")

    name = comparison.step(item, step, segment).name
    return f"filtered_data_{clean(item)}_{clean(name)}_{segment}_{timestamp}"


def sink_filtered(
    df: DataFrame,
    comparison: Comparison,
    item: str,
    step: int,
    low: float,
    high: float,
    folder: str,
    timestamp: str,
    segment: str = NB,
    file_type: str = CSV,
) -> str:
    """Publish the rows of a rate-change range as a table named after the request; returns the table's path."""
    check_thresholds(low, high)
    path = f"{folder}/{filtered_name(comparison, item, step, segment, timestamp)}"
    write_table(filter_rate_change(df, comparison, item, step, low, high, segment), path, file_type)
    return path
