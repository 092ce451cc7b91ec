"""Readers: delimited text with missing-value tokens, and stage tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.functions.text import col
from steploom.operators.stages import CLUSTER_KEY
from steploom.sources.split_csv import split_records
from steploom.sources.versions import current
from steploom.specs import Comparison, SpecError

# Texts that stand for a missing value.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


#: For ``multi_line``: large files with line breaks inside quotes are read by many tasks.
SPLIT = "split"


def scan_csv(spark: SparkSession, path: str, delimiter: str = ",", multi_line: bool | str = False) -> DataFrame:
    """A headered delimited table, every column as text, missing-value tokens as null. Of a published table the current version.

    A record that does not fit the header fails the job rather than being cut or padded. Text with
    line breaks inside quotes needs ``multi_line=True``, which reads each file in one task, or ``multi_line=SPLIT``, which
    reads parts of a file side by side. That takes quotes in pairs (a quote inside quotes is doubled, none stands in
    other text) and lines that end in LF or CR LF.
    """
    path = current(spark, path)
    raw = (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("enforceSchema", False)
        .option("columnPruning", False)
        .option("mode", "FAILFAST")
        .option("multiLine", bool(multi_line))
        .csv(path)
    )
    if multi_line == SPLIT:
        raw = split_records(spark, path, raw.columns, delimiter)
    return raw.select([F.when(~col(name).isin(*NA_TOKENS), col(name)).alias(name) for name in raw.columns])


def scan_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by the ending of its path: ``.csv`` (also compressed) and ``.tsv`` as text, ``.parquet`` or none as parquet.

    Of a published table the current version.
    """
    name = path.rstrip("/").rpartition("/")[2].lower()
    if name.endswith((".xlsx", ".xls")):
        raise SpecError(f"workbooks are not read; save {path} as CSV or parquet")
    plain = name.removesuffix(".gz").removesuffix(".bz2")
    if plain.endswith((".csv", ".tsv")):
        return scan_csv(spark, path, "," if plain.endswith(".csv") else "\t")
    if "." in name and not name.endswith(".parquet"):
        raise SpecError(f"no reader for {path}: endings are .csv, .tsv and .parquet; pass a reader of your own")
    return spark.read.parquet(current(spark, path))


def scan_published(spark: SparkSession, folder: str, table: str, file_type: str = "parquet") -> DataFrame:
    """A table of the current version of a set that was published together, such as the three of ``sink_impact``."""
    path = current(spark, folder, table)
    if path == folder:
        raise SpecError(f"nothing is published in {folder}")
    return scan_csv(spark, path) if file_type == "csv" else spark.read.parquet(path)


def scan_stage(spark: SparkSession, table: str) -> DataFrame:
    """A clustered stage of the catalog (see ``sink_stage``) by its name; any other table by its path, as ``scan_table``."""
    if re.fullmatch(r"\w+(\.\w+)?", table) and spark.catalog.tableExists(table):
        stored = spark.table(table)
        if CLUSTER_KEY in stored.columns:
            return stored
    return scan_table(spark, table)


def scan_stages(
    spark: SparkSession, comparison: Comparison, read: Callable[[SparkSession, str], DataFrame] = scan_stage
) -> dict[str, DataFrame]:
    """Each distinct stage table once, however many items and stages use it."""
    return {table: read(spark, table) for table in comparison.tables}
