"""Delimited text with line breaks inside quotes, read by many tasks for each file.

Lines are read by byte ranges. Inside a quoted value the number of quotes before it is odd, so sums of the quotes of each
range tell every range whether it starts inside a value, and each line whether a record starts there. Lines of a range are
put together there; only records that reach over the end of a range, at most two pieces for each, meet in a second step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RANGE = ["file", "start"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file, the start of its byte range, its place there, and whether its quotes are odd."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return (
        spark.read.option("lineSep", "\n").text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        .select("*", F.monotonically_increasing_id().alias("at"), (quotes % 2).alias("odd"))
    )


def _joined(lines: str) -> F.Column:
    ordered = F.array_sort(F.collect_list(F.struct("at", lines)))
    return F.array_join(F.transform(ordered, lambda line: line[lines]), "\n")


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each record as ``text`` with its ``file``, and whether it is the file's first one (``first``). Empty lines are left out."""
    lines = _lines(spark, path)
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    ranges = lines.groupBy(*_RANGE).agg(F.sum("odd").alias("odd")).select(*_RANGE, F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy(*_RANGE).orderBy("at")
    earlier = F.coalesce(F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = (
        lines.join(ranges, _RANGE)
        .select(*_RANGE, "at", "value", "odd", ((F.col("before") + earlier) % 2 == 1).alias("inside"))
        .filter(F.col("inside") | ~F.col("value").isin("", "\r"))
    )
    number = F.sum(F.when(F.col("inside"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    pieces = (
        inside.select("*", number.alias("record"))
        .groupBy(*_RANGE, "record")
        .agg(_joined("value").alias("text"), F.sum("odd").alias("odd"), F.min("at").alias("at"))
    )
    # Record 0 of a range goes on from an earlier one; a record of odd quotes goes on in a later one.
    is_open = (F.col("record") == 0) | (F.col("odd") % 2 == 1)
    whole = pieces.filter(~is_open).select(*_RANGE, "record", "text")
    chain = F.sum(F.when(F.col("record") > 0, 1).otherwise(0)).over(
        Window.partitionBy("file").orderBy("start", "record").rowsBetween(Window.unboundedPreceding, 0)
    )
    reaching = (
        pieces.filter(is_open)
        .select("file", F.struct("start", "record").alias("at"), "text", chain.alias("chain"))
        .groupBy("file", "chain")
        .agg(F.min("at").alias("first"), _joined("text").alias("text"))
        .select("file", F.col("first.start").alias("start"), F.col("first.record").alias("record"), "text")
    )
    first = (F.col("start") == 0) & (F.col("record") == 1)
    return whole.unionByName(reaching).select("file", F.regexp_replace("text", "\r$", "").alias("text"), first.alias("first"))


def split_records(spark: SparkSession, path: str, columns: Sequence[str], delimiter: str) -> DataFrame:
    """The records under ``columns``, all text. A record, or a file's header, that does not fit fails the job.

    Files of the folder without a record give no rows. A quote that is never closed makes the rest of its file one record.
    """
    schema = ", ".join(f"c{n} string" for n in range(len(columns)))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "FAILFAST", "multiLine": "true"}
    records = record_texts(spark, path)
    fields = F.from_csv("text", schema, options)
    # The byte order mark, if there is one, is no part of the first name.
    header = F.split(F.regexp_replace(F.lower("text"), '^\ufeff|"', ""), F.lit("\\Q" + delimiter + "\\E"), -1)
    expected = F.array(*[F.lit(name.lower().replace('"', "")) for name in columns])
    plain = all(not set(name) & {delimiter, "\n", "\r"} for name in columns)
    wrong = F.col("first") & (header != expected) if plain else F.lit(False)
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("header does not fit: "), "text", F.lit(" in "), "file"))).otherwise(fields)
    rows = records.select("first", checked.alias("fields")).filter(~F.col("first") | F.col("fields").isNull())
    return rows.select([F.col(f"fields.c{n}").alias(name) for n, name in enumerate(columns)])
