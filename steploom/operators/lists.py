"""List columns: several source columns to one array, joined to text or exploded into rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steploom.functions.text import col, free_name
from steploom.functions.typed import list_elements, parse_float
from steploom.specs import SpecError

SEPARATOR = ";"

Source = tuple[str, Column, T.DataType]


def empty_list() -> Column:
    return F.array().cast("array<string>")


def flags_to_list(sources: Sequence[Source], data_type: str) -> Column:
    """Ordered list of the non-null values; a value that is not of the type is left out."""
    if not sources:
        return empty_list()
    return list_elements(data_type, [(value, dtype) for _, value, dtype in sources])


def flags_to_names(sources: Sequence[Source]) -> Column:
    """Ordered list of the names of the columns that equal 1."""
    if not sources:
        return empty_list()
    return F.array_compact(
        F.array(*[F.when(parse_float(value, dtype) == 1, F.lit(name)) for name, value, dtype in sources])
    )


def list_to_string(items: Column) -> Column:
    return F.array_join(items, SEPARATOR)


def explode_lists(df: DataFrame, id_column: str, list_columns: Sequence[str]) -> DataFrame:
    """One row per position of the longest list.

    The first row keeps every column. Later rows keep the ID and the list items only. A list that
    is too short gives an empty string, and a row without any items stays as one row.
    """
    missing = [name for name in (id_column, *list_columns) if name not in df.columns]
    if missing:
        raise SpecError(f"columns not found: {', '.join(missing)}")
    if not list_columns:
        return df
    lists = {name: F.coalesce(col(name), empty_list()) for name in list_columns}
    position = free_name("_position", df.columns)
    last = F.greatest(F.lit(0), *[F.size(items) - 1 for items in lists.values()])
    exploded = df.select("*", F.explode(F.sequence(F.lit(0), last)).alias(position))

    def output(name: str) -> Column:
        if name in lists:
            return F.coalesce(F.get(lists[name], F.col(position)), F.lit(""))
        if name == id_column:
            return col(name)
        return F.when(F.col(position) == 0, col(name))

    return exploded.select([output(name).alias(name) for name in df.columns])
