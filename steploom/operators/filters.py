"""Row filters on segments and on rate changes, and the value lists to choose from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steploom.functions.text import col, display_text, nan_to_null
from steploom.specs import NB, Comparison, SpecError

NA = "NA"


def _chosen(name: str, dtype: T.DataType, values: Sequence[str]) -> Column:
    texts = [str(value) for value in values if value != NA]
    value = nan_to_null(col(name), dtype)
    if isinstance(dtype, T.IntegralType):
        # The same test as on text, in a form that the scan can push down.
        numbers = [int(text) for text in texts if text.lstrip("-").isdecimal() and str(int(text)) == text]
        matches = col(name).isin(numbers) if numbers else F.lit(False)
    else:
        matches = display_text(value, dtype).isin(texts) if texts else F.lit(False)
    if NA not in values:
        return matches
    return (value.isNull() | matches) if texts else value.isNull()


def filter_segments(df: DataFrame, filters: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows that match every filter ``{column: values}``; ``NA`` stands for null.

    Values are compared as text. An empty value list or an unknown column filters nothing.
    """
    tests = [
        _chosen(name, df.schema[name].dataType, values)
        for name, values in filters.items()
        if values and name in df.columns
    ]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def filter_rate_change(
    df: DataFrame, comparison: Comparison, item: str, step: int, low: float, high: float, segment: str = NB
) -> DataFrame:
    """Rows whose fraction of change in the step is from ``low`` to ``high``, both included."""
    column = comparison.step(item, step, segment).percent_column
    if column not in df.columns:
        raise SpecError(f"column not found: {column}")
    return df.filter(col(column).between(low, high))


def check_thresholds(low: float, high: float) -> None:
    if low < -1:
        raise SpecError("the lower threshold must be at least -1")
    if low > high:
        raise SpecError("the lower threshold must not be above the upper one")


def segment_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values as sorted text in ``value``, with ``NA`` last if the column has nulls."""
    if column not in df.columns:
        raise SpecError(f"column not found: {column}")
    dtype = df.schema[column].dataType
    value = nan_to_null(col(column), dtype)
    return (
        df.select(display_text(value, dtype).alias("value"), value.isNull().alias("_null"))
        .distinct()
        .orderBy("_null", "value")
        .select(F.coalesce("value", F.lit(NA)).alias("value"))
    )
