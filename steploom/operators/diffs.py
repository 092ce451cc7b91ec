"""Stage-to-stage and overall differences, absolute and as a fraction of the earlier stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steploom.functions.text import col
from steploom.specs import Comparison


def add_differences(merged: DataFrame, comparison: Comparison, segments: Sequence[str] | None = None) -> DataFrame:
    """``diff_…`` and ``percent_diff_…`` columns for every item, segment and step, in one projection.

    A difference is null if either side is null; a fraction is null also when the start is zero.
    """
    added = {}
    for step in comparison.all_steps(segments):
        start, end = col(step.from_column), col(step.to_column)
        difference = end - start
        added[step.diff_column] = difference
        added[step.percent_column] = F.try_divide(difference.cast("double"), start.cast("double"))
    return merged.withColumns(added)
