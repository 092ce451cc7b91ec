"""Merge stages, derive differences and report on them; the reports can be repeated on filtered rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from steploom.operators.bands import BandCounts, count_bands, distribution
from steploom.operators.diffs import add_differences
from steploom.operators.filters import filter_segments
from steploom.operators.stages import OrderBy, merge_stages
from steploom.operators.summary import (
    breakdown,
    breakdown_rollup,
    comparison_summary,
    item_stage_pivot,
    progression_table,
    waterfall,
)
from steploom.sources.writers import CSV, sink_filtered, sink_impact
from steploom.specs import NB, Band, Comparison, check_bands


@dataclass(frozen=True)
class Impact:
    """Merged rows with difference columns, and the reports on them. Everything is lazy.

    For several reports on the same rows, write ``rows`` once and use :meth:`on` with the table
    read back: each report then scans only the columns it needs.
    """

    rows: DataFrame
    comparison: Comparison
    bands: tuple[Band, ...]

    def on(self, rows: DataFrame) -> Impact:
        return Impact(rows, self.comparison, self.bands)

    def where(self, filters: Mapping[str, Sequence[str]]) -> Impact:
        """The same reports on the rows that match the segment filters."""
        return self.on(filter_segments(self.rows, filters))

    def distribution(self) -> DataFrame:
        return distribution(self.rows, self.comparison, self.bands, self.comparison.segments)

    def band_counts(self, columns: Sequence[str]) -> BandCounts:
        """Counts from which the distribution under any filter on ``columns`` follows without the merged rows."""
        return count_bands(self.rows, self.comparison, self.bands, columns, self.comparison.segments)

    def summary(self) -> DataFrame:
        return comparison_summary(self.rows, self.comparison)

    def item_stages(self, segment: str = NB) -> DataFrame:
        return item_stage_pivot(self.rows, self.comparison, segment)

    def waterfall(self) -> DataFrame:
        return waterfall(self.rows, self.comparison)

    def progression(self) -> DataFrame:
        return progression_table(self.rows, self.comparison)

    def breakdown(self, dimensions: Sequence[str]) -> DataFrame:
        return breakdown(self.rows, self.comparison, dimensions)

    def breakdown_with_totals(self, dimensions: Sequence[str]) -> DataFrame:
        return breakdown_rollup(self.rows, self.comparison, dimensions)

    def write(self, folder: str, file_type: str = CSV) -> dict[str, str]:
        return sink_impact(self.rows, self.comparison, self.bands, folder, file_type)

    def export(
        self,
        item: str,
        step: int,
        low: float,
        high: float,
        folder: str,
        timestamp: str,
        segment: str = NB,
        file_type: str = CSV,
    ) -> str:
        return sink_filtered(
            self.rows, self.comparison, item, step, low, high, folder, timestamp, segment, file_type
        )


def analyse(
    tables: Mapping[str, DataFrame],
    comparison: Comparison,
    bands: Sequence[Band],
    order_by: OrderBy | Mapping[str, OrderBy],
    keep: Sequence[str] | None = None,
) -> Impact:
    """Merge the stage tables and add all difference columns."""
    merged = merge_stages(tables, comparison, order_by, keep)
    return Impact(add_differences(merged, comparison), comparison, check_bands(bands))
