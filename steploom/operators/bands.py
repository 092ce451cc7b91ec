"""Bands of rate changes: assignment, distribution per item, step and segment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from steploom.functions.text import col, free_name, quote
from steploom.operators.filters import filter_segments
from steploom.specs import MISSING, NB, OUT_OF_RANGE, RN, Band, Comparison, SpecError, Step, check_bands


def _labels(bands: Sequence[Band]) -> list[str]:
    """Band names by position, followed by the two labels for values outside all bands."""
    names = [band.name for band in bands]
    return names + [label for label in (MISSING, OUT_OF_RANGE) if label not in names]


def band_order(value: Column, bands: Sequence[Band]) -> Column:
    """Position of the value's band; a band holds its start and ends before the next start."""
    labels = _labels(bands)
    value = value.cast("double")
    order = F.when(value.isNull() | F.isnan(value), labels.index(MISSING)).when(
        (value < bands[0].start) | (value == float("inf")), labels.index(OUT_OF_RANGE)
    )
    for n in range(len(bands) - 1, 0, -1):
        order = order.when(value >= bands[n].start, n)
    return order.otherwise(0)


def band_name(value: Column, bands: Sequence[Band]) -> Column:
    return F.element_at(F.array(*[F.lit(label) for label in _labels(bands)]), band_order(value, bands) + 1)


def assign_band(df: DataFrame, column: str, bands: Sequence[Band], into: str = "band") -> DataFrame:
    """The table with the band name of one numeric column added."""
    return df.withColumn(into, band_name(col(column), check_bands(bands)))


def _percentage(count: Column, total: Column) -> Column:
    """Share in percent, two decimals, half-even on the scaled double; 0 for an empty table."""
    share = F.try_divide(count.cast("double"), total.cast("double")) * 100
    return F.coalesce(F.rint(share * 100) / 100, F.lit(0.0))


def _counts(df: DataFrame, columns: Sequence[str], bands: Sequence[Band]) -> DataFrame:
    """``series, band_order, count`` for all columns in one pass; the keys are small integers."""
    orders = F.array(*[band_order(col(name), bands) for name in columns]).cast("array<int>")
    return (
        df.select(F.posexplode(orders).alias("series", "band_order"))
        .groupBy("series", "band_order")
        .agg(F.count(F.lit(1)).alias("count"))
    )


SERIES_KEYS = ("item", "step", "step_name", "segment")


def _frame(spark: SparkSession, bands: Sequence[Band], series: Sequence[dict]) -> DataFrame:
    rows = [
        {"series": n, **keys, "band_order": order, "band": label, "configured": order < len(bands)}
        for n, keys in enumerate(series)
        for order, label in enumerate(_labels(bands))
    ]
    schema = pa.schema(
        [("series", pa.int32())]
        + [(name, pa.int32() if name == "step" else pa.string()) for name in (series[0] if series else SERIES_KEYS)]
        + [("band_order", pa.int32()), ("band", pa.string()), ("configured", pa.bool_())]
    )
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def _filled(df: DataFrame, columns: Sequence[str], bands: Sequence[Band], series: Sequence[dict]) -> DataFrame:
    """Counts and percentages with every configured band present, other labels only if used."""
    bands = check_bands(bands)
    return _shares(_counts(df, columns, bands), bands, series)


def _shares(counts: DataFrame, bands: Sequence[Band], series: Sequence[dict]) -> DataFrame:
    """``series, band_order, count`` zero-filled, with percentages of each series."""
    total = F.sum("count").over(Window.partitionBy("series"))
    return (
        _frame(counts.sparkSession, bands, series)
        # At most one row per series and label, whatever the size of the data.
        .join(F.broadcast(counts), ["series", "band_order"], "left")
        .withColumn("count", F.coalesce("count", F.lit(0)))
        .withColumn("percentage", _percentage(F.col("count"), total))
        .filter(F.col("configured") | (F.col("count") > 0))
        .select(*(series[0] if series else SERIES_KEYS), "band_order", "band", "count", "percentage")
    )


def band_distribution(df: DataFrame, column: str, bands: Sequence[Band]) -> DataFrame:
    """``band, count, percentage`` of the bands that occur; shares are of all rows, nulls included."""
    filled = _filled(df, [column], bands, [{}])
    return filled.filter(F.col("count") > 0).select("band", "count", "percentage")


def band_zero_fill(df: DataFrame, column: str, bands: Sequence[Band]) -> DataFrame:
    """``band_order, band, count, percentage`` with every configured band in configured order."""
    return _filled(df, [column], bands, [{}]).orderBy("band_order")


def _series(step: Step) -> dict:
    return {"item": step.item, "step": step.number, "step_name": step.name, "segment": step.segment}


def distribution(
    df: DataFrame, comparison: Comparison, bands: Sequence[Band], segments: Sequence[str] = (NB,)
) -> DataFrame:
    """Zero-filled distribution of every item, step and segment, counted in one pass and one shuffle.

    Without any step (items of a single stage) it has no rows.
    """
    steps = comparison.all_steps(segments)
    return _filled(df, [step.percent_column for step in steps], bands, [_series(step) for step in steps])


def distribution_renewal(df: DataFrame, comparison: Comparison, bands: Sequence[Band]) -> DataFrame:
    """New-business and renewal distribution side by side, for every new-business step.

    Renewal count and percentage are null for steps without a renewal version, 0 for bands that are empty there.
    """
    steps = comparison.all_steps((NB, RN))
    renewed = {(step.item, step.number) for step in comparison.all_steps((RN,))}
    series = [{**_series(step), "renewed": str((step.item, step.number) in renewed)} for step in steps]
    long = _filled(df, [step.percent_column for step in steps], bands, series)
    if not series:
        long = long.withColumn("renewed", F.lit(None).cast("string"))
    paired = (
        long.groupBy("item", "step", "step_name", "renewed", "band_order", "band")
        .pivot("segment", [NB, RN])
        .agg(F.first("count").alias("count"), F.first("percentage").alias("percentage"))
    )

    def metric(segment: str, name: str) -> Column:
        value = F.coalesce(f"{segment}_{name}", F.lit(0))
        return F.when(F.col("renewed") == "True", value) if segment == RN else value

    return paired.select(
        "item",
        "step",
        "step_name",
        "band_order",
        "band",
        *[metric(s, m).alias(f"{s.lower()}_{m}") for s in (NB, RN) for m in ("count", "percentage")],
    )


@dataclass(frozen=True)
class BandCounts:
    """Band counts for each combination of some columns' values: every distribution under filters on these columns.

    ``counts`` has the columns and, under free names, series, band position and number of rows. It may be written and read back,
    and then answers each later filter without the merged rows. It has at most (combinations x series x labels) rows, so
    choose columns of few values.
    """

    counts: DataFrame
    comparison: Comparison
    bands: tuple[Band, ...]
    columns: tuple[str, ...]
    segments: tuple[str, ...] = (NB,)

    def on(self, counts: DataFrame) -> BandCounts:
        """The same with the table as it was read back."""
        return BandCounts(counts, self.comparison, self.bands, self.columns, self.segments)

    def distribution(self, filters: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
        """As :func:`distribution` of the rows that match; filters on columns that were not counted are refused."""
        chosen = {name: values for name, values in (filters or {}).items() if values}
        unknown = sorted(set(chosen) - set(self.columns))
        if unknown:
            raise SpecError(f"not counted by {', '.join(unknown)}; count the merged rows again with these columns")
        series, order, n = (col(name) for name in _count_names(self.columns))
        counts = (
            filter_segments(self.counts, chosen)
            .groupBy(series.alias("series"), order.alias("band_order"))
            .agg(F.sum(n).alias("count"))
        )
        return _shares(counts, self.bands, [_series(step) for step in self.comparison.all_steps(self.segments)])


def _count_names(columns: Sequence[str]) -> list[str]:
    return [free_name(name, columns) for name in ("series", "band_order", "count")]


def count_bands(
    df: DataFrame, comparison: Comparison, bands: Sequence[Band], columns: Sequence[str], segments: Sequence[str] = (NB,)
) -> BandCounts:
    """Count the bands of all items, steps and segments for each combination of ``columns``, in one pass and one shuffle.

    Rows are counted before the shuffle, so a combination that holds most rows costs no more than others. Nulls are a value of
    their own.
    """
    bands, columns = check_bands(bands), tuple(dict.fromkeys(columns))
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise SpecError(f"column not found: {', '.join(missing)}")
    series, order, n = _count_names(columns)
    orders = [band_order(col(step.percent_column), bands) for step in comparison.all_steps(segments)]
    counts = (
        df.select(*[quote(name) for name in columns], F.posexplode(F.array(*orders).cast("array<int>")).alias(series, order))
        .groupBy(*[quote(name) for name in columns], quote(series), quote(order))
        .agg(F.count(F.lit(1)).alias(n))
    )
    return BandCounts(counts, comparison, tuple(bands), columns, tuple(segments))
