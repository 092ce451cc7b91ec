"""Stage totals and the reports derived from them, and breakdowns by segment.

Totals come from one global aggregate; the reports are arithmetic on its single row. Sums of decimals are exact anyway;
those of doubles are exact and rounded once (``functions.exact``), so they are the same whatever the partitions.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steploom.functions.exact import exact_parts, exact_totals, totals_of_parts
from steploom.functions.text import col, free_name
from steploom.specs import NB, RN, Comparison, SpecError

FINAL = "Final"
DETAIL, GRAND_TOTAL = "detail", "grand_total"

def _sum(name: str) -> Column:
    """Sum that skips nulls; 0 for an all-null column."""
    return F.coalesce(F.sum(col(name)), F.lit(0))


def _is_binary(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def stage_totals(df: DataFrame, comparison: Comparison, segment: str = NB) -> DataFrame:
    """One row with the total of every stage column of the segment, under the column's name."""
    found = [comparison.column(rule, segment) for item in comparison.items for rule in comparison.stages(item)]
    names = list(dict.fromkeys(name for name in found if name is not None))
    if not names:
        return df.agg(F.lit(0).alias("no_stage_columns"))
    doubles = [name for name in names if _is_binary(df, name)]
    others = [name for name in names if name not in doubles]
    plain = df.agg(*[_sum(name).alias(name) for name in others]) if others else None
    if not doubles:
        return plain
    exact = exact_totals(df, {name: col(name) for name in doubles})
    if plain is None:
        return exact
    # Two tables of one row each become one row.
    rows = plain.select(F.struct("*").alias("plain"), F.lit(None).cast(exact.schema).alias("exact")).unionAll(
        exact.select(F.lit(None).cast(plain.schema), F.struct("*"))
    )
    both = rows.agg(F.max("plain").alias("plain"), F.max("exact").alias("exact"))
    return both.select(*[F.col("exact" if name in doubles else "plain")[name].alias(name) for name in names])


def _stack(row: DataFrame, names: Sequence[str], rows: Sequence[Sequence]) -> DataFrame:
    """Several output rows from a one-row table."""
    entries = [
        F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(name) for name, v in zip(names, values)])
        for values in rows
    ]
    return row.select(F.inline(F.array(*entries)))


class _Stage(NamedTuple):
    name: str
    total: Column
    change: Column
    total_share: Column
    change_share: Column


def _report(comparison: Comparison) -> dict[str, list[_Stage]]:
    """Per item, the metrics of its stages as expressions on the totals row."""
    report = {}
    for item in comparison.items:
        rules = comparison.stages(item)
        totals = [col(comparison.column(rule)) for rule in rules]
        first = totals[0].cast("double")
        stages = []
        for n, (rule, total) in enumerate(zip(rules, totals)):
            change = (total - totals[n - 1]).cast("double") if n else F.lit(0.0)
            change_share = F.try_divide(change, first) if n else F.lit(0.0)
            value = total.cast("double")
            stages.append(_Stage(rule.stage_name, value, change, F.try_divide(value, first), change_share))
        report[item] = stages
    return report


def comparison_summary(df: DataFrame, comparison: Comparison) -> DataFrame:
    """Per item and stage: total, change from the stage before, and both as shares of the first total."""
    rows = [
        (item, n, stage.name, stage.total, stage.change, stage.total_share, stage.change_share)
        for item, stages in _report(comparison).items()
        for n, stage in enumerate(stages)
    ]
    names = ["item", "stage_idx", "stage_name", "value_total", "value_diff", "value_total_percent"]
    return _stack(stage_totals(df, comparison), [*names, "value_diff_percent"], rows)


def waterfall(df: DataFrame, comparison: Comparison) -> DataFrame:
    """Per item the first total (100), each step's change in percent of it, and a closing point."""
    rows = []
    for item, stages in _report(comparison).items():
        first, last = comparison.stages(item)[0], comparison.stages(item)[-1]
        moved = (col(comparison.column(last)) - col(comparison.column(first))).cast("double")
        for n, stage in enumerate(stages):
            share = stage.change_share if n else stage.total_share
            rows.append((item, n, stage.name, share * 100, stage.total, stage.change, False))
        rows.append((item, len(stages), FINAL, stages[-1].total_share * 100, stages[-1].total, moved, True))
    names = ["item", "point_order", "point", "percent", "value_total", "value_diff", "is_sum"]
    return _stack(stage_totals(df, comparison), names, rows)


def progression_table(df: DataFrame, comparison: Comparison) -> DataFrame:
    """Metrics as rows and stages as columns, shares in percent; one block of rows per item."""
    metrics = {
        "Total Value": lambda stage: stage.total,
        "Value Difference": lambda stage: stage.change,
        "Difference %": lambda stage: stage.change_share * 100,
        "Total %": lambda stage: stage.total_share * 100,
    }
    rows = []
    for item, stages in _report(comparison).items():
        by_name = {stage.name: stage for stage in stages}
        for n, (metric, pick) in enumerate(metrics.items()):
            cells = [
                pick(by_name[name]) if name in by_name else F.lit(None).cast("double")
                for name in comparison.stage_names()
            ]
            rows.append((item, n, metric, *cells))
    names = ["item", "metric_order", "metric", *comparison.stage_names()]
    return _stack(stage_totals(df, comparison), names, rows)


def item_stage_pivot(df: DataFrame, comparison: Comparison, segment: str = NB) -> DataFrame:
    """Items as rows, stage names as columns, totals as values; 0 where there is no such column.

    Without the renewal option there are no renewal rows.
    """
    names = ["item", *comparison.stage_names()]
    if segment not in comparison.segments:
        nothing = T.StructType([T.StructField(n, T.DoubleType() if k else T.StringType()) for k, n in enumerate(names)])
        return df.sparkSession.createDataFrame([], nothing)
    rows = []
    for item in comparison.items:
        by_name = {}
        for rule in comparison.stages(item):
            name = comparison.column(rule, segment)
            by_name[rule.stage_name] = F.lit(0.0) if name is None else col(name).cast("double")
        rows.append((item, *[by_name.get(name, F.lit(0.0)) for name in comparison.stage_names()]))
    return _stack(stage_totals(df, comparison, segment), names, rows)


def item_stage_pivot_rn(df: DataFrame, comparison: Comparison) -> DataFrame:
    """The same on renewal columns; a stage without one counts as 0."""
    return item_stage_pivot(df, comparison, RN)


def _dimensions(df: DataFrame, dimensions: Sequence[str]) -> list[str]:
    unknown = [name for name in dimensions if name not in df.columns]
    if unknown or not dimensions:
        raise SpecError(f"breakdown columns not found: {', '.join(unknown)}" if unknown else "no breakdown column given")
    return list(dict.fromkeys(dimensions))


class _Names:
    """The names of the breakdown's own columns: a dimension keeps its name, and an own column of that name gets underscores before it."""

    def __init__(self, keys: Sequence[str]) -> None:
        self._taken = list(keys)
        self._given: dict[str, str] = {}

    def __call__(self, name: str) -> str:
        if name not in self._given:
            self._given[name] = free_name(name, self._taken)
            self._taken.append(self._given[name])
        return self._given[name]


def _ends(comparison: Comparison, own: _Names) -> dict[str, str]:
    """The columns of the first and last stage of each item, by the names of their sums."""
    ends = {}
    for n, item in enumerate(comparison.items):
        rules = comparison.stages(item)
        ends[own(f"_start_{n}")], ends[own(f"_end_{n}")] = comparison.column(rules[0]), comparison.column(rules[-1])
    return ends


def _sums(df: DataFrame, comparison: Comparison, dimensions: Sequence[str], own: _Names) -> DataFrame:
    """Start and end totals of all items that aren't doubles and the row count per group, in one aggregate."""
    totals = [_sum(name).alias(total) for total, name in _ends(comparison, own).items() if not _is_binary(df, name)]
    return df.groupBy(*[col(name) for name in dimensions]).agg(*totals, F.count(F.lit(1)).alias(own("_count")))


def _with_exact(sums: DataFrame, exact: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``sums`` with the exact ``names`` of the same ``keys``; 0 for groups without a value."""
    there = exact.toDF(*[f"of_{n}" for n in range(len(keys))], *[f"total_{n}" for n in range(len(names))])
    mine = sums.toDF(*[f"c{n}" for n in range(len(sums.columns))])
    of = {key: mine[f"c{sums.columns.index(key)}"] for key in keys}
    same = [of[key].eqNullSafe(there[f"of_{n}"]) for n, key in enumerate(keys)]
    joined = mine.join(there, same, "left")
    kept = [mine[f"c{n}"].alias(name) for n, name in enumerate(sums.columns)]
    return joined.select(*kept, *[F.coalesce(there[f"total_{n}"], F.lit(0.0)).alias(name) for n, name in enumerate(names)])


def _per_item(sums: DataFrame, comparison: Comparison, keys: Sequence[str], own: _Names) -> DataFrame:
    entries = []
    for n, item in enumerate(comparison.items):
        start, end = col(own(f"_start_{n}")), col(own(f"_end_{n}"))
        difference = end - start
        share = F.try_divide(difference.cast("double"), start.cast("double")) * 100
        entries.append(
            F.struct(
                F.lit(n).alias(own("item_order")),
                F.lit(item).alias(own("item")),
                start.cast("double").alias(own("value_total_start")),
                end.cast("double").alias(own("value_total_end")),
                col(own("_count")).alias(own("policy_count")),
                difference.cast("double").alias(own("value_diff")),
                F.coalesce(share, F.lit(0.0)).alias(own("value_diff_percent")),
            )
        )
    return sums.select(*[col(name) for name in keys], F.inline(F.array(*entries)))


# Column names of the result.
_MEASURES = ("value_total_start", "value_total_end", "policy_count", "value_diff", "value_diff_percent")


def _result(rows: DataFrame, own: _Names, keys: Sequence[str], marks: Sequence[str], order: Sequence[Column]) -> DataFrame:
    names = [*[own(mark) for mark in marks], *keys, *[own(measure) for measure in _MEASURES]]
    return rows.orderBy(col(own("item_order")), *order).select(*[col(name) for name in names])


def breakdown(df: DataFrame, comparison: Comparison, dimensions: Sequence[str]) -> DataFrame:
    """First and last total, row count and change per item and group of any number of columns.

    Null is a group of its own. Sorted by item and dimensions, nulls last. A dimension keeps its name; an own column of the
    result that has the same name, in any case, gets an underscore before it (``_item`` beside a dimension ``item``).
    """
    keys = _dimensions(df, dimensions)
    own = _Names(keys)
    sums = _sums(df, comparison, keys, own)
    doubles = {total: col(name) for total, name in _ends(comparison, own).items() if _is_binary(df, name)}
    if doubles:
        sums = _with_exact(sums, exact_totals(df, doubles, keys), keys, list(doubles))
    rows = _per_item(sums, comparison, keys, own)
    return _result(rows, own, keys, ["item"], [col(name).asc_nulls_last() for name in keys])


def breakdown_rollup(df: DataFrame, comparison: Comparison, dimensions: Sequence[str]) -> DataFrame:
    """The breakdown with subtotals per leading dimensions and a grand total, marked in ``level``. Names as there.

    The rollup runs on the already grouped sums, so the data itself is not expanded per level. The
    grand total is an aggregate of its own on the same groups, and is there also without any rows.
    """
    keys = _dimensions(df, dimensions)
    own = _Names(keys)
    sums = _sums(df, comparison, keys, own)
    grouping = own("_grouping")
    everything = 2 ** len(keys) - 1
    measures = [F.coalesce(F.sum(col(name)), F.lit(0)).alias(name) for name in sums.columns if name not in keys]
    levels = sums.rollup(*[col(name) for name in keys]).agg(*measures, F.grouping_id().alias(grouping))
    total = sums.agg(*measures).select(
        "*",
        *[F.lit(None).cast(sums.schema[name].dataType).alias(name) for name in keys],
        F.lit(everything).cast("bigint").alias(grouping),
    )
    rolled = levels.filter(col(grouping) < everything).unionByName(total)
    doubles = {total: col(name) for total, name in _ends(comparison, own).items() if _is_binary(df, name)}
    if doubles:
        # The parts of each group are summed up per level, and rounded only then.
        parts, by_level = exact_parts(df, list(doubles.values()), keys), []
        for n in range(len(keys) + 1):
            level = totals_of_parts(parts, list(doubles), keys[:n])
            missing = [F.lit(None).cast(sums.schema[name].dataType).alias(name) for name in keys[n:]]
            by_level.append(level.select(F.lit(2 ** (len(keys) - n) - 1).cast("bigint").alias(grouping), *map(col, keys[:n]), *missing, *map(col, doubles)))
        rolled = _with_exact(rolled, functools.reduce(DataFrame.unionByName, by_level), [grouping, *keys], list(doubles))
    level = F.when(col(grouping) == 0, DETAIL).when(col(grouping) == everything, GRAND_TOTAL)
    for n in range(1, len(keys)):
        level = level.when(col(grouping) == 2 ** (len(keys) - n) - 1, f"subtotal_{n}")
    rows = _per_item(rolled.withColumn(own("level"), level), comparison, [own("level"), grouping, *keys], own)
    order = []
    for n, name in enumerate(keys):
        # A subtotal follows the rows it sums up.
        order += [col(grouping).bitwiseAND(2 ** (len(keys) - n - 1)), col(name).asc_nulls_last()]
    return _result(rows, own, keys, ["item", "level"], order)
