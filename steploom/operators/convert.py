"""Rule-driven conversion of a table: value maps, typed columns, lists, problem report."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steploom.functions.text import col, display_text, free_name, nan_to_null, strip
from steploom.functions.typed import OPTIONAL, REQUIRED, Conversion
from steploom.operators.columns import check_required, find_column
from steploom.operators.lists import explode_lists, flags_to_list, flags_to_names, list_to_string
from steploom.specs import ColumnRule, SpecError, Target, targets

ROWS, STRING, ARRAY = "list_in_multiple_rows", "list_in_single_string", "array"
VALUES, NAMES = "values", "names"
RAISE, NULL = "raise", "null"

ValueMap = Mapping[str, str] | DataFrame
ValueMaps = Mapping[str, ValueMap]


def value_map_frame(spark: SparkSession, value_map: ValueMap) -> DataFrame:
    """``from, to`` rows, trimmed, one for each ``from``.

    Of equal ``from`` texts of a dict the last stays; of a table, which has no order, that with the greatest ``to``. Rows of
    a table with a null in either column are left out.
    """
    if isinstance(value_map, DataFrame):
        trimmed = value_map.select(*[strip(col(name).cast("string")).alias(name) for name in ("from", "to")])
        return trimmed.filter(F.col("from").isNotNull() & F.col("to").isNotNull()).groupBy("from").agg(F.max("to").alias("to"))
    pairs = {str(old).strip(): str(new).strip() for old, new in value_map.items()}
    # An Arrow table becomes a local relation, so the planner knows its exact size.
    return spark.createDataFrame(
        pa.table({"from": pa.array(list(pairs), pa.string()), "to": pa.array(list(pairs.values()), pa.string())})
    )


def _map_bytes(value_map: ValueMap) -> int:
    """Bytes of a value map; of a table by an aggregate over it."""
    if isinstance(value_map, DataFrame):
        each = F.coalesce(F.octet_length(col("from").cast("string")), F.lit(0)) + F.coalesce(F.octet_length(col("to").cast("string")), F.lit(0))
        return value_map.agg(F.coalesce(F.sum(each.cast("long") + 16), F.lit(0))).head()[0]
    return sum(len(str(a).encode()) + len(str(b).encode()) for a, b in value_map.items())


#: Value maps of up to so many bytes are broadcast, whatever the session's threshold.
BROADCAST_BYTES = 8 << 20
#: A value is hot if about one row of so many has it. There are no more hot values than that.
HOT_SHARE = 100
#: Values that the frequency sketch tracks; it is wrong by less than 4 rows of so many.
TRACKED = 4_096


def hot_values(df: DataFrame, text: Column, name: str) -> DataFrame:
    """The values of ``text`` that about one row of HOT_SHARE or more has, from a frequency sketch in one aggregate: at most
    HOT_SHARE rows and a few, as the sketch counts too many rather than too few."""
    counts = df.agg(F.call_function("approx_top_k", text, F.lit(2 * HOT_SHARE), F.lit(TRACKED)).alias("top"), F.count(text).alias("rows"))
    top = counts.select("rows", F.inline("top"))
    return top.filter(F.col("item").isNotNull() & (F.col("count") * HOT_SHARE >= F.col("rows"))).select(F.col("item").alias(name))


def map_values(
    df: DataFrame, column: str, value_map: ValueMap, into: str | None = None, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Replace values whose trimmed text is in the map; others pass through. The map is a dict, or a table ``from, to``.

    A map of at most ``broadcast_bytes`` is broadcast, so the table is not shuffled. Otherwise the map and the table meet
    by shuffle, but for the table's hot values, found by a frequency sketch: their rows, however many, and the nulls stay
    where they are, and only the map's rows for hot values, a bounded number, are broadcast. So no value, however
    frequent, gathers its rows in one task, whatever other columns (maps too) the table has.
    """
    found = find_column(column, df.columns)
    if found is None:
        raise SpecError(f"column not found: {column}")
    into = into or found
    dtype = df.schema[found].dataType
    text = display_text(col(found), dtype)
    old, new, row, hot = (free_name(name, [*df.columns, into]) for name in ("_from", "_to", "_text", "_hot"))
    lookup = value_map_frame(df.sparkSession, value_map).select(F.col("from").alias(old), F.col("to").alias(new))
    if _map_bytes(value_map) <= broadcast_bytes:
        joined = df.join(F.broadcast(lookup), strip(text) == F.col(old), "left")
        return joined.withColumn(into, F.coalesce(F.col(new), text)).drop(old, new)
    keyed = df.withColumn(row, text)
    key = strip(F.col(row))
    few = hot_values(keyed.select(row), key, hot)
    known = F.broadcast(few).join(lookup, F.col(hot) == F.col(old), "left").select(hot, new)
    in_place = keyed.join(F.broadcast(known), key == F.col(hot), "left").filter(F.col(hot).isNotNull() | F.col(row).isNull())
    others = keyed.filter(F.col(row).isNotNull()).join(F.broadcast(few), key == F.col(hot), "left_anti").join(lookup, key == F.col(old), "left")
    mapped = [part.withColumn(into, F.coalesce(F.col(new), F.col(row))).drop(old, new, row, hot) for part in (in_place, others)]
    return mapped[0].unionByName(mapped[1])


def _with_value_maps(
    df: DataFrame, rules: list[ColumnRule], value_maps: ValueMaps | None
) -> tuple[DataFrame, dict[str, str]]:
    """Mapped copies of the required columns that have a value map: {source: mapped column}."""
    mapped = {}
    headers = df.columns
    for n, target in enumerate(targets(rules)):
        rule = target.rules[0]
        found = find_column(rule.source, headers)
        if target.is_list or rule.optional or found is None or not (value_maps or {}).get(rule.source):
            continue
        mapped[rule.source] = free_name(f"_mapped_{n}", df.columns)
        df = map_values(df, found, value_maps[rule.source], into=mapped[rule.source])
    return df, mapped


def _source(df: DataFrame, name: str) -> tuple[Column, T.DataType]:
    return col(name), df.schema[name].dataType


def _list_column(df: DataFrame, headers: list[str], target: Target, list_style: str) -> Column:
    sources = []
    for rule in target.rules:
        found = find_column(rule.source, headers)
        if found is not None:
            sources.append((rule.source, *_source(df, found)))
    return flags_to_names(sources) if list_style == NAMES else flags_to_list(sources, target.data_type)


class _Typed(NamedTuple):
    rule: ColumnRule
    target: str
    value: Column
    dtype: T.DataType
    conversion: Conversion

    @property
    def can_fail(self) -> bool:
        """Optional CODE and DECIMA take any value."""
        return not (self.rule.optional and self.rule.data_type in ("CODE", "DECIMA"))

    @property
    def text(self) -> Column:
        return display_text(nan_to_null(self.value, self.dtype), self.dtype)


def _with_typed(
    df: DataFrame, rules: list[ColumnRule], value_maps: ValueMaps | None
) -> tuple[DataFrame, list[_Typed]]:
    """The table with the step columns of all single-source targets that are present, and their results.

    Steps are columns, so that what a value and its problem share is computed once.
    """
    headers = df.columns
    df, mapped = _with_value_maps(df, rules, value_maps)
    pending = []
    for n, target in enumerate(targets(rules)):
        rule = target.rules[0]
        found = find_column(rule.source, headers)
        if not target.is_list and found is not None:
            kind = (OPTIONAL if rule.optional else REQUIRED)[rule.data_type]
            pending.append((n, target, *_source(df, mapped.get(rule.source, found)), kind))

    prefix = "_step"
    while any(name.lower().startswith(f"{prefix}_") for name in df.columns):
        prefix = "_" + prefix

    def done(n: int, count: int) -> list[Column]:
        return [F.col(f"{prefix}_{n}_{k}") for k in range(count)]

    for k in range(max((len(kind.steps) for *_, kind in pending), default=0)):
        df = df.withColumns(
            {
                f"{prefix}_{n}_{k}": kind.steps[k](value, dtype, *done(n, k))
                for n, _, value, dtype, kind in pending
                if k < len(kind.steps)
            }
        )
    return df, [
        _Typed(target.rules[0], target.name, value, dtype, kind.result(value, dtype, *done(n, len(kind.steps))))
        for n, target, value, dtype, kind in pending
    ]


def typed_column(
    df: DataFrame, column: str, data_type: str, optional: bool = False, value: str = "value", problem: str = "problem"
) -> DataFrame:
    """The table with one column converted into ``value``, and what is wrong with it in ``problem``."""
    with_steps, [found] = _with_typed(df, [ColumnRule(column, value, data_type, optional=optional)], None)
    return with_steps.select(
        *[col(name) for name in df.columns],
        found.conversion.value.alias(value),
        found.conversion.problem.alias(problem),
    )


def convert_columns(
    df: DataFrame,
    rules: Iterable[ColumnRule],
    value_maps: ValueMaps | None = None,
    *,
    list_style: str = VALUES,
    on_error: str = RAISE,
) -> DataFrame:
    """Typed output columns in rule order; list targets as arrays of text.

    ``on_error="raise"`` stops the job at the first unacceptable value, in the same pass that
    converts; ``"null"`` turns such values into null, to be read with :func:`conversion_errors`.
    """
    if on_error not in (RAISE, NULL):
        raise SpecError(f"on_error must be {RAISE} or {NULL}, not {on_error!r}")
    if list_style not in (VALUES, NAMES):
        raise SpecError(f"list_style must be {VALUES} or {NAMES}, not {list_style!r}")
    rules = list(rules)
    check_required(df, rules)
    headers = df.columns
    df, found = _with_typed(df, rules, value_maps)
    columns = {
        entry.target: _or_stop(entry) if on_error == RAISE else entry.conversion.value for entry in found
    }
    for target in targets(rules):
        if target.is_list:
            columns[target.name] = _list_column(df, headers, target, list_style)
    return df.select([columns[target.name].alias(target.name) for target in targets(rules) if target.name in columns])


def _or_stop(entry: _Typed) -> Column:
    """The value, or an error naming column, type and value.

    The check is part of the value: as a filter it would be moved below the step columns, and
    repeat all of their work.
    """
    if not entry.can_fail:
        return entry.conversion.value
    start = f"column '{entry.rule.source}' as {entry.rule.data_type}: '"
    message = F.concat(F.lit(start), entry.text, F.lit("': "), entry.conversion.problem)
    return F.when(entry.conversion.problem.isNotNull(), F.raise_error(message)).otherwise(entry.conversion.value)


def convert(
    df: DataFrame,
    rules: Iterable[ColumnRule],
    value_maps: ValueMaps | None = None,
    *,
    list_format: str = ROWS,
    list_style: str = VALUES,
    on_error: str = RAISE,
) -> DataFrame:
    """The converted table, with lists exploded into rows, joined by ``;``, or kept as arrays.

    The check of ``on_error="raise"`` is part of each value: it does not run for columns that are not read later. To
    be strict about all columns, write the table or call :func:`check_conversion`.
    """
    rules = list(rules)
    typed_df = convert_columns(df, rules, value_maps, list_style=list_style, on_error=on_error)
    list_targets = [target.name for target in targets(rules) if target.is_list]
    if list_format == ROWS:
        return explode_lists(typed_df, targets(rules)[0].name, list_targets) if list_targets else typed_df
    if list_format == STRING:
        return typed_df.withColumns({name: list_to_string(col(name)) for name in list_targets})
    if list_format == ARRAY:
        return typed_df
    raise SpecError(f"list_format must be {ROWS}, {STRING} or {ARRAY}, not {list_format!r}")


def conversion_errors(
    df: DataFrame, rules: Iterable[ColumnRule], value_maps: ValueMaps | None = None
) -> DataFrame:
    """Every unacceptable value as ``id, column, type, value, reason``; one pass, no shuffle.

    Values of list sources that are not of the list's type, and so are left out of it, are reported too.

    ``id`` is the text of the first rule's source column.
    """
    rules = list(rules)
    check_required(df, rules)
    id_column = find_column(targets(rules)[0].rules[0].source, df.columns)
    id_text = F.lit(None).cast("string") if id_column is None else display_text(*_source(df, id_column))
    headers = df.columns
    df, found = _with_typed(df, rules, value_maps)
    entries = [
        _problem(entry.rule, entry.text, entry.conversion.problem) for entry in found
    ] + _dropped_from_lists(df, headers, rules)
    problems = F.array(*entries) if entries else F.array().cast("array<struct<column:string,type:string,value:string,reason:string>>")
    return (
        df.select(id_text.alias("id"), F.explode(problems).alias("_entry"))
        .select("id", "_entry.*")
        .filter(F.col("reason").isNotNull())
    )


#: Lanes of the sample of :func:`conversion_error_summary`: the first two hexadecimal digits of a value's hash.
LANES = 256


def conversion_error_summary(
    df: DataFrame, rules: Iterable[ColumnRule], value_maps: ValueMaps | None = None, examples: int = 5
) -> DataFrame:
    """The problems by ``column, type, reason``: ``n_values`` exactly, and ``examples``, some different values with an id each.

    A column that is bad throughout gives one row here, where :func:`conversion_errors` gives as many as the table has. The
    sample is mergeable: of the values of a lane (by hash) that with the smallest hash is kept, with its smallest id, and the
    examples are the kept ones of smallest hash. It is the same on any partitioning, copies of a value take one place, and at
    most ``LANES`` rows a task and problem are shuffled. Two values share a lane by a chance of 1 in 256; then only one can
    be an example. A null value counts as empty text. An empty table gives no rows.

    The table is read twice, so that tasks hold sums and not rows: first numbers alone are aggregated, counts and the smallest
    starts of the hashes; then the texts of the few chosen ones. Spark sorts those only beyond 128 examples in all.
    """
    if not 1 <= examples <= LANES:
        raise SpecError(f"examples must be 1 to {LANES}")
    value = F.coalesce("value", F.lit(""))
    digest = F.md5(value.cast("binary"))
    by = ["column", "type", "reason"]
    # 15 hexadecimal digits are a long in the order of the text; never null, or the join would hash each value once more to see.
    start = F.coalesce(F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"), F.lit(0))
    errors = conversion_errors(df, rules, value_maps).select(*by, digest.alias("digest"), value.alias("value"), "id").withColumn("start", start)
    lanes = errors.groupBy(*by, F.substring("digest", 1, 2).alias("lane")).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"))
    starts = F.slice(F.sort_array(F.collect_list("start")), 1, examples)
    totals = lanes.groupBy(*by).agg(F.sum("n").alias("n_values"), starts.alias("starts"))
    chosen = totals.select(*by, "n_values", F.explode("starts").alias("start"))
    # With collect_set Spark aggregates in a hash map; for a minimum of texts alone it would sort all copies of the chosen values.
    same = F.collect_set(F.struct("digest", "value")).alias("same")
    kept = (
        errors.join(F.broadcast(chosen), [*by, "start"])
        .groupBy(*by, "n_values", "start")
        .agg(same, F.min(F.struct("digest", "value", "id")).alias("kept"))
        .select(*by, "n_values", F.struct("start", F.array_min("same")["value"].alias("value"), F.col("kept.id").alias("id")).alias("one"))
    )
    pairs = F.transform(F.sort_array(F.collect_list("one")), lambda one: F.struct(one["value"].alias("value"), one["id"].alias("id")))
    return kept.groupBy(*by, "n_values").agg(pairs.alias("examples"))


def _problem(rule: ColumnRule, text: Column, reason: Column) -> Column:
    return F.struct(
        F.lit(rule.source).alias("column"), F.lit(rule.data_type).alias("type"), text.alias("value"), reason.alias("reason")
    )


def _dropped_from_lists(df: DataFrame, headers: list[str], rules: list[ColumnRule]) -> list[Column]:
    """Values of list sources that are present but not of the type, and so not in the list."""
    entries = []
    for target in targets(rules):
        for rule in target.rules if target.is_list else ():
            found = find_column(rule.source, headers)
            if found is None:
                continue
            value, dtype = _source(df, found)
            present = nan_to_null(value, dtype)
            text = display_text(present, dtype)
            lost = present.isNotNull() & (strip(text) != "") & (F.size(flags_to_list([(rule.source, value, dtype)], target.data_type)) == 0)
            entries.append(_problem(rule, text, F.when(lost, "not in the list: not of the type")))
    return entries


def check_conversion(
    df: DataFrame, rules: Iterable[ColumnRule], value_maps: ValueMaps | None = None
) -> None:
    """Raise on the first unacceptable value found, before anything is written."""
    first = conversion_errors(df, rules, value_maps).limit(1).collect()
    if first:
        bad = first[0]
        raise SpecError(f"column '{bad['column']}' as {bad['type']}: '{bad['value']}': {bad['reason']}")
