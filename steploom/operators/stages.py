"""Staged tables: first row per ID, stage columns, and the merge of all stages on the ID."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steploom.functions.text import col, free_name, is_blank, nan_to_null, quote
from steploom.specs import Comparison, SpecError

OrderBy = Sequence[str | Column]


def _require(df: DataFrame, names: Sequence[str], where: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise SpecError(f"{where} has no column {', '.join(missing)}")


def _orderable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.MapType, T.VariantType))


def _full_order(df: DataFrame, id_column: str, order_by: OrderBy) -> list[str | Column]:
    """The given order, then every other column, so that ties give one and the same row on any re-run."""
    if not order_by:
        raise SpecError("order_by is needed: a DataFrame has no row order of its own")
    given = {id_column, *(key for key in order_by if isinstance(key, str))}
    rest = [field.name for field in df.schema if field.name not in given and _orderable(field.dataType)]
    return [quote(key) if isinstance(key, str) else key for key in order_by] + [quote(name) for name in rest]


def first_row_per_id(df: DataFrame, id_column: str, order_by: OrderBy) -> DataFrame:
    """The first row of each ID in the given order; all null IDs are one ID.

    ``row_number() = 1`` is planned with a group limit before the shuffle, so a task sends on at
    most one row per ID however many copies it holds.
    """
    _require(df, [id_column], "table")
    window = Window.partitionBy(quote(id_column)).orderBy(*_full_order(df, id_column, order_by))
    row = free_name("_row", df.columns)
    return df.withColumn(row, F.row_number().over(window)).filter(F.col(row) == 1).drop(row)


def _number(value: Column, dtype: T.DataType) -> Column:
    return value.cast("double") if isinstance(dtype, T.StringType) else nan_to_null(value, dtype)


def stage_columns(
    df: DataFrame, comparison: Comparison, table: str, keep: Sequence[str] | None = None
) -> DataFrame:
    """ID and ``{item}_{stage}`` columns of one table; the base table keeps its other columns too.

    ``keep`` limits the other columns of the base table, and with that what is scanned and shuffled.
    """
    wanted = [(source, name) for owner, source, name in comparison.stage_columns if owner == table]
    sources = [source for source, _ in wanted]
    _require(df, [comparison.id_column, *sources], f"table {table!r}")
    others = []
    if table == comparison.base_table:
        free = [name for name in df.columns if name not in {comparison.id_column, *sources}]
        if keep is not None:
            # A kept source column stays under its own name beside its stage columns.
            _require(df, keep, f"table {table!r}")
            free = [name for name in df.columns if name in set(keep) - {comparison.id_column}]
        others = free
        clash = sorted(set(others) & {name for _, _, name in comparison.stage_columns})
        if clash:
            raise SpecError(f"table {table!r} already has a column {', '.join(clash)}")
    types = df.schema
    return df.select(
        quote(comparison.id_column),
        *[quote(name) for name in others],
        *[_number(col(source), types[source].dataType).alias(name) for source, name in wanted],
    )


def _order_for(order_by: OrderBy | Mapping[str, OrderBy], table: str) -> OrderBy:
    if isinstance(order_by, Mapping):
        if table not in order_by:
            raise SpecError(f"no order_by for table {table!r}")
        return order_by[table]
    return order_by


def _narrowed(
    df: DataFrame, comparison: Comparison, table: str, order_by: OrderBy, keep: Sequence[str] | None
) -> DataFrame:
    """Only the columns that the merge and the order need, so that ties are not broken on others."""
    needed = {source for owner, source, _ in comparison.stage_columns if owner == table}
    needed |= {comparison.id_column, *(key for key in order_by if isinstance(key, str))}
    _require(df, sorted(needed), f"table {table!r}")
    if any(not isinstance(key, str) for key in order_by):
        return df
    if table == comparison.base_table:
        if keep is None:
            return df
        needed |= set(keep)
    return df.select([quote(name) for name in df.columns if name in needed])


def blank_to_null(df: DataFrame) -> DataFrame:
    """Whitespace-only text becomes null; other text keeps its blanks."""
    return df.select(
        [
            F.when(~is_blank(col(field.name)), col(field.name)).alias(field.name)
            if isinstance(field.dataType, T.StringType)
            else quote(field.name)
            for field in df.schema
        ]
    )


# What stands for a missing ID beside the column that tells whether it is missing.
def _no_id(dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.NumericType, T.StringType)):
        return F.lit("0" if isinstance(dtype, T.NumericType) else "").cast(dtype)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("2000-01-01").cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    if isinstance(dtype, T.BinaryType):
        return F.lit(b"")
    raise SpecError(f"an ID of type {dtype.simpleString()} cannot be null; state ids_not_null=True")


#: The columns that a clustered stage is bucketed by: the ID or a default of its type, and whether it is null.
CLUSTER_KEY, CLUSTER_NULL = "_stage_key", "_stage_key_null"


def first_rows_keyed(df: DataFrame, id_column: str, order_by: OrderBy) -> DataFrame:
    """The first row per ID with the two columns of a clustered stage; the key's metadata name the ID column."""
    _require(df, [id_column], "table")
    taken = {CLUSTER_KEY, CLUSTER_NULL} & {name.lower() for name in df.columns}
    if taken:
        raise SpecError(f"the table already has a column {', '.join(sorted(taken))}")
    dtype = df.schema[id_column].dataType
    keyed = df.select(
        "*",
        F.coalesce(col(id_column), _no_id(dtype)).alias(CLUSTER_KEY, metadata={"id_column": id_column}),
        col(id_column).isNull().alias(CLUSTER_NULL),
    )
    row = free_name("_row", keyed.columns)
    window = Window.partitionBy(CLUSTER_KEY, CLUSTER_NULL).orderBy(*_full_order(df, id_column, order_by))
    return keyed.withColumn(row, F.row_number().over(window)).filter(F.col(row) == 1).drop(row)


def is_clustered(df: DataFrame, id_column: str) -> bool:
    """Whether the table was written by ``sink_stage`` for this ID column."""
    fields = {field.name: field for field in df.schema}
    return CLUSTER_NULL in fields and CLUSTER_KEY in fields and fields[CLUSTER_KEY].metadata.get("id_column") == id_column


def _merge_clustered(tables: Mapping[str, DataFrame], comparison: Comparison, keep: Sequence[str] | None) -> DataFrame:
    """The join of stages that hold one row per ID and are bucketed by the key: no window, and no shuffle of equal bucket counts."""
    on = [CLUSTER_KEY, CLUSTER_NULL]

    def prepared(table: str) -> DataFrame:
        df = tables[table]
        if table == comparison.base_table:
            return stage_columns(df, comparison, table, None if keep is None else [*keep, *on])
        types = df.schema
        wanted = [(source, name) for owner, source, name in comparison.stage_columns if owner == table]
        _require(df, [source for source, _ in wanted], f"table {table!r}")
        return df.select(*on, *[_number(col(source), types[source].dataType).alias(name) for source, name in wanted])

    return reduce(lambda left, right: left.join(right, on, "inner"), [prepared(table) for table in comparison.tables]).drop(*on)


def merge_stages(
    tables: Mapping[str, DataFrame],
    comparison: Comparison,
    order_by: OrderBy | Mapping[str, OrderBy],
    keep: Sequence[str] | None = None,
    ids_not_null: bool = False,
) -> DataFrame:
    """One row per ID that is in every table, with all stage columns.

    Each table is reduced to its first row per ID and joined once, whatever the number of items and stages it serves, with
    one scan and one shuffle. Null IDs match each other: window and joins go by two plain columns, the ID or a
    default of its type, and whether it is null. With ``ids_not_null=True`` they go by the ID alone, and a table that is
    bucketed by the ID is not shuffled at all; rows of null ID are then left out.

    If all tables are stages written by ``sink_stage`` for the same ID, null IDs included, nothing is shuffled or sorted out again:
    they hold the first rows by the order that they were written with, and ``order_by`` is not used.
    """
    missing = [name for name in comparison.tables if name not in tables]
    if missing:
        raise SpecError(f"no table given for {', '.join(missing)}")
    id_column = comparison.id_column
    base = tables[comparison.base_table]
    _require(base, [id_column], f"table {comparison.base_table!r}")
    dtype = base.schema[id_column].dataType
    ordered = [name for _, _, name in comparison.stage_columns]
    if all(is_clustered(tables[name], id_column) and tables[name].schema[CLUSTER_KEY].dataType == dtype for name in comparison.tables):
        merged = _merge_clustered(tables, comparison, keep)
        if ids_not_null:
            merged = merged.filter(col(id_column).isNotNull())
        others = [name for name in merged.columns if name not in set(ordered)]
        return blank_to_null(merged.select([quote(name) for name in others + ordered]))
    tables = {name: df.drop(CLUSTER_KEY, CLUSTER_NULL) if is_clustered(df, id_column) else df for name, df in tables.items()}
    taken = [*(name for df in tables.values() for name in df.columns), *(name for _, _, name in comparison.stage_columns)]
    key, no_id, row = (free_name(name, taken) for name in ("_key", "_key_null", "_row"))
    on = [id_column] if ids_not_null else [key, no_id]

    def prepared(table: str) -> DataFrame:
        order = _order_for(order_by, table)
        narrow = _narrowed(tables[table], comparison, table, order, keep)
        if ids_not_null:
            first = first_row_per_id(narrow.filter(col(id_column).isNotNull()), id_column, order)
            return stage_columns(first, comparison, table, keep)
        keyed = narrow.select(
            "*", F.coalesce(col(id_column).cast(dtype), _no_id(dtype)).alias(key), col(id_column).isNull().alias(no_id)
        )
        window = Window.partitionBy(key, no_id).orderBy(*_full_order(narrow, id_column, order))
        first = keyed.withColumn(row, F.row_number().over(window)).filter(F.col(row) == 1).drop(row)
        if table == comparison.base_table:
            return stage_columns(first, comparison, table, None if keep is None else [*keep, key, no_id])
        types = first.schema
        wanted = [(source, name) for owner, source, name in comparison.stage_columns if owner == table]
        return first.select(key, no_id, *[_number(col(source), types[source].dataType).alias(name) for source, name in wanted])

    merged = reduce(lambda left, right: left.join(right, on, "inner"), [prepared(table) for table in comparison.tables])
    if not ids_not_null:
        merged = merged.drop(*on)
    others = [name for name in merged.columns if name not in set(ordered)]
    return blank_to_null(merged.select([quote(name) for name in others + ordered]))

