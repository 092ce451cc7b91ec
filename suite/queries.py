"""One query per operator, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steploom import ColumnRule, Comparison, StageRule
from steploom.functions.text import col
from steploom.operators import bands, columns, convert, diffs, filters, lists, stages, summary
from steploom.sources import readers, writers
from suite import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, so that results compare across engines."""
    return df.select(
        [
            col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else col(f.name)
            for f in df.schema
        ]
    )


def _money(name: str) -> Column:
    return F.col(name).cast("decimal(12,2)")


# Scans and sinks


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fx.scratch(spark)
    customers = fx.table(spark, sf_dir, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("code"),
        F.when(F.col("c_nationkey") == 3, "N/A").when(F.col("c_nationkey") == 4, "nan")
        .otherwise(F.col("c_mktsegment")).alias("segment"),
        F.concat(F.col("c_name"), F.lit(', "x"')).alias("name"),
        _money("c_acctbal").alias("balance"),
    )
    writers.write_table(customers, path)
    return readers.scan_csv(spark, path)


def scan_csv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks and quotes, read back by several tasks for each file."""
    path = fx.scratch(spark)
    comment = F.concat("o_orderpriority", F.lit('\n"'), "o_orderstatus", F.lit('",\n\n'))
    orders = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("code"),
        F.when(F.col("o_orderkey") % 3 == 0, comment).when(F.col("o_orderkey") % 3 == 1, F.col("o_orderstatus")).alias("comment"),
        F.col("o_custkey").cast("string").alias("customer"),
    )
    writers.write_table(orders, path)
    return readers.scan_csv(spark, path, multi_line=readers.SPLIT)


def scan_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fx.scratch(spark)
    for name, df in fx.stage_tables(spark, sf_dir).items():
        writers.write_table(df, f"{folder}/{name}", writers.PARQUET)
    rules = [
        StageRule(rule.id_column, rule.item, rule.stage, rule.stage_name, f"{folder}/{rule.table}", rule.column)
        for rule in fx.STAGE_RULES
    ]
    comparison = Comparison(rules)
    tables = readers.scan_stages(spark, comparison)
    counts = [
        tables[table].agg(
            F.lit(table.rsplit("/", 1)[1]).alias("stage_table"),
            F.lit(source).alias("source"),
            F.count(F.lit(1)).alias("row_count"),
            F.sum(source).cast("double").alias("total"),
        )
        for table, source, _ in comparison.stage_columns
    ]
    return reduce(DataFrame.unionByName, counts)


def sink_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fx.scratch(spark)
    converted = convert.convert(fx.table(spark, sf_dir, "customer"), fx.CUSTOMER_RULES, fx.SEGMENT_MAP)
    writers.sink_converted(converted.withColumn("BALANCE", _money("BALANCE")), path)
    return readers.scan_csv(spark, path)


def sink_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = fx.impact(spark, sf_dir)
    folder = fx.scratch(spark)
    result.write(folder, writers.PARQUET)
    merged, totals, shares = (readers.scan_published(spark, folder, name) for name in writers.IMPACT_TABLES)
    names = fx.COMPARISON.stage_names()
    pairs = F.array(*[F.struct(F.lit(name).alias("part"), F.col(name).alias("value")) for name in names])
    sums = [F.struct(F.lit(name).alias("part"), F.sum(name).cast("double").alias("value")) for _, _, name in fx.COMPARISON.stage_columns]
    rows = F.struct(F.lit("rows").alias("part"), F.count(F.lit(1)).cast("double").alias("value"))
    return (
        merged.agg(F.array(rows, *sums).alias("parts")).select(F.lit("merged_data").alias("output"), F.inline("parts"))
        .unionByName(
            totals.select("Item", F.inline(pairs)).select(
                F.lit("summary_table").alias("output"), F.concat_ws("/", "Item", "part").alias("part"), "value"
            )
        )
        .unionByName(
            shares.select(
                F.lit("band_distribution").alias("output"),
                F.concat_ws("/", "Item", "Step", "StepName", "Segment", "Band", "Count").alias("part"),
                F.col("Percentage").alias("value"),
            )
        )
    )


def sink_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fx.impact(spark, sf_dir).export(
        "Net", 1, -0.055, -0.015, fx.scratch(spark), "20240101_000000", file_type=writers.PARQUET
    )
    return _plain(readers.scan_table(spark, path).select(fx.ID, "note", "Net_1", "Net_2", "percent_diff_Net_step_1"))


# Projections, renames, schema checks


def resolve_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = fx.table(spark, sf_dir, "customer").toDF("C CUSTKEY", "c_name ", "C_NationKey", "c acctbal", "c_mktsegment")
    return columns.resolve_columns(customers, ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


def check_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing required sources of two rule sets on three tables, beside the tables' row counts."""
    found = []
    for name in ("customer", "supplier", "part"):
        rows = fx.table(spark, sf_dir, name)
        for rule_set, rules in (("customer_rules", fx.CUSTOMER_RULES), ("part_rules", fx.PART_RULES)):
            missing = columns.missing_required(rows, rules)
            found.append(
                rows.agg(
                    F.lit(name).alias("table_name"),
                    F.lit(rule_set).alias("rule_set"),
                    F.lit(",".join(missing)).alias("missing"),
                    F.count(F.lit(1)).alias("row_count"),
                )
            )
    return reduce(DataFrame.unionByName, found)


def project_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return columns.project_mapped(fx.table(spark, sf_dir, "customer"), fx.CUSTOMER_RULES)


def stage_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(stages.stage_columns(fx.stage_tables(spark, sf_dir)["stage_1"], fx.RENEWAL, "stage_1"))


def blank_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.table(spark, sf_dir, "orders").select("o_orderkey", fx.note(F.col("o_orderpriority")).alias("note"))
    return stages.blank_to_null(orders)


# Typed conversion


def _converted(df: DataFrame, keys: list[str], column: str, data_type: str, optional: bool = False) -> DataFrame:
    return convert.typed_column(df, column, data_type, optional).select(*keys, "value", "problem")


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with outer blanks; some in lower case, some too long, some missing."""
    kind = F.col("c_custkey") % 5
    segment = F.col("c_mktsegment")
    return fx.table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(kind == 0, F.concat(F.lit("  "), segment, F.lit(" ")))
        .when(kind == 1, F.lower(segment))
        .when(kind == 2, F.concat(segment, F.lit(" "), segment))
        .when(kind == 3, F.concat(F.lit(" "), F.substring(segment, 1, 4), F.lit(" 12\t")))
        .alias("code"),
    )


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as number text in several spellings; some too long, some not numbers, some missing."""
    kind = F.col("l_partkey") % 8
    price = _money("l_extendedprice").cast("string")
    whole = F.col("l_extendedprice").cast("bigint").cast("string")
    return fx.table(spark, sf_dir, "lineitem").select(
        *fx.LINE_ORDER,
        "l_orderkey",
        F.when(kind == 0, price)
        .when(kind == 1, F.concat(F.lit(" -"), price))
        .when(kind == 2, F.concat(price, F.lit("e8")))
        .when(kind == 3, F.concat(F.lit("x"), price))
        .when(kind == 4, whole)
        .when(kind == 5, F.concat(F.lit("+"), whole, F.lit(".0 ")))
        .when(kind == 6, F.concat(whole, F.lit("0000000")))
        .alias("number"),
    )


_NUMBER_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def code_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(_codes(spark, sf_dir), ["c_custkey"], "code", "CODE")


def intege_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(_numbers(spark, sf_dir), _NUMBER_KEYS, "number", "INTEGE")


def decima_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = fx.table(spark, sf_dir, "lineitem").select(
        *_NUMBER_KEYS,
        (
            F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
            * F.when(F.col("l_partkey") % 4 == 0, 10000.0).otherwise(1.0)
        ).alias("amount"),
    )
    return _converted(amounts, _NUMBER_KEYS, "amount", "DECIMA")


def code_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(_codes(spark, sf_dir), ["c_custkey"], "code", "CODE", optional=True).drop("problem")


def intege_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(_numbers(spark, sf_dir), _NUMBER_KEYS, "number", "INTEGE", optional=True)


def decima_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _converted(_numbers(spark, sf_dir), _NUMBER_KEYS, "number", "DECIMA", optional=True).drop("problem")


def _dates(df: DataFrame, names: list[str]) -> DataFrame:
    rules = [ColumnRule(name, name, "DATE") for name in names]
    keys = [ColumnRule(name, name, "INTEGE", optional=True) for name in ("l_orderkey", "l_linenumber")]
    dates = convert.convert_columns(df, keys + rules)
    return dates.toDF("l_orderkey", "l_linenumber", *names)


def date_slash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(fx.ship_dates(spark, sf_dir), ["slash_text"])


def date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(fx.ship_dates(spark, sf_dir), ["iso_text", "us_text", "name_text"])


def date_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(fx.ship_dates(spark, sf_dir), ["serial", "serial_text"])


def date_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of all layouts in one column, with missing and unreadable ones."""
    kind = F.col("l_orderkey") % 6
    mixed = fx.ship_dates(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        F.when(kind == 0, F.col("iso_text"))
        .when(kind == 1, F.col("slash_text"))
        .when(kind == 2, F.col("serial_text"))
        .when(kind == 3, F.replace("iso_text", F.lit("-"), F.lit("")))
        .when(kind == 4, F.when(F.col("l_orderkey") % 12 == 4, "9999-12-31").otherwise(F.concat(F.lit("on "), F.col("iso_text"))))
        .alias("date"),
    )
    return _converted(mixed, ["l_orderkey", "l_linenumber"], "date", "DATE", optional=True)


def map_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _codes(spark, sf_dir)
    return convert.map_values(customers, "code", {**fx.SEGMENT_MAP["c_mktsegment"], "furniture": "CHAIRS"})


_ERROR_RULES = [
    ColumnRule("p_partkey", "PART", "INTEGE"),
    ColumnRule("p_brand", "BRAND", "CODE"),
    ColumnRule("p_type", "TYPE", "CODE"),
    ColumnRule("p_name", "NAME", "INTEGE"),
    ColumnRule("price", "PRICE", "INTEGE", optional=True),
    ColumnRule("p_size", "FLAGS", "INTEGE", is_list=True, optional=True),
    ColumnRule("flag_text", "FLAGS", "INTEGE", is_list=True, optional=True),
]


def conversion_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fx.table(spark, sf_dir, "part").withColumn("price", _money("p_retailprice").cast("string"))
    parts = parts.withColumn("flag_text", F.col("p_brand"))
    return convert.conversion_errors(parts, _ERROR_RULES)


def conversion_error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = fx.table(spark, sf_dir, "part").withColumn("price", _money("p_retailprice").cast("string"))
    found = convert.conversion_error_summary(parts.withColumn("flag_text", F.col("p_brand")), _ERROR_RULES, examples=3)
    pairs = F.array_join(F.transform("examples", lambda one: F.concat(one["value"], F.lit("@"), one["id"])), "|")
    return found.withColumn("examples", pairs)


# Lists


def _part_lists(spark: SparkSession, sf_dir: str, list_format: str, list_style: str = convert.VALUES) -> DataFrame:
    return convert.convert(
        fx.parts_with_flags(spark, sf_dir), fx.PART_RULES, list_format=list_format, list_style=list_style
    )


def flags_to_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = _part_lists(spark, sf_dir, convert.ARRAY)
    return arrays.select(
        "PART", F.size("PRICE_FLAGS").alias("n"), F.get("PRICE_FLAGS", F.lit(0)).alias("first_item"),
        F.concat_ws("|", "PRICE_FLAGS").alias("items"),
    )


def flags_to_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = _part_lists(spark, sf_dir, convert.ARRAY, convert.NAMES)
    return arrays.select("PART", F.size("PRICE_FLAGS").alias("n"), F.concat_ws("|", "PRICE_FLAGS").alias("items"))


def list_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_lists(spark, sf_dir, convert.STRING)


def explode_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = _part_lists(spark, sf_dir, convert.ARRAY, convert.NAMES).drop("SIZE_FLAGS")
    return lists.explode_lists(arrays, "PART", ["PRICE_FLAGS"])


def explode_lists_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_lists(spark, sf_dir, convert.ROWS, convert.NAMES)


def list_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [*fx.PART_RULES[:2], ColumnRule("no_such_flag", "FLAGS", "INTEGE", is_list=True, optional=True)]
    return convert.convert(fx.table(spark, sf_dir, "part"), rules)


# Dedup, joins, differences


def first_row_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.first_row_per_id(fx.table(spark, sf_dir, "lineitem"), fx.ID, fx.LINE_ORDER)


def _merged(spark: SparkSession, sf_dir: str, comparison: Comparison) -> DataFrame:
    return stages.merge_stages(
        fx.stage_tables(spark, sf_dir), comparison, ["l_linenumber"], keep=["l_returnflag", *fx.SEGMENTS]
    )


def merge_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(_merged(spark, sf_dir, fx.COMPARISON))


def _raw_stages(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    lines = fx.table(spark, sf_dir, "lineitem").select(
        F.when(F.col(fx.ID) % 50 != 0, F.col(fx.ID)).alias(fx.ID), *[name for name in fx.LINE_ORDER if name != fx.ID], _money("l_extendedprice").alias("price")
    )
    return {
        "lines_1": lines,
        "lines_2": lines.filter(F.col("l_returnflag") != "R"),
        "lines_3": lines.filter(F.col("l_linestatus") != "O"),
    }


def merge_stages_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages straight from all lines: several rows per order, and one order in fifty without its ID."""
    rules = [StageRule(fx.ID, "Net", n, str(n), f"lines_{n}", "price") for n in (1, 2, 3)]
    merged = stages.merge_stages(_raw_stages(spark, sf_dir), Comparison(rules), fx.LINE_ORDER, keep=["l_linenumber"])
    return _plain(merged.withColumn(fx.ID, F.coalesce(fx.ID, F.lit(-1).cast("long"))))


def merge_stages_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of ``merge_stages_raw``, null IDs included, stored clustered first and found by their names."""
    tables, mark = _raw_stages(spark, sf_dir), uuid.uuid4().hex
    names = {
        table: writers.sink_stage(df, f"{table}_{mark}", fx.ID, fx.LINE_ORDER, 8, fx.scratch(spark)) for table, df in tables.items()
    }
    comparison = Comparison([StageRule(fx.ID, "Net", n, str(n), names[f"lines_{n}"], "price") for n in (1, 2, 3)])
    merged = stages.merge_stages(readers.scan_stages(spark, comparison), comparison, fx.LINE_ORDER, keep=["l_linenumber"])
    return _plain(merged.withColumn(fx.ID, F.coalesce(fx.ID, F.lit(-1).cast("long"))))


def merge_renewal(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = _merged(spark, sf_dir, fx.RENEWAL)
    return _plain(merged.select(fx.ID, *[name for name in merged.columns if name.endswith("_rn")]))


def _differences(spark: SparkSession, sf_dir: str, comparison: Comparison, wanted: Callable[[str], bool]) -> DataFrame:
    rows = diffs.add_differences(_merged(spark, sf_dir, comparison), comparison)
    return _plain(rows.select(fx.ID, *[name for name in rows.columns if "diff_" in name and wanted(name)]))


def diff_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _differences(spark, sf_dir, fx.COMPARISON, lambda n: n.startswith("diff_") and n.endswith("_step_0"))


def pct_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _differences(spark, sf_dir, fx.COMPARISON, lambda n: n.startswith("percent_") and n.endswith("_step_0"))


def diff_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _differences(spark, sf_dir, fx.COMPARISON, lambda n: not n.endswith("_step_0"))


def diff_renewal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _differences(spark, sf_dir, fx.RENEWAL, lambda n: n.endswith("_rn"))


# Filters


def filter_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.filter_segments(
        _merged(spark, sf_dir, fx.COMPARISON),
        {
            "c_mktsegment": ["BUILDING", "FURNITURE"],
            "note": ["NA", " 2-HIGH"],
            "n_name": [],
            "no_such_column": ["x"],
        },
    )
    return _plain(rows.select(fx.ID, "c_mktsegment", "note", "Net_1"))


def filter_rate_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = fx.impact(spark, sf_dir, renewal=True)
    rows = filters.filter_rate_change(result.rows, fx.RENEWAL, "Net", 0, -0.04, 0.02, "RN")
    return _plain(rows.select(fx.ID, "percent_diff_Net_step_0_rn", "Net_1_rn"))


def segment_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.segment_values(_merged(spark, sf_dir, fx.COMPARISON), "note")


# Bands


def assign_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.impact(spark, sf_dir).rows
    rows = bands.assign_band(rows, "percent_diff_Net_step_1", fx.BANDS, "net_band")
    rows = bands.assign_band(rows, "percent_diff_Rate_step_1", fx.BANDS, "rate_band")
    return rows.select(fx.ID, "net_band", "rate_band")


def band_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.band_distribution(fx.impact(spark, sf_dir).rows, "percent_diff_Rate_step_1", fx.BANDS)


def band_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.band_zero_fill(fx.impact(spark, sf_dir).rows, "percent_diff_Rate_step_1", fx.BANDS)


def distribution_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.distribution(fx.impact(spark, sf_dir).rows, fx.COMPARISON, fx.BANDS)


def distribution_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution of chosen rows from stored band counts, without the merged rows."""
    counted = fx.impact(spark, sf_dir).band_counts(["c_mktsegment", "note", "l_returnflag"])
    path = fx.scratch(spark)
    writers.write_table(counted.counts, path, writers.PARQUET)
    stored = counted.on(readers.scan_table(spark, path))
    return stored.distribution({"c_mktsegment": ["BUILDING", "FURNITURE"], "note": ["NA", " 2-HIGH"]})


def distribution_renewal(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = bands.distribution_renewal(fx.impact(spark, sf_dir, renewal=True).rows, fx.RENEWAL, fx.BANDS)
    return paired.withColumn("rn_count", F.col("rn_count").cast("double"))


# Summaries


def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(summary.stage_totals(_merged(spark, sf_dir, fx.COMPARISON), fx.COMPARISON))


def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.comparison_summary(_merged(spark, sf_dir, fx.COMPARISON), fx.COMPARISON)


def item_stage_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.item_stage_pivot(_merged(spark, sf_dir, fx.COMPARISON), fx.COMPARISON)


def item_stage_pivot_rn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.item_stage_pivot_rn(_merged(spark, sf_dir, fx.RENEWAL), fx.RENEWAL)


def breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.breakdown(
        _merged(spark, sf_dir, fx.COMPARISON), fx.COMPARISON, ["c_mktsegment", "note", "l_returnflag", "n_name"]
    )


def breakdown_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.breakdown_rollup(
        _merged(spark, sf_dir, fx.COMPARISON), fx.COMPARISON, ["c_mktsegment", "note", "l_returnflag", "n_name"]
    )


def breakdown_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions that are called as columns of the result: these get an underscore before them."""
    merged = _merged(spark, sf_dir, fx.COMPARISON).withColumnsRenamed({"c_mktsegment": "item", "n_name": "policy_count"})
    return summary.breakdown(merged, fx.COMPARISON, ["item", "policy_count"])


def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.waterfall(_merged(spark, sf_dir, fx.COMPARISON), fx.COMPARISON)


def progression_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.progression_table(_merged(spark, sf_dir, fx.COMPARISON), fx.COMPARISON)


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        scan_csv, scan_csv_split, scan_stages, sink_converted, sink_impact, sink_filtered,
        resolve_columns, check_required, project_mapped, stage_columns, blank_to_null,
        code_required, intege_required, decima_required, date_slash, date_text, date_serial,
        code_optional, intege_optional, decima_optional, date_optional, map_values, conversion_errors, conversion_error_summary,
        flags_to_list, flags_to_names, list_to_string, explode_list, explode_lists_aligned, list_absent,
        first_row_per_id, merge_stages, merge_stages_raw, merge_stages_clustered, merge_renewal,
        diff_overall, pct_overall, diff_steps, diff_renewal,
        filter_segments, filter_rate_change, segment_values,
        assign_band, band_distribution, band_zero_fill, distribution_all, distribution_counted, distribution_renewal,
        stage_totals, comparison_summary, item_stage_pivot, item_stage_pivot_rn,
        breakdown, breakdown_named, breakdown_rollup, waterfall, progression_table,
    )
}
