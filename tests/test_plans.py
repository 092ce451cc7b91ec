"""Properties of the physical plans that matter at scale."""

import re

import pytest
from pyspark.sql import functions as F

from steploom import Comparison, StageRule
from steploom.operators import bands as bd
from steploom.operators import convert as cv
from steploom.operators import filters as fl
from steploom.operators import stages as sg
from steploom.operators import summary as sm
from suite import fixtures as fx
from suite.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SMALL = {"sink_converted", "sink_impact", "sink_filtered", "scan_csv", "scan_stages"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return len(re.findall(r"\bExchange (?:hash|range|SinglePartition)", text))


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF_DIR}/lineitem.parquet")


def test_no_python_in_any_plan(spark):
    for name, query in QUERIES.items():
        if name not in SMALL:
            text = plan(query(spark, SF_DIR))
            assert "Python" not in text and "Pandas" not in text, name
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_conversions_do_not_shuffle(spark):
    for name in ("code_required", "intege_required", "decima_required", "date_text", "conversion_errors",
                 "explode_lists_aligned", "list_to_string", "map_values", "project_mapped", "blank_to_null"):
        assert exchanges(plan(QUERIES[name](spark, SF_DIR))) == 0, name


def test_first_row_is_limited_before_the_shuffle(lineitem):
    text = plan(sg.first_row_per_id(lineitem, "l_orderkey", fx.LINE_ORDER))
    assert exchanges(text) == 1
    below = text[text.index("Exchange") :]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_merge_shuffles_each_table_once(spark, lineitem):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rules = [StageRule("l_orderkey", "P", n, str(n), f"t{n}", "l_extendedprice") for n in (1, 2, 3)]
        tables = {f"t{n}": lineitem.filter(F.col("l_suppkey") != n) for n in (1, 2, 3)}
        text = plan(sg.merge_stages(tables, Comparison(rules), fx.LINE_ORDER, keep=[]))
        assert text.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in text
        assert exchanges(text) == 3 and text.count("FileScan") == 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merge_of_bucketed_tables_does_not_shuffle(spark, lineitem):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    names = ("bucketed_1", "bucketed_2")
    try:
        for name in names:
            lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").write.mode("overwrite").bucketBy(
                4, "l_orderkey"
            ).saveAsTable(name)
        rules = [StageRule("l_orderkey", "P", n, str(n), name, "l_extendedprice") for n, name in enumerate(names, 1)]
        merged = sg.merge_stages({name: spark.table(name) for name in names}, Comparison(rules), ["l_linenumber"], keep=[], ids_not_null=True)
        assert exchanges(plan(merged)) == 0
        assert merged.count() == lineitem.select("l_orderkey").distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_reports_scan_only_their_columns(spark, tmp_path):
    result = fx.impact(spark, SF_DIR)
    path = str(tmp_path / "rows")
    result.rows.write.parquet(path)
    stored = result.on(spark.read.parquet(path))

    def scanned(df):
        return len(re.findall(r"FileScan parquet \[(.*?)\] Batched", plan(df))[0].split(","))

    assert scanned(stored.summary()) == 6
    assert scanned(bd.distribution(stored.rows, fx.COMPARISON, fx.BANDS)) == 6
    assert scanned(sm.breakdown(stored.rows, fx.COMPARISON, ["c_mktsegment"])) == 5
    filtered = fl.filter_segments(stored.rows, {"c_mktsegment": ["BUILDING"], "l_orderkey": ["3", "5"]})
    text = plan(filtered)
    assert "IsNotNull(c_mktsegment)" in text or "c_mktsegment" in re.findall(r"PushedFilters: \[(.*)", text)[0]
    rate = fl.filter_rate_change(stored.rows, fx.COMPARISON, "Net", 0, -0.1, 0.1)
    assert "PushedFilters: [IsNotNull(percent_diff_Net_step_0)" in plan(rate)


def test_distribution_aggregates_in_one_pass(spark, tmp_path):
    path = str(tmp_path / "rows")
    fx.impact(spark, SF_DIR).rows.write.parquet(path)
    text = plan(bd.distribution(spark.read.parquet(path), fx.COMPARISON, fx.BANDS))
    assert text.count("FileScan") == 1


def test_rollup_expands_groups_not_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    fx.impact(spark, SF_DIR).rows.write.parquet(path)
    text = plan(sm.breakdown_rollup(spark.read.parquet(path), fx.COMPARISON, ["c_mktsegment", "note"]))
    below = text[text.index("Expand") :]
    assert below.index("HashAggregate") < below.index("FileScan")


def test_hot_id_gives_whole_results(spark):
    """A third of all rows share one ID, another third have none."""
    copies = spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 3 == 1, F.col("id")).alias("k"),
        F.col("id").alias("seq"),
        F.col("id").cast("double").alias("v"),
    )
    rules = [StageRule("k", "P", n, str(n), f"t{n}", "v") for n in (1, 2)]
    merged = sg.merge_stages({"t1": copies, "t2": copies.filter("seq > 5")}, Comparison(rules), ["seq"], keep=[])
    hot = {row.k: (row.P_1, row.P_2) for row in merged.filter("k = -1 or k is null").collect()}
    assert hot == {-1: (0.0, 6.0), None: (2.0, 8.0)}
    assert merged.count() == 20000 - 2 + 2


def test_small_value_map_never_shuffles(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.read.parquet(f"{SF_DIR}/customer.parquet")
        assert exchanges(plan(cv.map_values(df, "c_mktsegment", {"AUTOMOBILE": "AUTO"}))) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
