"""Stages, differences, filters, bands and summaries on small tables with literal expectations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from steploom import Band, Comparison, SpecError, StageRule, analyse
from steploom.operators import bands as bd
from steploom.operators import filters as fl
from steploom.operators import stages as sg
from steploom.operators import summary as sm
from steploom.operators.diffs import add_differences
from steploom.sources.readers import scan_stages
from steploom.sources.writers import sink_stage
from steploom.specs import check_bands

EDGES = (Band("a", -0.1), Band("b", 0.0), Band("c", 0.1))


def rows(df):
    return [tuple(row) for row in df.collect()]


def stage(item, number, name, table, column, rn=None):
    return StageRule("id", item, number, name, table, column, rn)


RULES = [
    stage("P", 1, "Start", "t1", "v", "w"),
    stage("P", 2, "Middle", "t2", "v", "w"),
    stage("P", 3, "End", "t3", "v"),
]


@pytest.fixture(scope="module")
def tables(spark):
    schema = "id string, seq int, v double, w double, seg string"
    return {
        "t1": spark.createDataFrame(
            [("A", 2, 9.0, 9.0, "late"), ("A", 1, 1.0, 5.0, "x"), ("B", 1, 0.0, 2.0, " "), (None, 2, 7.0, 7.0, "z"),
             (None, 1, 4.0, 4.0, None), ("C", 1, 3.0, 3.0, "x")],
            schema,
        ),
        "t2": spark.createDataFrame(
            [("A", 1, 2.0, 6.0, "-"), ("B", 1, 1.0, None, "-"), (None, 3, 5.0, 5.0, "-"), (None, 4, 0.0, 0.0, "-"), ("D", 1, 1.0, 1.0, "-")],
            schema,
        ),
        "t3": spark.createDataFrame([("A", 1, 4.0, 0.0, "-"), ("B", 1, None, 0.0, "-"), (None, 1, 10.0, 0.0, "-")], schema),
    }


def test_comparison_steps_and_columns():
    comparison = Comparison(RULES[::-1], renewal=True)
    assert comparison.base_table == "t1" and comparison.tables == ["t1", "t2", "t3"]
    assert [(step.number, step.name, step.from_stage, step.to_stage) for step in comparison.steps("P")] == [
        (0, "Overall", 1, 3), (1, "Middle", 1, 2), (2, "End", 2, 3)]
    assert [step.percent_column for step in comparison.steps("P", "RN")] == ["percent_diff_P_step_1_rn"]
    assert Comparison(RULES[:1]).steps("P") == []
    for bad in (("Q", 0, "NB"), ("P", 9, "NB"), ("P", 0, "RN"), ("P", 0, "XX")):
        with pytest.raises(SpecError):
            comparison.step(*bad)
    with pytest.raises(SpecError):
        Comparison([])


def test_stage_rule_from_row():
    row = {"ID": "id", "Item": "P", "Stage": 1.0, "StageName": "Start", "File": "t1", "Column": "v", "RNColumn": math.nan}
    assert StageRule.from_row(row) == stage("P", 1, "Start", "t1", "v")
    assert StageRule.from_row({**row, "RNColumn": "w"}).rn_column == "w"
    with pytest.raises(SpecError, match="StageName"):
        StageRule.from_row({key: value for key, value in row.items() if key != "StageName"})


def test_first_row_per_id(tables):
    got = sg.first_row_per_id(tables["t1"], "id", ["seq"]).select("id", "v")
    assert sorted(rows(got), key=str) == [("A", 1.0), ("B", 0.0), ("C", 3.0), (None, 4.0)]
    got = sg.first_row_per_id(tables["t1"], "id", [F.col("seq").desc()]).select("id", "v")
    assert sorted(rows(got), key=str)[0] == ("A", 9.0)
    with pytest.raises(SpecError):
        sg.first_row_per_id(tables["t1"], "id", [])


def test_merge_is_inner_and_null_ids_match(tables):
    got = sg.merge_stages(tables, Comparison(RULES), ["seq"])
    assert got.columns == ["id", "seq", "w", "seg", "P_1", "P_2", "P_3"]
    assert sorted(rows(got), key=str) == [
        ("A", 1, 5.0, "x", 1.0, 2.0, 4.0),
        ("B", 1, 2.0, None, 0.0, 1.0, None),
        (None, 1, 4.0, None, 4.0, 5.0, 10.0),
    ]


def test_merge_keeps_only_what_is_asked(tables):
    got = sg.merge_stages(tables, Comparison(RULES, renewal=True), {name: ["seq"] for name in tables}, keep=["seg"])
    assert got.columns == ["id", "seg", "P_1", "P_2", "P_3", "P_1_rn", "P_2_rn"]
    assert ("A", "x", 1.0, 2.0, 4.0, 5.0, 6.0) in rows(got)


def test_merge_one_table_for_all_stages(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0)], "id string, a double, b double")
    rules = [stage("P", 1, "S", "t", "a"), stage("P", 2, "E", "t", "b"), stage("Q", 1, "S", "t", "a"), stage("Q", 2, "E", "t", "a")]
    got = sg.merge_stages({"t": df}, Comparison(rules), ["a"])
    assert got.columns == ["id", "P_1", "P_2", "Q_1", "Q_2"] and rows(got) == [("A", 1.0, 2.0, 1.0, 1.0)]


def test_merge_errors(tables, spark):
    with pytest.raises(SpecError, match="no table given for t3"):
        sg.merge_stages({"t1": tables["t1"], "t2": tables["t2"]}, Comparison(RULES), ["seq"])
    with pytest.raises(SpecError, match="gone"):
        sg.merge_stages(tables, Comparison([*RULES, stage("P", 4, "X", "t3", "gone")]), ["seq"])
    with pytest.raises(SpecError, match="already"):
        sg.stage_columns(tables["t1"].withColumn("P_1", F.lit(1)), Comparison(RULES), "t1")
    with pytest.raises(SpecError, match="order_by"):
        sg.merge_stages(tables, Comparison(RULES), {"t1": ["seq"]})


def test_text_stage_values_are_numbers(spark):
    df = spark.createDataFrame([("A", "1.5", "2")], "id string, a string, b string")
    got = sg.merge_stages({"t": df}, Comparison([stage("P", 1, "S", "t", "a"), stage("P", 2, "E", "t", "b")]), ["a"])
    assert rows(got) == [("A", 1.5, 2.0)]


def test_differences(tables):
    comparison = Comparison(RULES, renewal=True)
    got = add_differences(sg.merge_stages(tables, comparison, ["seq"], keep=[]), comparison)
    by_id = {row.id: row for row in got.collect()}
    assert (by_id["A"].diff_P_step_0, by_id["A"].percent_diff_P_step_0) == (3.0, 3.0)
    assert (by_id["A"].diff_P_step_1, by_id["A"].percent_diff_P_step_1) == (1.0, 1.0)
    assert (by_id["B"].diff_P_step_1, by_id["B"].percent_diff_P_step_1) == (1.0, None)
    assert (by_id["B"].diff_P_step_2, by_id["B"].percent_diff_P_step_0) == (None, None)
    assert (by_id["A"].diff_P_step_1_rn, by_id["A"].percent_diff_P_step_1_rn) == (1.0, 0.2)
    assert "diff_P_step_0_rn" not in got.columns


def test_bands_are_left_closed(spark):
    values = [-0.2, -0.1, 0.0, 0.05, 0.1, math.inf, None, math.nan]
    df = spark.createDataFrame([(value,) for value in values], "v double")
    got = [row.band for row in bd.assign_band(df, "v", EDGES).collect()]
    assert got == ["Out of Range", "a", "b", "b", "c", "Out of Range", "Missing", "Missing"]
    for bad in ([], [Band("a", 1), Band("a", 2)], [Band("a", 1), Band("b", 1)], [Band("a", math.nan)], [Band("a", math.inf)]):
        with pytest.raises(SpecError):
            check_bands(bad)
    assert Band.from_row({"Name": "a", "From": "-0.1"}) == EDGES[0]
    assert rows(bd.assign_band(df, "v", [Band("all", -math.inf)]).filter("v < 0"))[0][1] == "all"


def test_band_percentage_is_half_even_of_all_rows(spark):
    df = spark.range(800).select(F.when(F.col("id") == 0, 0.05).otherwise(F.lit(None)).alias("v"))
    assert sorted(rows(bd.band_distribution(df, "v", EDGES))) == [("Missing", 799, 99.88), ("b", 1, 0.12)]
    assert rows(bd.band_zero_fill(df, "v", EDGES)) == [(0, "a", 0, 0.0), (1, "b", 1, 0.12), (2, "c", 0, 0.0), (3, "Missing", 799, 99.88)]
    assert rows(bd.band_zero_fill(df.filter("v > 1"), "v", EDGES)) == [(0, "a", 0, 0.0), (1, "b", 0, 0.0), (2, "c", 0, 0.0)]


def test_a_band_may_be_called_missing(spark):
    df = spark.createDataFrame([(None,), (0.5,)], "v double")
    got = rows(bd.band_zero_fill(df, "v", [Band("Missing", 0.0), Band("high", 1.0)]))
    assert got == [(0, "Missing", 2, 100.0), (1, "high", 0, 0.0)]


def test_distribution_of_renewal_beside_new_business(tables):
    result = analyse(tables, Comparison(RULES, renewal=True), EDGES, ["seq"], keep=[])
    paired = bd.distribution_renewal(result.rows, result.comparison, EDGES).orderBy("band_order")
    assert {row[7:] for row in rows(paired.filter("step <> 1"))} == {(None, None)}
    assert {row[1] for row in rows(paired)} == {0, 1, 2}
    assert [row[1:] for row in rows(paired.filter("step = 1"))] == [
        (1, "Middle", 0, "a", 0, 0.0, 0, 0.0),
        (1, "Middle", 1, "b", 0, 0.0, 0, 0.0),
        (1, "Middle", 2, "c", 2, 66.67, 2, 66.67),
        (1, "Middle", 3, "Missing", 1, 33.33, 1, 33.33),
    ]
    long = result.distribution()
    assert {(row.step, row.segment) for row in long.collect()} == {(0, "NB"), (1, "NB"), (2, "NB"), (1, "RN")}


@pytest.fixture(scope="module")
def merged(spark):
    return spark.createDataFrame(
        [("A", "x", "p", 10, True, 100.0, 110.0, 0.0), ("B", "x", None, 20, False, 200.0, 190.0, None),
         ("C", None, "p", 10, None, 0.0, 5.0, 0.0), ("D", "y", "q", None, True, None, 7.0, None)],
        "id string, seg string, sub string, n int, flag boolean, P_1 double, P_2 double, Z_1 double",
    )


TWO = Comparison([stage("P", 1, "Start", "t", "P_1"), stage("P", 2, "End", "t", "P_2"), stage("Z", 1, "Only", "t", "Z_1")])


def test_filter_segments(merged):
    def ids(filters):
        return "".join(sorted(row.id for row in fl.filter_segments(merged, filters).collect()))

    assert ids({"seg": ["x"]}) == "AB"
    assert ids({"seg": ["NA"]}) == "C"
    assert ids({"seg": ["x", "NA"], "sub": ["p"]}) == "AC"
    assert ids({"seg": [], "nope": ["x"]}) == "ABCD"
    assert ids({"n": ["10", "x", "010"]}) == "AC"
    assert ids({"n": ["x"]}) == ""
    assert ids({"flag": ["True"]}) == "AD"
    assert ids({"P_1": ["100.0", "NA"]}) == "AD"


def test_segment_values(merged):
    assert rows(fl.segment_values(merged, "seg")) == [("x",), ("y",), ("NA",)]
    assert rows(fl.segment_values(merged, "flag")) == [("False",), ("True",), ("NA",)]
    assert rows(fl.segment_values(merged, "id")) == [("A",), ("B",), ("C",), ("D",)]
    with pytest.raises(SpecError):
        fl.segment_values(merged, "nope")


def test_filter_rate_change(merged):
    with_diffs = add_differences(merged, TWO)
    got = fl.filter_rate_change(with_diffs, TWO, "P", 0, -0.05, 0.1)
    assert sorted(row.id for row in got.collect()) == ["A", "B"]
    with pytest.raises(SpecError):
        fl.filter_rate_change(with_diffs, TWO, "P", 5, 0, 1)
    with pytest.raises(SpecError):
        fl.filter_rate_change(merged, TWO, "P", 0, 0, 1)
    for low, high in ((-1.1, 0), (0.2, 0.1)):
        with pytest.raises(SpecError):
            fl.check_thresholds(low, high)


def test_summary(merged):
    assert rows(sm.stage_totals(merged, TWO)) == [(300.0, 312.0, 0.0)]
    assert rows(sm.comparison_summary(merged, TWO)) == [
        ("P", 0, "Start", 300.0, 0.0, 1.0, 0.0),
        ("P", 1, "End", 312.0, 12.0, 1.04, 0.04),
        ("Z", 0, "Only", 0.0, 0.0, None, 0.0),
    ]
    assert rows(sm.item_stage_pivot(merged, TWO)) == [("P", 300.0, 312.0, 0.0), ("Z", 0.0, 0.0, 0.0)]
    assert rows(sm.waterfall(merged, TWO))[:3] == [
        ("P", 0, "Start", 100.0, 300.0, 0.0, False),
        ("P", 1, "End", 4.0, 312.0, 12.0, False),
        ("P", 2, "Final", 104.0, 312.0, 12.0, True),
    ]
    assert rows(sm.progression_table(merged, TWO))[:4] == [
        ("P", 0, "Total Value", 300.0, 312.0, None),
        ("P", 1, "Value Difference", 0.0, 12.0, None),
        ("P", 2, "Difference %", 0.0, 4.0, None),
        ("P", 3, "Total %", 100.0, 104.0, None),
    ]


def test_summary_worked_example(spark):
    """Totals of a three-stage comparison with their published shares."""
    df = spark.createDataFrame([(213189.2259145, 417694.64, 416797.72)], "BI_1 double, BI_2 double, BI_3 double")
    names = ("Start", "Excess Change", "Inflation")
    comparison = Comparison([stage("BI", n + 1, name, "t", f"BI_{n + 1}") for n, name in enumerate(names)])
    got = sm.comparison_summary(df, comparison).collect()
    assert [row.value_total_percent * 100 for row in got] == pytest.approx([100.0, 195.9267116845376, 195.50599623977132])
    assert [row.value_diff_percent * 100 for row in got] == pytest.approx([0, 95.92671168453761, -0.42071544476628253])


def test_renewal_pivot_without_renewal_columns(tables):
    comparison = Comparison([*RULES, stage("Q", 1, "Start", "t1", "v")], renewal=True)
    merged = sg.merge_stages(tables, comparison, ["seq"], keep=[])
    assert rows(sm.item_stage_pivot_rn(merged, comparison)) == [("P", 11.0, 11.0, 0.0), ("Q", 0.0, 0.0, 0.0)]
    assert rows(sm.item_stage_pivot_rn(merged, Comparison(RULES))) == []
    no_rn = Comparison([stage("Q", 1, "Start", "t1", "v")], renewal=True)
    assert rows(sm.item_stage_pivot_rn(merged, no_rn)) == [("Q", 0.0)]


def test_breakdown(merged):
    got = rows(sm.breakdown(merged, TWO, ["seg"]))
    assert got[:3] == [
        ("P", "x", 300.0, 300.0, 2, 0.0, 0.0),
        ("P", "y", 0.0, 7.0, 1, 7.0, 0.0),
        ("P", None, 0.0, 5.0, 1, 5.0, 0.0),
    ]
    assert got[3] == ("Z", "x", 0.0, 0.0, 2, 0.0, 0.0)
    with pytest.raises(SpecError):
        sm.breakdown(merged, TWO, ["seg", "nope"])
    four = sm.breakdown(merged, TWO, ["seg", "sub", "n", "flag"])
    assert four.columns[:5] == ["item", "seg", "sub", "n", "flag"] and four.filter("item = 'P'").count() == 4


def test_repeated_stage_names_are_refused():
    with pytest.raises(SpecError, match="Q1"):
        Comparison([stage("P", 1, "Q1", "t", "a"), stage("P", 2, "Q1", "t", "b"), stage("P", 3, "End", "t", "c")])


def test_distribution_without_steps_is_empty(merged):
    one = Comparison([stage("P", 1, "Only", "t", "P_1")])
    assert bd.distribution(merged, one, EDGES).collect() == []
    assert bd.distribution_renewal(merged, one, EDGES).columns[:3] == ["item", "step", "step_name"]
    assert bd.distribution_renewal(merged, one, EDGES).collect() == []


def test_first_row_keeps_a_column_of_the_helper_name(merged):
    table = merged.withColumn("_row", F.lit("mine"))
    assert {r["_row"] for r in sg.first_row_per_id(table, "seg", ["n"]).collect()} == {"mine"}


def test_merge_matches_null_ids_and_keeps_clashing_names(spark):
    schema = "id long, seq int, v double, _key string, _id string"
    one = spark.createDataFrame([(1, 1, 1.0, "k", "a"), (1, 2, 9.0, "k", "a"), (None, 1, 3.0, "n", "b"), (0, 1, 5.0, "z", "c")], schema)
    two = spark.createDataFrame([(1, 1, 2.0, "", ""), (None, 2, 8.0, "", ""), (None, 1, 4.0, "", "")], schema)
    rules = [stage("P", 1, "A", "one", "v"), stage("P", 2, "B", "two", "v")]
    rules = [type(r)("id", r.item, r.stage, r.stage_name, r.table, r.column) for r in rules]
    got = sg.merge_stages({"one": one, "two": two}, Comparison(rules), ["seq"])
    assert sorted(map(tuple, got.select("id", "_key", "_id", "P_1", "P_2").collect()), key=str) == [(1, "k", "a", 1.0, 2.0), (None, "n", "b", 3.0, 4.0)]
    assert sg.merge_stages({"one": one, "two": two}, Comparison(rules), ["seq"], ids_not_null=True).count() == 1


def test_breakdown_by_columns_named_like_its_own(merged):
    named = merged.withColumnsRenamed({"seg": "item", "sub": "Level"}).withColumn("_count", F.lit("c"))
    plain = rows(sm.breakdown(merged, TWO, ["seg", "sub"]))
    got = sm.breakdown(named, TWO, ["item", "Level"])
    assert got.columns == ["_item", "item", "Level", *sm._MEASURES] and rows(got) == plain
    got = sm.breakdown_rollup(named, TWO, ["item", "Level"])
    assert got.columns == ["_item", "_level", "item", "Level", *sm._MEASURES]
    assert rows(got) == rows(sm.breakdown_rollup(merged, TWO, ["seg", "sub"]))
    own = ["_count", "item_order", "policy_count", "value_diff", "_grouping", "_start_0"]
    many = merged.select("*", *[F.lit("x").alias(name) for name in own])
    assert sm.breakdown(many, TWO, own).count() == sm.breakdown(merged.withColumn("k", F.lit("x")), TWO, ["k"]).count()
    assert sm.breakdown_rollup(many, TWO, own).columns[2:8] == own


def test_breakdown_with_totals(merged):
    got = [row[1:7] for row in rows(sm.breakdown_rollup(merged, TWO, ["seg", "sub"])) if row[0] == "P"]
    assert got == [
        ("detail", "x", "p", 100.0, 110.0, 1),
        ("detail", "x", None, 200.0, 190.0, 1),
        ("subtotal_1", "x", None, 300.0, 300.0, 2),
        ("detail", "y", "q", 0.0, 7.0, 1),
        ("subtotal_1", "y", None, 0.0, 7.0, 1),
        ("detail", None, "p", 0.0, 5.0, 1),
        ("subtotal_1", None, None, 0.0, 5.0, 1),
        ("grand_total", None, None, 300.0, 312.0, 4),
    ]
    empty = rows(sm.breakdown_rollup(merged.filter("id = 'Z'"), TWO, ["seg"]))
    assert empty == [("P", "grand_total", None, 0.0, 0.0, 0, 0.0, 0.0), ("Z", "grand_total", None, 0.0, 0.0, 0, 0.0, 0.0)]
    one = [row[1:3] for row in rows(sm.breakdown_rollup(merged, TWO, ["seg"])) if row[0] == "P"]
    assert one == [("detail", "x"), ("detail", "y"), ("detail", None), ("grand_total", None)]
    three = [row[1] for row in rows(sm.breakdown_rollup(merged, TWO, ["seg", "sub", "n"])) if row[0] == "P"]
    assert three[:3] == ["detail", "subtotal_2", "detail"] and three[-1] == "grand_total"
    assert three.count("subtotal_2") == 4 and three.count("subtotal_1") == 3


def test_reports_on_filtered_rows(tables):
    result = analyse(tables, Comparison(RULES), EDGES, ["seq"])
    assert rows(result.where({"seg": ["x"]}).summary())[0][:4] == ("P", 0, "Start", 1.0)


def test_band_counts_answer_filters_as_filter_then_count(spark):
    rng = random.Random(5)
    data = [
        (rng.choice([None, "x", "y", "count"]), rng.choice([None, 1, 2]), rng.choice([0.5, math.nan]), rng.choice(["p", None]), v, v * rng.choice([0.5, 1, 2]))
        for v in map(float, range(300))
    ]
    df = spark.createDataFrame(data, "series string, count int, share double, other string, P_1 double, P_2 double")
    comparison = Comparison([stage("P", 1, "Start", "t", "a"), stage("P", 2, "End", "t", "b")])
    diffs = add_differences(df, comparison)
    counted = bd.count_bands(diffs, comparison, EDGES, ["series", "count", "share"])
    assert counted.counts.columns == ["series", "count", "share", "_series", "band_order", "_count"]
    for filters in ({}, {"series": ["x", "NA"]}, {"count": ["1"], "share": ["NA"]}, {"series": ["none"]}, {"series": [], "other": []}):
        want = bd.distribution(fl.filter_segments(diffs, filters), comparison, EDGES)
        assert sorted(rows(counted.distribution(filters))) == sorted(rows(want))
    with pytest.raises(SpecError, match="other"):
        counted.distribution({"other": ["p"]})
    with pytest.raises(SpecError, match="gone"):
        bd.count_bands(diffs, comparison, EDGES, ["gone"])


def test_clustered_stages_merge_without_a_shuffle(spark, tables, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    names = {}
    try:
        for name, df in tables.items():
            names[name] = sink_stage(df, f"clustered_{name}", "id", ["seq"], 4, str(tmp_path / name))
        rules = [StageRule("id", "P", n, str(n), names[f"t{n}"], "v") for n in (1, 2, 3)]
        comparison = Comparison(rules)
        stored = scan_stages(spark, comparison)
        got = sg.merge_stages(stored, comparison, ["seq"])
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        plain = Comparison([StageRule("id", "P", n, str(n), f"t{n}", "v") for n in (1, 2, 3)])
        want = sg.merge_stages(tables, plain, ["seq"])
        assert got.columns == want.columns
        assert sorted(rows(got), key=str) == sorted(rows(want), key=str) and any(row[0] is None for row in rows(got))
        kept = sg.merge_stages(stored, comparison, ["seq"], keep=["seg"])
        assert kept.columns == ["id", "seg", "P_1", "P_2", "P_3"]
        mixed = sg.merge_stages({**stored, names["t3"]: tables["t3"]}, comparison, ["seq"])
        assert sorted(rows(mixed), key=str) == sorted(rows(want), key=str) and mixed.columns == want.columns
        assert all(row[0] is not None for row in rows(sg.merge_stages(stored, comparison, ["seq"], ids_not_null=True)))
        with pytest.raises(SpecError):
            sink_stage(stored[names["t1"]], "again", "id", ["seq"], 4)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
