"""Header matching, conversion by rules, value maps, problem reports and lists."""

import hashlib

import pytest
from pyspark.sql import functions as F

from steploom import ColumnRule, SpecError
from steploom.operators import convert as cv
from steploom.operators.columns import check_required, find_column, project_mapped, resolve_columns
from steploom.operators.lists import explode_lists, flags_to_list, list_to_string
from steploom.specs import targets

NO_ROWS = dict(list_format=cv.STRING)


def rows(df):
    return [tuple(row) for row in df.collect()]


@pytest.fixture(scope="module")
def policies(spark):
    return spark.createDataFrame(
        [
            ("POL1", " fire ", 1, 0, None, "x", 10.5),
            ("POL2", "FLOOD", None, None, None, "1", 2.0),
            ("POL3", None, 1, 1, 1, None, None),
        ],
        "`Policy Number` string, cover string, smoke_alarm int, fire_hydrant int, patrol int, memo string, amount double",
    )


def rule(source, target, data_type="CODE", is_list=False, optional=False):
    return ColumnRule(source, target, data_type, is_list, optional)


def test_find_column_prefers_exact_then_first_similar():
    assert find_column("a_b", ["A B", "a_b"]) == "a_b"
    assert find_column("a_b", ["x", "A B ", "a b"]) == "A B "
    assert find_column("a_b", ["ab"]) is None


def test_resolve_columns(policies):
    assert resolve_columns(policies, ["policy_number", "COVER"]).columns == ["policy_number", "COVER"]
    with pytest.raises(SpecError, match="nothing"):
        resolve_columns(policies, ["nothing"])


def test_rules_are_checked_and_grouped():
    row = {"Original Column": " a ", "New Column": "x", "Data Type": "code", "List": "y", "Required": "No"}
    assert ColumnRule.from_row(row) == ColumnRule("a", "X", "CODE", True, True)
    for header, bad in (("Data Type", "TEXT"), ("List", "maybe"), ("Required", "perhaps")):
        with pytest.raises(SpecError):
            ColumnRule.from_row({**row, header: bad})
    with pytest.raises(SpecError, match="New Column"):
        ColumnRule.from_row({key: value for key, value in row.items() if key != "New Column"})
    grouped = targets([rule("a", "X"), rule("b", "Y"), rule("a", "Z")])
    assert [(target.name, target.is_list) for target in grouped] == [("Z", False), ("Y", False)]
    assert targets([rule("a", "X"), rule("b", "X")])[0].is_list


def test_check_required_names_all_missing(policies):
    rules = [rule("policy_number", "ID"), rule("gone", "A"), rule("lost", "L", is_list=True), rule("cover", "L", is_list=True)]
    with pytest.raises(SpecError, match="gone, lost"):
        check_required(policies, rules)
    assert check_required(policies, rules[:1]) is policies


def test_project_mapped_leaves_absent_optional_out(policies):
    got = project_mapped(policies, [rule("policy_number", "id"), rule("gone", "A", optional=True), rule("cover", "c")])
    assert got.columns == ["ID", "C"]


def test_convert_in_rule_order_with_map_before_check(policies):
    rules = [rule("policy_number", "ID"), rule("cover", "COVER"), rule("amount", "AMOUNT", "DECIMA")]
    got = cv.convert(policies, rules, {"cover": {" fire ": "F", "FLOOD": "OLD", "FLOOD ": "W"}})
    assert got.columns == ["ID", "COVER", "AMOUNT"]
    assert sorted(rows(got)) == [("POL1", "F", 10.5), ("POL2", "W", 2.0), ("POL3", None, None)]


def test_value_map_is_for_required_columns_under_the_rule_name(policies):
    got = cv.convert(policies, [rule("policy_number", "ID"), rule("cover", "C", optional=True)], {"cover": {"FLOOD": "W"}})
    assert ("POL2", "FLOOD") in rows(got)
    got = cv.convert(policies, [rule("POLICY NUMBER", "ID")], {"Policy Number": {"POL1": "ONE"}})
    assert ("POL1",) in rows(got)


def test_map_values_on_numbers_uses_their_text(spark):
    df = spark.createDataFrame([(1.0,), (2.5,), (None,)], "v double")
    assert rows(cv.map_values(df, "v", {"1.0": "one"})) == [("one",), ("2.5",), (None,)]


def test_large_value_map_keeps_hot_values_and_nulls_in_place(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        hot = F.when(F.col("id") < 400, " 7").when(F.col("id") < 500, "same").when(F.col("id") < 700, F.col("id").cast("string"))
        df = spark.range(1_000).select(hot.alias("v"), F.lit("x").alias("_to"), F.create_map(F.lit("k"), "id").alias("tags"))
        pairs = {str(n): f"m{n}" for n in range(5_000)}
        table = spark.createDataFrame([*pairs.items(), ("8", None), (None, "n"), ("7", "a")], "from string, to string")
        want = sorted(("m7" if n < 400 else "same" if n < 500 else f"m{n}" if n < 700 else "None", n) for n in range(1_000))
        for value_map in (pairs, table):
            big = cv.map_values(df, "v", value_map, broadcast_bytes=1_000)
            assert big.columns == ["v", "_to", "tags"]
            assert sorted((str(r["v"]), r["tags"]["k"]) for r in big.collect()) == want
            # Rows of hot values and nulls meet only broadcast rows; the others are shuffled without them.
            plan = big._jdf.queryExecution().optimizedPlan().toString()
            assert "LeftAnti" in plan and "approx_top_k" in plan
            assert [r["_hot"] for r in cv.hot_values(df, F.trim("v"), "_hot").collect()] == ["7", "same"]
            small = cv.map_values(df, "v", value_map, into="w", broadcast_bytes=1 << 20)
            assert sorted((str(r["w"]), r["tags"]["k"]) for r in small.collect()) == want and small.columns[-1] == "w"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_values_do_not_reach_the_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("v"))
        big = cv.map_values(df, "v", {str(n): "x" for n in range(3_000)}, broadcast_bytes=10)
        assert big.filter("v = 'x'").count() == 1_500 and big.filter("v = 'hot'").count() == 10_000
        assert cv.hot_values(df, F.col("v"), "h").collect() == [("hot",)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_value_map_of_a_conversion_may_be_a_table(spark, policies):
    table = spark.createDataFrame([("POL1", "ONE"), ("none", "x")], "from string, to string")
    assert ("ONE",) in rows(cv.convert(policies, [rule("POLICY NUMBER", "ID")], {"POLICY NUMBER": table}))
    assert rows(cv.map_values(policies.limit(0), "POLICY NUMBER", table, broadcast_bytes=0)) == []


def test_bad_value_stops_or_becomes_null(policies):
    rules = [rule("policy_number", "ID"), rule("memo", "MEMO", "INTEGE")]
    with pytest.raises(Exception, match="column 'memo' as INTEGE: 'x': not a number"):
        cv.convert(policies, rules).collect()
    assert sorted(rows(cv.convert(policies, rules, on_error=cv.NULL)))[0] == ("POL1", None)
    assert rows(cv.conversion_errors(policies, rules)) == [("POL1", "memo", "INTEGE", "x", "not a number")]
    with pytest.raises(SpecError, match="memo"):
        cv.check_conversion(policies, rules)
    cv.check_conversion(policies, rules[:1])


def test_conversion_errors_reports_every_bad_cell(policies):
    rules = [rule("policy_number", "ID"), rule("cover", "C"), rule("memo", "M", "DATE", optional=True), rule("amount", "A", "INTEGE", optional=True)]
    assert sorted(rows(cv.conversion_errors(policies, rules))) == [
        ("POL1", "amount", "INTEGE", "10.5", "not a whole number"),
        ("POL1", "cover", "CODE", " fire ", "only upper-case letters, digits and spaces are allowed"),
        ("POL1", "memo", "DATE", "x", "not a date"),
    ]


def test_error_summary_counts_exactly_and_samples_alike_on_any_partitioning(spark):
    df = spark.range(4_000).select(
        F.col("id").cast("string").alias("k"), F.concat(F.lit("x"), (F.col("id") % 700).cast("string")).alias("v")
    )
    df = df.unionAll(spark.createDataFrame([("n", None), ("hot", "x1")], df.schema))
    rules = [rule("k", "K"), rule("v", "V", "INTEGE")]
    full = {}
    for _, column, kind, _, reason in rows(cv.conversion_errors(df, rules)):
        full[column, kind, reason] = full.get((column, kind, reason), 0) + 1
    seen = []
    for parts in (1, 3, 17):
        got = rows(cv.conversion_error_summary(df.repartition(parts), rules, examples=4))
        assert {row[:3]: row[3] for row in got} == full
        seen.append(sorted(got))
        (values,) = (row[4] for row in got if row[2] == "not a number")
        assert len({one["value"] for one in values}) == 4
    assert seen[0] == seen[1] == seen[2]
    assert rows(cv.conversion_error_summary(df.limit(0), rules)) == []
    with pytest.raises(SpecError):
        cv.conversion_error_summary(df, rules, examples=0)


def test_error_summary_sorts_no_rows_and_equals_a_loop(spark):
    found = [(None if i % 50 == 7 else f"k{i:04}", None if i % 90 == 0 else f"x{i % 40}" if i % 3 else f"y{i}") for i in range(1_500)]
    df = spark.createDataFrame(found + found[:30], "k string, v string")
    rules = [rule("k", "K"), rule("v", "V", "INTEGE")]
    summary = cv.conversion_error_summary(df, rules, examples=6)
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Sort [" not in plan
    lanes, count = {}, {}
    for key, column, kind, value, reason in rows(cv.conversion_errors(df, rules)):
        group = (column, kind, reason)
        count[group] = count.get(group, 0) + 1
        one = (hashlib.md5((value or "").encode()).hexdigest(), value or "", key or "")
        best = lanes.setdefault(group, {})
        best[one[0][:2]] = min(one, best.get(one[0][:2], one))
    got = {tuple(r[:3]): (r[3], [(x["value"], x["id"] or "") for x in r[4]]) for r in rows(summary)}
    assert got == {group: (n, [x[1:] for x in sorted(lanes[group].values())[:6]]) for group, n in count.items()}


FLAGS = [
    rule("policy_number", "ID"),
    rule("amount", "AMOUNT", "DECIMA"),
    rule("smoke_alarm", "FIRE", "INTEGE", optional=True),
    rule("fire_hydrant", "FIRE", "INTEGE", optional=True),
    rule("patrol", "GUARD", "INTEGE", True, True),
]


def test_lists_as_text(policies):
    got = cv.convert(policies, FLAGS, **NO_ROWS)
    assert sorted(rows(got)) == [("POL1", 10.5, "1;0", ""), ("POL2", 2.0, "", ""), ("POL3", None, "1;1", "1")]
    got = cv.convert(policies, FLAGS, list_style=cv.NAMES, **NO_ROWS)
    assert sorted(rows(got))[0] == ("POL1", 10.5, "smoke_alarm", "")


def test_lists_as_rows(policies):
    assert sorted(rows(cv.convert(policies, FLAGS)), key=str) == sorted(
        [
            ("POL1", 10.5, "1", ""),
            ("POL1", None, "0", ""),
            ("POL2", 2.0, "", ""),
            ("POL3", None, "1", "1"),
            ("POL3", None, "1", ""),
        ],
        key=str,
    )


def test_absent_list_is_empty_text(policies):
    rules = [rule("policy_number", "ID"), rule("gone", "L", "INTEGE", True, True)]
    for list_format in (cv.ROWS, cv.STRING):
        assert sorted(rows(cv.convert(policies, rules, list_format=list_format))) == [("POL1", ""), ("POL2", ""), ("POL3", "")]


def test_list_elements_by_type(spark):
    df = spark.createDataFrame([("1", "x", "1.5", " 7 ", "2023-01-05")], "a string, b string, c string, d string, e string")
    sources = [(name, F.col(name), df.schema[name].dataType) for name in df.columns]

    def joined(data_type):
        return df.select(list_to_string(flags_to_list(sources, data_type))).first()[0]

    assert joined("INTEGE") == "1;7"
    assert joined("CODE") == "1;7"
    assert joined("DECIMA") == "1.0;1.5;7.0"
    assert joined("DATE") == "31/12/1899;31/12/1899;06/01/1900;05/01/2023"


def test_numeric_list_elements(spark):
    df = spark.createDataFrame([(1.9, float("nan"), 1e300)], "a double, b double, c double")
    sources = [(name, F.col(name), df.schema[name].dataType) for name in df.columns]
    got = df.select(list_to_string(flags_to_list(sources, "INTEGE")), list_to_string(flags_to_list(sources, "DECIMA")))
    assert rows(got) == [("1", "1.9;1e+300")]


def test_explode_worked_example(spark):
    df = spark.createDataFrame(
        [("POL2002", 5.0, ["smoke_alarm", "fire_extinguisher", "sprinkler_system", "fire_hydrant"], ["CCTV", "patrol"])],
        "ID string, OTHER double, FIRE array<string>, SECURITY array<string>",
    )
    assert rows(explode_lists(df, "ID", ["FIRE", "SECURITY"])) == [
        ("POL2002", 5.0, "smoke_alarm", "CCTV"),
        ("POL2002", None, "fire_extinguisher", "patrol"),
        ("POL2002", None, "sprinkler_system", ""),
        ("POL2002", None, "fire_hydrant", ""),
    ]
    with pytest.raises(SpecError):
        explode_lists(df, "NO", ["FIRE"])


def test_bad_options(policies):
    for options in ({"list_format": "x"}, {"list_style": "x"}, {"on_error": "x"}):
        with pytest.raises(SpecError):
            cv.convert(policies, FLAGS, **options)


def test_odd_headers(spark):
    df = spark.createDataFrame([("A", 1)], "`a.b` string, `c``d` int")
    got = cv.convert(df, [rule("a.b", "X.Y"), rule("c`d", "N", "INTEGE")])
    assert got.columns == ["X.Y", "N"] and rows(got) == [("A", 1)]
