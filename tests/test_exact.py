"""Exact sums of doubles against exact fractions, whatever the partitions."""

import math
import random
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F

from steploom import Comparison, StageRule
from steploom.functions.exact import exact_totals
from steploom.operators import summary as sm


def values(rng, kind, n):
    if kind == "usual":
        return [rng.uniform(-1e6, 1e6) for _ in range(n)]
    if kind == "any":
        return [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randint(-1070, 1000) for _ in range(n)]
    if kind == "cancelled":
        some = [rng.uniform(-1, 1) * 10 ** rng.randint(-20, 20) for _ in range(n)]
        return [*some, *[-x for x in some], 5e-324, 5e-324]
    if kind == "subnormal":
        return [5e-324 * rng.randint(-(2**60), 2**60) for _ in range(n)]
    if kind == "ties":
        return [2.0**53, 1.0, *[2.0 ** -rng.randint(0, 60) for _ in range(n)]]
    return [0.0, -0.0, 1e308, 1e308, -1e308, 1.0]


def test_sums_equal_exact_fractions(spark):
    rng = random.Random(3)
    kinds = ("usual", "any", "cancelled", "subnormal", "ties", "large")
    rows = [(f"{k}/{i}", x) for k in kinds for i in range(4) for x in values(rng, k, rng.choice([1, 2, 9, 120]))]
    want = {}
    for group, x in rows:
        want[group] = want.get(group, 0) + Fraction(x)
    got = exact_totals(spark.createDataFrame([*rows, ("null", None)], "g string, x double"), {"t": F.col("x")}, ["g"]).collect()
    assert {r["g"]: r["t"] for r in got} == {group: float(total) for group, total in want.items()}


def test_infinities_nans_and_no_rows(spark):
    df = spark.createDataFrame([(math.inf, math.nan, math.inf, 1e308), (1.0, 2.0, -math.inf, 1e308)], "a double, b double, c double, d double")
    columns = {c: F.col(c) for c in df.columns}
    row = exact_totals(df, columns).head()
    assert row["a"] == math.inf and math.isnan(row["b"]) and math.isnan(row["c"]) and row["d"] == math.inf
    assert exact_totals(df.select(*[(-F.col(c)).alias(c) for c in df.columns]), columns).head()["a"] == -math.inf
    assert [tuple(r) for r in exact_totals(df.limit(0), columns).collect()] == [(0.0,) * 4]
    assert exact_totals(df.limit(0), columns, ["a"]).collect() == []


def test_stage_totals_do_not_depend_on_partitions(spark):
    """A million doubles of mixed magnitude, partitioned and ordered in twenty ways."""
    rng = random.Random(8)
    numbers = [(rng.random() - 0.5) * 2.0 ** rng.uniform(-60, 60) for _ in range(1_000_000)]
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(numbers)), "P_1": numbers, "P_2": [-x for x in numbers]}))
    df = df.withColumn("Q_1", F.lit(1).cast("decimal(5,2)"))
    rules = [StageRule("id", "P", 1, "a", "t", "P_1"), StageRule("id", "P", 2, "b", "t", "P_2"), StageRule("id", "Q", 1, "c", "t", "Q_1")]
    comparison = Comparison(rules)
    names = [comparison.column(rule) for item in comparison.items for rule in comparison.stages(item)]
    df = df.withColumnsRenamed(dict(zip(("P_1", "P_2", "Q_1"), names, strict=True)))
    total = math.fsum(numbers)
    for n in range(20):
        dealt = df.repartition(1 + n % 9, F.xxhash64("id", F.lit(n)))
        assert tuple(sm.stage_totals(dealt, comparison).head()) == (total, -total, 1_000_000)


def test_breakdown_of_doubles_is_exact_on_every_level(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.choice([1, None]), rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9), rng.uniform(-1, 1), None) for i in range(600)]
    rules = [StageRule("id", "P", 1, "a", "t", "v"), StageRule("id", "P", 2, "b", "t", "w"), StageRule("id", "N", 1, "c", "t", "n")]
    comparison = Comparison(rules)
    names = [comparison.column(rule) for item in comparison.items for rule in comparison.stages(item)]
    df = spark.createDataFrame(rows, "id int, k0 string, _of int, v double, w double, n float").toDF("id", "k0", "_of", *names)
    got = sm.breakdown_rollup(df, comparison, ["k0", "_of"]).filter("item = 'P'").collect()
    for row in got:
        held = [r for r in rows if (row["level"] == "grand_total") or (r[1] == row["k0"] and (row["level"] != "detail" or r[2] == row["_of"]))]
        assert row["value_total_start"] == math.fsum(r[3] for r in held) and row["value_total_end"] == math.fsum(r[4] for r in held)
        assert row["policy_count"] == len(held)
    detail = [tuple(r) for r in sm.breakdown(df, comparison, ["k0", "_of"]).collect()]
    assert detail == [tuple(r)[:1] + tuple(r)[2:] for r in sm.breakdown_rollup(df, comparison, ["k0", "_of"]).filter("level = 'detail'").collect()]
    assert [r[3:5] for r in detail if r[0] == "N"] == [(0.0, 0.0)] * 4
