"""Readers, writers and the end-to-end runs."""

import functools
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from steploom import Band, ColumnRule, Comparison, SpecError, StageRule, analyse, run_conversion
from steploom.sources import readers, versions, writers
from steploom.sources.readers import NA_TOKENS, scan_csv, scan_stages, scan_table
from steploom.sources.writers import filtered_name, sink_converted, write_table


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=str)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_scan_csv_text_and_missing_values(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'code,name\n007,"a ""b"", c"\n"",  NA\nNA,x\n,null\n')
    assert rows(scan_csv(spark, path)) == sorted([("007", 'a "b", c'), (None, "  NA"), (None, "x"), (None, None)], key=str)


def test_scan_csv_all_tokens(spark, tmp_path):
    path = write(tmp_path / "a.csv", "v,k\n" + "".join(f'"{token}",1\n' for token in NA_TOKENS) + "none,1\n")
    assert rows(scan_csv(spark, path).filter("v is not null")) == [("none", "1")]
    assert scan_csv(spark, path).count() == len(NA_TOKENS) + 1


def test_scan_csv_refuses_records_that_do_not_fit(spark, tmp_path):
    for n, text in enumerate(("a,b\n1,2,3\n", 'a,b\n"x\ny",2\n')):
        with pytest.raises(Exception, match="(?i)malformed"):
            scan_csv(spark, write(tmp_path / f"{n}.csv", text)).collect()
    path = write(tmp_path / "m.csv", 'a,b\n"x\ny",2\n')
    assert rows(scan_csv(spark, path, multi_line=True)) == [("x\ny", "2")]


def test_scan_csv_checks_headers_of_every_file(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    write(folder / "1.csv", "a,b\n1,2\n")
    write(folder / "2.csv", "b,a\n2,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        scan_csv(spark, str(folder)).collect()


def test_scan_table_by_ending(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "p"))
    assert scan_table(spark, str(tmp_path / "p")).count() == 2
    with pytest.raises(SpecError):
        scan_table(spark, "book.xlsx")


def test_scan_stages_reads_each_table_once():
    rules = [StageRule("id", item, n, str(n), f"t{n}", "v") for item in ("P", "Q") for n in (1, 2)]
    seen = []
    got = scan_stages(None, Comparison(rules), lambda _, table: seen.append(table) or table)
    assert seen == ["t1", "t2"] and got == {"t1": "t1", "t2": "t2"}


def test_sink_converted_upper_case_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, ' a"b', ["x", "y"]), (2, "", None)], "id int, name string, items array<string>")
    sink_converted(df, path)
    sink_converted(df, path)
    got = scan_csv(spark, path)
    assert got.columns == ["ID", "NAME", "ITEMS"]
    assert rows(got) == [("1", ' a"b', "x;y"), ("2", None, None)]
    sink_converted(df, path + "_p", "parquet")
    assert scan_table(spark, path + "_p").columns == ["ID", "NAME", "ITEMS"]
    with pytest.raises(SpecError):
        write_table(df, path, "excel")


def test_run_conversion(spark, tmp_path):
    path = write(tmp_path / "in.csv", "Policy Number,smoke,hydrant,premium\nP1,1,0,10.123456\nP2,,,\n")
    rules = [
        ColumnRule("policy_number", "policy", "CODE"),
        ColumnRule("premium", "premium", "DECIMA"),
        ColumnRule("smoke", "fire", "INTEGE", True, True),
        ColumnRule("hydrant", "fire", "INTEGE", True, True),
    ]
    run_conversion(spark, path, rules, str(tmp_path / "out"))
    got = scan_csv(spark, str(tmp_path / "out"))
    assert got.columns == ["POLICY", "PREMIUM", "FIRE"]
    assert rows(got) == sorted([("P1", "10.1235", "1"), ("P1", None, "0"), ("P2", None, None)], key=str)


def _result(spark):
    rules = [StageRule("id", "Prop erty", n, name, "t", f"v{n}") for n, name in ((1, "Start"), (2, "Excess / Change"))]
    df = spark.createDataFrame([("A", 1.0, 2.0), ("B", 2.0, 2.0)], "id string, v1 double, v2 double")
    return analyse({"t": df}, Comparison(rules), (Band("none", 0.0), Band("up", 0.5)), ["v1"])


@pytest.mark.parametrize("file_type", ["csv", "parquet"])
def test_sink_impact(spark, tmp_path, file_type):
    paths = _result(spark).write(str(tmp_path / "out"), file_type)
    read = (lambda path: scan_csv(spark, path)) if file_type == "csv" else spark.read.parquet
    assert read(paths["merged_data"]).count() == 2
    assert read(paths["summary_table"]).columns == ["Item", "Start", "Excess / Change"]
    assert [str(v) for v in rows(read(paths["summary_table"]))[0]] == ["Prop erty", "3.0", "4.0"]
    got = read(paths["band_distribution"])
    assert got.columns == ["Item", "Step", "StepName", "Segment", "Band", "Count", "Percentage"]
    assert [str(v) for v in rows(got.filter("Step = 0 and Band = 'up'"))[0]] == ["Prop erty", "0", "Overall", "NB", "up", "1", "50.0"]


def test_sink_filtered(spark, tmp_path):
    result = _result(spark)
    path = result.export("Prop erty", 1, 0.5, 1.0, str(tmp_path), "20240101_000000")
    assert os.path.basename(path) == "filtered_data_Prop_erty_Excess___Change_NB_20240101_000000"
    assert [row[0] for row in rows(scan_csv(spark, path))] == ["A"]
    assert filtered_name(result.comparison, "Prop erty", 0, "NB", "x") == "filtered_data_Prop_erty_Overall_NB_x"
    with pytest.raises(SpecError):
        result.export("Prop erty", 1, -2, 1.0, str(tmp_path), "x")


def test_failing_conversion_leaves_the_earlier_output(spark, tmp_path):
    rules = [ColumnRule("a", "A", "CODE"), ColumnRule("b", "B", "INTEGE")]
    good, bad, out = (str(tmp_path / name) for name in ("good.parquet", "bad.parquet", "out"))
    spark.createDataFrame([("X1", "5")], "a string, b string").write.parquet(good)
    spark.createDataFrame([("not a code!", "5")], "a string, b string").write.parquet(bad)
    run_conversion(spark, good, rules, out)
    with pytest.raises(Exception, match="not a code!"):
        run_conversion(spark, bad, rules, out)
    assert [tuple(r) for r in readers.scan_csv(spark, out).collect()] == [("X1", "5")]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["bad.parquet", "good.parquet", "out"]
    run_conversion(spark, good, rules, out)
    assert readers.scan_csv(spark, out).count() == 1


def test_conversion_with_a_reader_of_its_own(spark, tmp_path):
    source = tmp_path / "in.txt"
    source.write_text('a;b\n"X\n1";5\n')
    rules = [ColumnRule("a", "A", "CODE"), ColumnRule("b", "B", "INTEGE")]
    read = functools.partial(readers.scan_csv, delimiter=";", multi_line=True)
    got = run_conversion(spark, str(source), rules, str(tmp_path / "out"), read=read)
    assert [tuple(r) for r in got.collect()] == [("X\n1", 5)]
    with pytest.raises(SpecError, match="no reader"):
        readers.scan_table(spark, str(source))


@pytest.mark.parametrize("file_type", ["csv", "parquet"])
def test_failing_report_leaves_all_earlier_tables(spark, tmp_path, file_type, monkeypatch):
    folder = str(tmp_path / "report")
    result = _result(spark)
    result.write(folder, file_type)
    read = lambda: [rows(readers.scan_published(spark, folder, name, file_type)) for name in writers.IMPACT_TABLES]
    before = read()
    changed = result.on(result.rows.filter("id = 'A'"))

    def fail(*_):
        raise OSError("no band table")

    with monkeypatch.context() as patch:
        patch.setattr(writers, "band_table", fail)
        with pytest.raises(OSError, match="no band table"):
            changed.write(folder, file_type)
    with pytest.raises(SpecError):  # found before anything is written
        writers.sink_impact(changed.rows, changed.comparison, (), folder, file_type)
    # The last of the tables fails in its job, when the others are written.
    broken = changed.rows.withColumn("percent_diff_Prop erty_overall", F.raise_error(F.lit("bad rate")).cast("double"))
    with pytest.raises(Exception, match="bad rate"):
        changed.on(broken).write(folder, file_type)
    assert read() == before
    assert len(os.listdir(f"{folder}/_versions")) == len(os.listdir(f"{folder}/_current")) - 1 == 1  # beside the checksum file
    changed.write(folder, file_type)
    assert [len(part) for part in read()] == [1, 1, len(before[2])]


def test_reader_finds_one_whole_version_through_rewrites(spark, tmp_path):
    path = str(tmp_path / "table")
    write_table(spark.range(0, 40, 1, 4).selectExpr("0 AS version", "id"), path, "parquet")
    stop, seen, failed = threading.Event(), set(), []

    def poll():
        while not stop.is_set():
            try:
                found = {(r["version"], r["n"]) for r in scan_table(spark, path).groupBy("version").agg(F.count("id").alias("n")).collect()}
                seen.update(found)
                if len(found) != 1 or {n for _, n in found} != {40}:
                    failed.append(found)
            except Exception as error:  # noqa: BLE001
                failed.append(error)

    reader = threading.Thread(target=poll)
    reader.start()
    for n in range(1, 7):
        write_table(spark.range(0, 40, 1, 4).selectExpr(f"{n} AS version", "id"), path, "parquet", keep=4)
    stop.set()
    reader.join()
    assert not failed and len(seen) > 1
    assert scan_table(spark, path).head()["version"] == 6


def test_versions_that_no_longer_count_are_removed(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(3).write.parquet(path)  # a plain table
    assert versions.versions(spark, path) == [] and versions.current(spark, path) == path
    places = [write_table(spark.range(n), path, "parquet") for n in (4, 5, 6)]
    assert [os.path.exists(p) for p in places] == [False, True, True]
    assert versions.current(spark, path) == places[2] and scan_table(spark, path).count() == 6
    assert sorted(p for p in os.listdir(path) if not p.startswith(".")) == ["_current", "_versions"]
    with pytest.raises(ValueError):
        write_table(spark.range(1), path, keep=0)
    with pytest.raises(SpecError, match="nothing is published"):
        readers.scan_published(spark, str(tmp_path), "t")


def test_versions_published_at_the_same_time_are_both_whole(spark, tmp_path):
    path = str(tmp_path / "table")
    inner = []

    def write(place):
        inner.append(write_table(spark.range(2), path, "parquet"))
        spark.range(7).write.parquet(place(versions.TABLE))

    outer = versions.publish(spark, path, write)
    assert len(versions.versions(spark, path)) == 2
    last = max(outer, inner[0].split("/")[-2])
    assert scan_table(spark, path).count() == (7 if last == outer else 2)


def _small_ranges(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)


def _usual_ranges(spark):
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed,size", [(1, 7), (2, 40), (3, 1000), (4, 100_000)])
def test_scan_csv_split_equals_one_task(spark, tmp_path, seed, size):
    rng = random.Random(seed)
    pieces = ["a", '""', "\n", ",", "\n\n", " ", "\u00e9", "\u6f22\u5b57", '""""', "null"]

    def value():
        if rng.random() < 0.4:
            return rng.choice(["", "x", "NA", " y ", "\u6f22"])
        return '"' + "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 3, 60]))) + '"'

    end = "\r\n" if seed == 2 else "\n"
    folder = tmp_path / "many"
    folder.mkdir()
    for n in range(3):
        lines = ["k,v,w"] + [f"{n}-{k},{value()},{value()}" for k in range(rng.choice([0, 5, 40]) if n else 60)]
        write_bytes = (end.join(lines) + (end if n != 1 else "")).encode()
        (folder / f"{n}.csv").write_bytes(write_bytes)
    want = rows(scan_csv(spark, str(folder), multi_line=True))
    _small_ranges(spark, size)
    try:
        got = scan_csv(spark, str(folder), multi_line=readers.SPLIT)
        assert rows(got) == want and len(want) >= 60
        if size < 100:
            assert spark.read.text(str(folder)).rdd.getNumPartitions() > 20
    finally:
        _usual_ranges(spark)


def test_scan_csv_split_refuses_what_does_not_fit(spark, tmp_path):
    path = write(tmp_path / "m.csv", 'a,b\n"x\ny",2,3\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        scan_csv(spark, path, multi_line=readers.SPLIT).collect()
    folder = tmp_path / "parts"
    folder.mkdir()
    write(folder / "1.csv", "a,b\n1,2\n")
    write(folder / "2.csv", "b,a\n2,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        scan_csv(spark, str(folder), multi_line=readers.SPLIT).collect()
    only = write(tmp_path / "h.csv", "a,b\n")
    assert rows(scan_csv(spark, only, multi_line=readers.SPLIT)) == []
