"""Random small tables against plain loops: merge, differences, bands, breakdown, list explode."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from steploom import Band, Comparison, StageRule, analyse
from steploom.operators.lists import explode_lists
from steploom.operators.summary import breakdown_rollup

BANDS = (Band("down", -0.6), Band("flat", -0.1), Band("up", 0.1), Band("double", 1.0))
SCHEMA = pa.schema([("id", pa.string()), ("seq", pa.int64()), ("v", pa.int64()), ("seg", pa.string())])


def snapshot(rng, size):
    order = rng.sample(range(1000), size)
    return [
        {
            "id": rng.choice([None, "a", "a", "a", *"bcdefgh", ""]),
            "seq": seq,
            "v": rng.choice([None, 0, *range(1, 12)]),
            "seg": rng.choice([None, "", " ", "x", "y"]),
        }
        for seq in order
    ]


def merged_by_hand(tables):
    firsts = []
    for rows in tables:
        first = {}
        for row in sorted(rows, key=lambda row: row["seq"]):
            first.setdefault(row["id"], row)
        firsts.append(first)
    common = set.intersection(*map(set, firsts))
    merged = []
    for key in common:
        seg = firsts[0][key]["seg"]
        merged.append(
            {
                "id": key if key is None or key.strip() else None,
                "seg": seg if seg is not None and seg.strip() else None,
                "values": [first[key]["v"] for first in firsts],
            }
        )
    return merged


def change(start, end):
    return (end - start) / start if start and end is not None else None


def band_of(value):
    if value is None:
        return "Missing"
    return next((band.name for band in reversed(BANDS) if value >= band.start), "Out of Range")


@pytest.mark.parametrize("seed", range(4))
def test_comparison(spark, seed):
    rng = random.Random(seed)
    tables = [snapshot(rng, rng.choice([5, 30, 60])) for _ in range(3)]
    frames = {f"t{n}": spark.createDataFrame(pa.Table.from_pylist(rows, schema=SCHEMA)) for n, rows in enumerate(tables)}
    comparison = Comparison([StageRule("id", "P", n + 1, f"S{n + 1}", f"t{n}", "v") for n in range(3)])
    result = analyse(frames, comparison, BANDS, ["seq"], keep=["seg"])
    rows = result.rows.cache()
    want = merged_by_hand(tables)

    got = [(row.id, row.seg, row.P_1, row.P_2, row.P_3) for row in rows.collect()]
    assert Counter(got) == Counter((row["id"], row["seg"], *row["values"]) for row in want)

    counts = Counter()
    for row in want:
        a, b, c = row["values"]
        for step, pair in enumerate([(a, c), (a, b), (b, c)]):
            counts[step, band_of(change(*pair))] += 1
    found = {(row.step, row.band): row["count"] for row in result.on(rows).distribution().collect()}
    assert {key: count for key, count in found.items() if count} == dict(counts)
    assert all((step, band.name) in found for step in range(3) for band in BANDS)

    sums = defaultdict(lambda: [0, 0, 0])
    for row in want:
        for key in (("detail", row["seg"]), ("grand_total", None)):
            sums[key][0] += row["values"][0] or 0
            sums[key][1] += row["values"][2] or 0
            sums[key][2] += 1
    totals = {
        (row.level, row.seg): [row.value_total_start, row.value_total_end, row.policy_count]
        for row in breakdown_rollup(rows, comparison, ["seg"]).collect()
    }
    assert totals == dict(sums)
    rows.unpersist()


@pytest.mark.parametrize("seed", range(3))
def test_explode(spark, seed):
    rng = random.Random(seed)
    table = [
        {"ID": str(n), "A": [rng.choice("xyz") for _ in range(rng.randrange(4))], "V": n, "B": [rng.choice("pq") for _ in range(rng.randrange(3))]}
        for n in range(40)
    ]
    schema = pa.schema([("ID", pa.string()), ("A", pa.list_(pa.string())), ("V", pa.int64()), ("B", pa.list_(pa.string()))])
    df = spark.createDataFrame(pa.Table.from_pylist(table, schema=schema))
    want = Counter()
    for row in table:
        for n in range(max(len(row["A"]), len(row["B"]), 1)):
            a = row["A"][n] if n < len(row["A"]) else ""
            b = row["B"][n] if n < len(row["B"]) else ""
            want[row["ID"], a, row["V"] if n == 0 else None, b] += 1
    assert Counter(tuple(row) for row in explode_lists(df, "ID", ["A", "B"]).collect()) == want
