"""Vectors, components, WARC records and the pipeline against plain loops."""

import datetime
import itertools
import pathlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from steploom.llm import decontaminate, embeddings, line_dedup, shared, simhash, toxicity, warc
from steploom.llm.components import components
from steploom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain_components(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {frozenset(y for y in root if find(y) == find(x)) for x in root}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    links += [(k, k + 1) for k in range(1000, 1060)] + [(5000, 5000 + k) for k in range(1, 80)] + links[:5] + [(7, 7)]
    table = spark.createDataFrame(links + [(None, 3), (4, None)], "a long, b long")
    by_root = {}
    for r in components(table).collect():
        by_root.setdefault(r["root"], set()).add(r["node"])
    assert set(map(frozenset, by_root.values())) == plain_components([(a, b) for a, b in links if a != b])
    assert components(table.limit(0)).count() == 0


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)  # groups take many blocks
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(4, 20))
    vectors = [rng.normal(size=20) for _ in range(60)]
    vectors += [c + rng.normal(size=20) * 0.12 for c in centres for _ in range(30)]
    vectors += [vectors[0], vectors[0] * 3, vectors[62]]
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, []), (902, [0.0] * 20), (903, [float("nan")] * 20), (904, [None] * 20), (905, [1.0, 2.0]), (None, vectors[0].tolist())]
    odd += [(906, [float("inf")] * 20)]
    table = spark.createDataFrame(rows + odd + rows[:2], "vec_id long, embedding array<double>").withColumn("id", F.lit("x"))
    unit = np.stack(vectors) / np.linalg.norm(np.stack(vectors), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    groups = plain_components([(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True)])
    least = {x: min(g) for g in groups for x in g}
    got = embeddings.near_duplicate_vectors(table).collect()
    assert len(got) == len(rows) + len(odd) + 2
    want = {i: (int(near[i].sum()) - 1, least[i]) for i in range(len(rows))}
    found = sum(r["n_links"] for r in got if r["id"] is not None and r["id"] < 900)
    total = sum(want[r["id"]][0] for r in got if r["id"] is not None and r["id"] < 900)
    assert 0.98 * total <= found <= total
    assert all(r["n_links"] <= want[r["id"]][0] and r["component"] == want[r["id"]][1] for r in got if r["id"] is not None and r["id"] < 900)
    assert all(r["n_links"] == 0 and r["component"] == r["id"] for r in got if r["id"] is None or r["id"] >= 900)
    assert embeddings.near_duplicate_vectors(table.limit(0)).count() == 0


def pairs_at(rng, dim, n, low, high):
    """Pairs of vectors whose cosines lie between these."""
    x, other = rng.normal(size=(n, dim)), rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other -= (other * x).sum(axis=1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    c = rng.uniform(low, high, size=(n, 1))
    return np.concatenate([x, c * x + np.sqrt(1 - c * c) * other])


@pytest.mark.parametrize("k", [4, 5])
def test_links_just_above_the_threshold(spark, k):
    unit = pairs_at(np.random.default_rng(k), 64, 500, 0.9001, 0.92)
    near = unit @ unit.T >= 0.9
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "vec_id long, embedding array<double>")
    got = {r["id"]: r["n_links"] for r in embeddings.near_duplicate_vectors(table, k=k).collect()}
    want = near.sum(axis=1) - 1
    assert want.sum() >= 1000 and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.99 * want.sum()


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(12)
    long, short = rng.normal(size=(3, 20)), rng.normal(size=(2, 9))
    rows = [(10 * k + c, (v + rng.normal(size=20) * 0.05).tolist()) for k, v in enumerate(long) for c in range(4)]
    rows += [(100 + 10 * k + c, (v + rng.normal(size=9) * 0.02).tolist()) for k, v in enumerate(short) for c in range(3)]
    rows += [(103, rows[12][1]), (200, rng.normal(size=21).tolist()), (300, [2.0]), (301, [3.0]), (302, [-1.0])]
    both = [(0, rows[12][1])]  # an id of two lengths joins two groups
    got = {}
    for name, table in (("apart", rows), ("joined", rows + both)):
        found = embeddings.near_duplicate_vectors(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()
        got[name] = {r["id"]: (r["n_links"], r["component"]) for r in found}
    want = {10 * k + c: (3, 10 * k) for k in range(3) for c in range(4)}
    want |= {i: (3, 100) for i in range(100, 104)} | {110 + c: (2, 110) for c in range(3)}
    want |= {200: (0, 200), 300: (1, 300), 301: (1, 300), 302: (0, 302)}
    assert got["apart"] == want
    want |= {0: (7, 0)} | {i: (4, 0) for i in range(100, 104)}
    assert got["joined"] == want


@pytest.mark.parametrize(("dim", "k", "probes"), [(9, 2, 2), (20, 3, 4), (64, 4, 8), (40, 3, 6)])
def test_probes_are_the_likeliest_buckets(dim, k, probes):
    # Of very short vectors, whose rotations have few different numbers, choices can tie.
    unit = np.random.default_rng(dim).normal(size=(30, dim))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    stands = embeddings.cross_polytope(unit, k, 2, probes)
    signs, size = np.random.default_rng(embeddings.SEED), 1 << (dim - 1).bit_length()
    padded = np.pad(unit, ((0, 0), (0, size - dim)))
    for t in range(2):
        turns = []
        for _ in range(k):
            turned = padded
            for _ in range(3):
                turned = embeddings.hadamard(turned * signs.choice([-1.0, 1.0], size))
            turns.append(turned)
        for v in range(len(unit)):
            axes = [sorted(((abs(x), 2 * a + (x < 0)) for a, x in enumerate(turned[v])), reverse=True)[: embeddings.CHOICES] for turned in turns]
            buckets = []
            for choice in itertools.product(*axes):
                number = 0
                for _, axis in choice:
                    number = number * 2 * size + int(axis)
                buckets.append((sum((best[0][0] - length) ** 2 for best, (length, _) in zip(axes, choice, strict=True)), number))
            assert stands[v, t].tolist() == [number for _, number in sorted(buckets)[:probes]]


def test_tables_stay_few_as_hashes_grow():
    few = [(k, embeddings.probes_of(k), embeddings.tables_needed(64, k, 0.9)) for k in (3, 4, 5)]
    assert [(k, p) for k, p, _ in few] == [(3, 4), (4, 8), (5, 16)] and all(tables <= 26 for *_, tables in few)
    assert [embeddings.hashes_needed(64, n) for n in (2, 60_000, 4_000_000, 250_000_000)] == [1, 3, 4, 5]


def test_pairs_count_where_they_meet_first():
    rng = np.random.default_rng(5)
    marks = rng.integers(0, 40, size=(60, 4, 3)).astype(np.uint32)  # tables are likely to share buckets
    marks += (np.arange(3) * 40).astype(np.uint32) * (rng.random((60, 4, 1)) < 0.2)
    i, j, group = embeddings._pairs_within(np.array([60]))
    assert len(i) == 60 * 59 // 2 and (i < j).all() and not group.any()
    counted = np.zeros(len(i), dtype=int)
    for t in range(4):
        for bucket in np.unique(marks[:, t]):
            stands = (marks[:, t] == bucket).any(axis=1)
            pairs = np.flatnonzero(stands[i] & stands[j])
            same = np.full(len(pairs), t), np.full(len(pairs), bucket, dtype=np.uint32)
            counted[pairs] += embeddings._count_here(marks, i[pairs], j[pairs], *same)
    meets = [any(marks[a, t, 0] in marks[b, t] or marks[b, t, 0] in marks[a, t] for t in range(4)) for a, b in zip(i, j, strict=True)]
    assert counted.tolist() == [int(m) for m in meets] and 0 < sum(meets) < len(meets)


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(5, 16))
    matrix = embeddings.hadamard(np.eye(16))
    assert np.allclose(matrix @ matrix.T, np.eye(16)) and np.allclose(x @ matrix, embeddings.hadamard(x))


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://www.Example.com:80/a/b/?z=1&a=2&utm_source=x#top", "example.com/a/b?a=2&z=1"),
        ("https://user@example.com/", "example.com"),
        ("https://example.com?sid=3", "example.com"),
        (" not a url ", "not a url"),
        ("", None),
        (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).head()[0] == want


@pytest.mark.parametrize("block_records", [3, 1_000])
def test_revisits(spark, block_records):
    rng = random.Random(11)
    day = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        kind = rng.choice(["response", "revisit", "revisit", "metadata"])
        tag = rng.choice([None, '"a"', 'W/"a"', '"b"'])
        headers = {"ETag": tag, "Content-Length": str(i), "X": "new" if kind == "revisit" else "old", "Last-Modified": rng.choice([None, "m", "n"])}
        headers = None if rng.random() < 0.05 else {k: v for k, v in headers.items() if v is not None}
        site = rng.choice(["hot"] * 5 + ["b", "c", None])
        url = site and rng.choice(["http://{}.org/p", "https://www.{}.org/p/#x"]).format(site)
        moment = None if rng.random() < 0.03 else day + datetime.timedelta(minutes=rng.randrange(60))
        rows.append((i, kind, url, moment, rng.choice([200, 200, 200, 404]) if kind == "response" else 304, headers))
    rows += [r for r in rows if r[1] == "revisit"][:2]
    table = spark.createDataFrame(rows, "record_id long, kind string, url string, captured timestamp, status int, headers map<string,string>")
    table = table.withColumn("page", F.lit(1)).withColumn("block", F.lit("x")).withColumn("refers_to", F.lit(0))
    got = warc.resolve_revisits(table, block_records).collect()
    name = lambda u: u and u.replace("https://www.", "").replace("http://", "").replace("/#x", "")
    want = []
    for i, kind, url, moment, _, headers in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[1] == "response" and r[4] == 200 and url and moment and r[3] and name(r[2]) == name(url) and r[3] < moment]
        best = max(earlier, key=lambda r: (r[3], r[0]), default=None)
        own = {k.lower(): v for k, v in (headers or {}).items()}
        old = {k.lower(): v for k, v in (best[5] or {}).items()} if best else {}
        opaque = lambda t: t and t.removeprefix("W/")
        a, b, c, d = opaque(own.get("etag")), opaque(old.get("etag")), own.get("last-modified"), old.get("last-modified")
        if not best:
            outcome = "no_response"
        elif a and b:
            outcome = "resolved" if a == b else "etag_differs"
        elif c and d:
            outcome = "resolved" if c == d else "modified_later"
        else:
            outcome = "no_validator"
        merged = {**old, **{k: v for k, v in own.items() if k not in warc.NOT_MERGED}} if outcome == "resolved" else own
        want.append((i, best and best[0], outcome, sorted(merged.items())))
    order = lambda v: (v[0], v[2])
    assert sorted(((r["record_id"], r["refers_to"], r["outcome"], sorted(r["headers"].items())) for r in got), key=order) == sorted(want, key=order)
    assert {w[2] for w in want} >= {"resolved", "no_response", "etag_differs"}
    assert warc.resolve_revisits(table.limit(0)).count() == 0


def test_record_ids_may_repeat(spark):
    day = datetime.datetime(2024, 1, 1)
    at = lambda minutes: day + datetime.timedelta(minutes=minutes)
    full = lambda i, url, minute, tag: (i, "response", url, at(minute), 200, {"etag": tag})
    asks = lambda i, url, minute, tag: (i, "revisit", url, at(minute), 304, {"etag": tag})
    rows = [
        full(1, "http://a.org/", 0, "x"), full(1, "http://b.org/", 0, "y"), full(1, "http://b.org/", 5, "z"), full(None, "http://c.org/", 0, "n"),
        asks(2, "http://a.org/", 9, "x"), asks(2, "http://b.org/", 9, "z"), asks(2, "http://b.org/", 3, "y"), asks(None, "http://c.org/", 9, "n"),
    ]
    # One response asked for very often, and as many revisits without an answer.
    rows += [full(7, "http://hot.org/", 0, "h"), *[asks(100 + i, "http://hot.org/" if i % 2 else None, 10, "h") for i in range(400)]]
    table = spark.createDataFrame(rows, "record_id long, kind string, url string, captured timestamp, status int, headers map<string,string>")
    got = [(r["record_id"], r["url"], r["refers_to"], r["outcome"]) for r in warc.resolve_revisits(table).collect()]
    assert sorted(g for g in got if (g[0] or 0) == 2) == [(2, "http://a.org/", 1, "resolved")] + [(2, "http://b.org/", 1, "resolved")] * 2
    assert [g[2:] for g in got if g[0] is None] == [(None, "resolved")]
    hot = [g for g in got if (g[0] or 0) >= 100]
    assert len(hot) == 400 and {g[1:] for g in hot} == {("http://hot.org/", 7, "resolved"), (None, None, "no_response")}


def test_pipeline_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, benchmark = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = docs
    scored = toxicity.toxicity(want, toxicity.fit_toxicity(want, labels)).select("row.doc_id", "score")
    want = want.join(scored.filter("score < 0.7").select("doc_id"), "doc_id")
    kept = line_dedup.drop_frequent_lines(want).select("row.*", "kept").drop("text", "n_chars")
    want = kept.withColumnRenamed("kept", "text").withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)
    firsts = simhash.near_duplicates(want).filter("id = component").select(F.col("id").alias("doc_id"))
    want = want.join(firsts, "doc_id")
    bad = decontaminate.contamination(want, benchmark).filter(decontaminate.is_contaminated()).select(F.col("id").alias("doc_id"))
    want = want.join(bad, "doc_id", "left_anti")
    got = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, SF)
        assert got.columns == docs.columns
    order = lambda df: sorted(map(tuple, df.select(docs.columns).collect()))
    assert order(got) == order(want) and 0 < got.count() < docs.count()
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == got.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    for r in packed.select("length", "ids_crc32", "ids").collect():
        ids = np.array(r["ids"], dtype="<u4")
        assert (len(ids), zlib.crc32(ids.tobytes())) == (r["length"], r["ids_crc32"])


def test_pipeline_stages_on_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, n_chars long, id long, row string, text_hash int, score string, kept string, line int"
    rest = ("en", 5, 1, "r", 2, "s", "k", 3)
    rows = [(1, "a quiet evening by the river"), (1, "a quiet evening by the river"), (2, None), (3, ""), (None, None), (None, "one more text of its own")]
    docs = spark.createDataFrame([(*r, *rest) for r in rows] + [(4, "nulls " * 30, *[None] * 8)], schema)
    got = docs
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0
        got = shared.written(stage(spark, got, SF), "stage")
        assert got.columns == docs.columns
        counts.append(got.count())
    assert counts == [7, 7, 4, 4]
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == {(1, rows[0][1]), (2, got.filter("doc_id = 2").head()["text"]), (None, rows[5][1]), (4, "nulls " * 30)}
    pack = corpus_pipeline.STAGES[-1][1]
    assert pack(spark, docs, SF).count() == 7 and pack(spark, docs.limit(0), SF).count() == 0


def test_every_operator_has_one_query():
    numbers = sorted(int(name.split("_")[0][2:]) for name in QUERIES)
    assert numbers == list(range(1, 14))


def test_clean_up_removes_what_this_application_wrote(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_folder", lambda _: str(tmp_path))
    (tmp_path / "of-others").mkdir()
    assert shared.written(spark.range(5), "numbers").count() == 5
    assert len(list(tmp_path.iterdir())) == 2
    shared.clean_up(spark)
    assert [p.name for p in tmp_path.iterdir()] == ["of-others"]
    shared.clean_up(spark)
    assert shared.written(spark.range(3), "numbers").count() == 3


def test_folder_of_a_session_that_names_none():
    class Context:
        applicationId, master = "application-of-test", "local[2]"

    class Session:
        sparkContext, conf = Context, {"spark.other": "x"}

    folder = shared.shared_folder(Session)
    assert folder == shared.shared_folder(Session) and pathlib.Path(folder).is_dir()
    Context.master = "spark://somewhere:7077"
    with pytest.raises(ValueError, match="share"):
        shared.shared_folder(Session)
