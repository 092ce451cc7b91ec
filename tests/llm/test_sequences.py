"""Operators 11 to 13 against plain loops, and their behaviour on awkward tables."""

import collections
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from steploom.llm import alignment, periodic, queries, sharding
from steploom.llm.queries import PIECE_MODEL, QUERIES, TOKENIZER

SF = "/root/testdata/sf0.001"
AWKWARD = [
    (1, "a b a b a b a b a b", "x"), (1, "a b a b a b a b a b", "x"), (None, None, None), (None, "", "y"), (2, " \n\t ", None), (3, "a b <s> <|endoftext|>", "z"),
]


def awkward(spark):
    """Null ids and texts, repeated rows, blank texts, and columns named like those of the operators."""
    rows = spark.createDataFrame(AWKWARD, "doc_id long, text string, id string")
    return rows.withColumn("row", F.lit(1)).withColumn("shard", F.lit("s")).withColumn("runs", F.lit(0)).withColumn("place", F.lit(7))


# Periodic runs


def brute_runs(words, power=4, least=6):
    n, out = len(words), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            if len(run) >= max(least, power * q) and not any(all(run[k] == run[k + p] for k in range(len(run) - p)) for p in range(1, q)):
                out.append((i, len(run), q))
            i = j
    return sorted(out, key=lambda run: (run[0], run[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.integers(1, 9), st.integers(0, 40), st.sampled_from([(4, 6), (2, 1), (3, 5)]))
def test_runs_equal_brute_force(words, period, repeated, limits):
    words = words + [(words or [1])[-(i % min(period, len(words) or 1)) - 1] for i in range(repeated)]
    assert periodic.periodic_runs(np.array(words, dtype=np.int64), *limits) == brute_runs(words, *limits)


def test_runs_of_large_ordered_sets():
    assert periodic.periodic_runs(np.ones(5_000, dtype=np.int64)) == [(0, 5_000, 1)]
    words = np.tile(np.arange(1, 301), 9)
    assert periodic.periodic_runs(words) == [(0, 2_700, 300)]
    fibonacci, longer = [1], [1, 2]
    while len(longer) < 3_000:
        fibonacci, longer = longer, longer + fibonacci
    assert periodic.periodic_runs(np.array(longer), 3, 2) == brute_runs(longer[:], 3, 2)


def test_run_needs_two_periods():
    with pytest.raises(ValueError):
        periodic.periodic_runs(np.ones(3, dtype=np.int64), power=1)


def test_periodic_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op12_periodic"](spark, SF).collect()
    assert len(got) == len(docs)
    planted = 0
    for row in got:
        words = (docs[row["doc_id"]] or "").encode().split()
        h = zlib.crc32(str(row["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words) if n <= 400 else periodic.periodic_runs(periodic.word_numbers(words))
        planted += bool(runs)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want = (row["doc_id"], len(runs), *best, 1000 * best[1] // best[2] if runs else None)
        assert tuple(row) == (*want, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    assert planted


def test_runs_of_awkward_tables(spark):
    found = periodic.find_runs(awkward(spark))
    rows = sorted(map(tuple, found.collect()), key=str)
    run = [(0, 10, 2)]
    want = [(1, 10, run, "a b"), (1, 10, run, "a b"), (None, 0, [], ""), (None, 0, [], ""), (2, 0, [], ""), (3, 3, [], "a b <s> <|endoftext|>")]
    assert [(i, n, [tuple(r) for r in runs], text) for i, n, runs, text in rows] == sorted(want, key=str)
    assert periodic.find_runs(awkward(spark).filter("false")).collect() == []


def test_planted_runs_of_null_and_blank_texts(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = [(ids[0], None), (ids[1], " \t "), (ids[2], "\n one\x0btwo  three "), (None, "a b")]
    got = queries.with_planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["text"] is None or len(r["text"].split()) for r in got] == [True, 0, 3, 2]


# Alignment


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(TOKENIZER)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PIECE_MODEL)


def plain_alignment(text, libraries):
    """Groups and links (by counting bytes) as the libraries have them; None without tokens."""
    if not text:
        return None
    pair = alignment.pair_of(TOKENIZER, PIECE_MODEL)
    a, b = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    parts_a, parts_b = [pair.bytes_a[i] for i in a], [pair.bytes_b[i] for i in b]
    if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
        return None
    of_a = [k for k, x in enumerate(parts_a) for _ in x]
    of_b = [k for k, x in enumerate(parts_b) for _ in x]
    groups, links, first = [], sorted(set(zip(of_a, of_b, strict=True))), 0
    for at in range(len(of_a)):
        if at + 1 == len(of_a) or (of_a[at] != of_a[at + 1] and of_b[at] != of_b[at + 1]):
            groups.append([",".join(map(str, dict.fromkeys(of[first : at + 1]))) for of in (of_a, of_b)])
            first = at + 1
    named = lambda part, ids: ",".join(str(ids[int(k)]) for k in part.split(","))
    text_of = ";".join(f"{named(x, a)}|{named(y, b)}" for x, y in groups)
    return len(a), len(b), len(groups), text_of, [(a[x], b[y]) for x, y in links]


LETTERS = [
    *"ab é\n\t '.1(", "\r", "日本", "😀", " ", "　", "▁", " the", "ing", "'ll", "<s>", "<|endoftext|>", "<0x41>", "\0", "\x1c", "ﬁ", "  ", "\n\n", "\x85",
]


def checked(texts, libraries):
    pair = alignment.pair_of(TOKENIZER, PIECE_MODEL)
    done, start = alignment.align(pair.tokens(texts), pair), 0
    for k, text in enumerate(texts):
        end = done.ends[k]
        pairs = dict(zip(done.pairs[start:end].tolist(), done.times[start:end].tolist(), strict=True))
        got = (done.n_a[k], done.n_b[k], done.n_groups[k], done.groups[k].decode())
        want = plain_alignment(text, libraries)
        if want is None:
            assert got == (0, 0, 0, "") and not pairs and done.n_links[k] == 0
        else:
            assert got == want[:4], text
            assert pairs == collections.Counter(y * pair.size_a + x for x, y in want[4]) and done.n_links[k] == len(want[4])
        start = end


def test_alignment_equals_plain_loop(libraries):
    rng = random.Random(5)
    texts = ["".join(rng.choices(LETTERS, k=rng.randint(0, 30))) for _ in range(1_500)]
    texts += ["".join(rng.choices([*"abc de\n .1", " the", "ing", "日"], k=rng.randint(0, 60))) for _ in range(1_500)]
    for at in range(0, len(texts), 250):
        checked([*texts[at : at + 250], None], libraries)
    checked(["x" * 3_000, "日本語" * 500, " ", "", "é" * 999], libraries)


def test_cuts_are_found_wherever_they_are():
    rng = random.Random(2)
    for _ in range(300):
        top = rng.randint(1, 60)
        a = sorted({*rng.sample(range(1, top + 1), rng.randint(0, top)), top})
        b = sorted({*rng.sample(range(1, top + 1), rng.randint(0, top)), top})
        ends = [np.array(x, dtype=np.int32) for x in (a, b)]
        cuts_a, cuts_b = alignment.shared_cuts(*ends, np.array([0, len(a)], np.int32), np.array([0, len(b)], np.int32))
        want = sorted({*a} & {*b})
        assert [a[i - 1] for i in cuts_a[1:]] == want == [b[i - 1] for i in cuts_b[1:]]


def test_alignment_query_equals_plain_loop(spark, libraries):
    docs = {r["doc_id"]: plain_alignment(r["text"], libraries) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = collections.Counter(link for d in docs.values() if d for link in d[4])
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    got = {r["doc_id"]: r for r in QUERIES["op11_alignment"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, want in docs.items():
        row = got[i]
        n_a, n_b, n_groups, text, links = want or (0, 0, 0, None, [])
        assert (row["n_a"], row["n_b"], row["n_groups"], row["n_links"]) == (n_a, n_b, n_groups, len(links))
        assert row["groups_sha256"] == ("" if text is None else hashlib.sha256(text.encode()).hexdigest())
        assert row["n_best"] == sum(counts[x] == best[x[1]] for x in links)
        assert row["count_sum"] == sum(counts[x] for x in links)


def test_counts_joined_by_shuffle_are_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60")
    aligned = alignment.aligned_texts(docs, TOKENIZER, PIECE_MODEL)
    size = alignment.pair_of(TOKENIZER, PIECE_MODEL).size_a
    few = alignment.with_link_counts(aligned, size).collect()
    monkeypatch.setattr("steploom.llm.shared.BROADCAST_ROWS", 0)
    assert sorted(few) == sorted(alignment.with_link_counts(aligned, size).collect())


def test_alignment_of_awkward_tables(spark):
    size = alignment.pair_of(TOKENIZER, PIECE_MODEL).size_a
    found = alignment.with_link_counts(alignment.aligned_texts(awkward(spark), TOKENIZER, PIECE_MODEL), size)
    rows = found.collect()
    assert sorted((r["n_a"], r["groups"] is None) for r in rows)[:2] == [(0, True)] * 2
    assert [r["n_best"] for r in rows if r["id"] == 1] == [r["n_links"] for r in rows if r["id"] == 1] != []
    assert alignment.with_link_counts(alignment.aligned_texts(awkward(spark).filter("false"), TOKENIZER, PIECE_MODEL), size).collect() == []


# Sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 16, 17, 200, 9_973])
def test_places_are_a_permutation_and_its_inverse(n):
    for seed in (0, 5):
        places = [sharding.place_of(i, n, seed) for i in range(n)]
        assert sorted(places) == list(range(n))
        assert [sharding.row_at(p, n, seed) for p in places] == list(range(n))


def test_places_look_random():
    n = 40_000
    places = np.array([sharding.place_of(i, n) for i in range(n)])
    assert abs(np.corrcoef(np.arange(n), places)[0, 1]) < 0.02
    # Neighbours go to unrelated shards, and each block of rows is spread over all shards.
    assert abs(np.mean(places[1:] % 40 == places[:-1] % 40) - 1 / 40) < 0.005
    for block in np.split(places, 10):
        assert np.bincount(block % 40, minlength=40).min() > 50


def test_columns_walk_as_numbers_do(spark, monkeypatch):
    for n, walk in ((1, 8), (3, 8), (401, 8), (401, 1), (9_000_000_019, 8)):
        monkeypatch.setattr(sharding, "WALK", walk)
        numbers = spark.range(min(n, 401)).select((F.lit(n - 1) - F.col("id")).alias("row_number"))
        rows = sharding.with_places(numbers, n, 3).collect()
        assert all(r["place"] == sharding.place_of(r["row_number"], n, 3) for r in rows)


def test_shards_of_hot_rows_are_even(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same").alias("text"))
    found = sharding.shard_rows(rows.repartition(7), shards=8)
    per = {r["shard"]: r["slots"] for r in found.groupBy("shard").agg(F.sort_array(F.collect_list("slot")).alias("slots")).collect()}
    assert len(per) == 8 and {len(s) for s in per.values()} <= {375} and all(s == list(range(len(s))) for s in per.values())
    # The same shards whatever the partitions.
    once = sorted((r["id"], r["shard"], r["slot"]) for r in found.collect())
    again = sharding.shard_rows(rows.repartition(3, "doc_id"), shards=8)
    assert once == sorted((r["id"], r["shard"], r["slot"]) for r in again.collect())


def test_shards_of_awkward_tables(spark, tmp_path):
    docs = awkward(spark).withColumn("tags", F.create_map(F.lit("k"), F.lit("v")))
    found = sharding.shard_rows(docs, shards=4)
    rows = found.collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (3, 0)]
    assert sorted(r["size"] for r in rows) == sorted(16 + len((t or "").encode()) for _, t, _ in AWKWARD)
    assert rows[0]["row"].asDict().keys() == {"doc_id", "text", "id", "row", "shard", "runs", "place", "tags"}
    sharding.write_shards(found, f"{tmp_path}/shards", files=3)
    stored = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted((r["shard"], r["slot"]) for r in stored.collect()) == sorted((r["shard"], r["slot"]) for r in rows)
    assert sharding.shard_rows(docs.filter("false")).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_rows(docs, shards=0)
