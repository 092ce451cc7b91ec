"""Document operators against plain loops, on small tables with every awkward case."""

import itertools
import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from steploom.llm import decontaminate, language, line_dedup, packing, shared, simhash, token_files, tokens, toxicity
from steploom.llm.oracle import ORACLE
from steploom.llm.shared import new_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, id long, text_hash int, w string, s int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def made_texts(seed=5):
    rng = random.Random(seed)
    vocabulary = ["the", "Of", "straße", "ÉTÉ", "x1", "don't", "中文", "a-b", "\x0b", "zebra", "quick", "brown"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(40)]
    shared = "every  line\n\tShared LINE \nshared line\n\n" + "word " * 30
    texts += [shared + str(i % 3) for i in range(12)]
    texts += [None, "", " ", "\n", "\n\n", "one", "two words", "word " * 3000, texts[3], texts[3] + " more"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = made_texts()
    rows = [(i, t, None if i % 7 == 0 else "en", None, None, "r", -i, 1, "w", 2) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "null id", None, None, None, None, None, None, None, None), (None, None) + (None,) * 8]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def in_order(values):
    return sorted(values, key=lambda v: [(x is None, str(x)) for x in v])


def test_line_dedup(docs, rows):
    space = " \t\n\x0b\x0c\r"
    keys = [[lower(x.strip(space)) for x in (t or "").split("\n")] for _, t in rows]
    seen = Counter(k for ks in keys for k in set(ks) if k)
    want = []
    for (i, t), ks in zip(rows, keys, strict=True):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks, strict=True) if seen[k] < 10]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    out = line_dedup.drop_frequent_lines(docs, min_docs=10).select("row.doc_id", "n_lines", "n_dropped", "kept")
    assert in_order(map(tuple, out.collect())) == in_order(want)
    assert sum(w[2] for w in want) > 20
    changed = line_dedup.dedup_lines(docs)
    assert changed.columns == docs.columns and changed.count() == len(rows)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_repeated_rows_are_one_document_for_line_dedup(spark):
    rows = [(1, "only here\nand this")] * 10 + [(k, f"shared\nown {k}") for k in range(100, 109)]
    rows += [(109, "Shared \nx")] * 3 + [(k, "nine\n") for k in range(200, 209)] + [(208, "nine\nagain")] + [(None, "no id")] * 12
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = line_dedup.drop_frequent_lines(docs, min_docs=10).select("row.doc_id", "row.text", "n_dropped", "kept").collect()
    assert len(out) == len(rows)
    for r in out:
        shared = r["doc_id"] is not None and 100 <= r["doc_id"] < 110
        assert r["n_dropped"] == int(shared) and r["kept"] == (r["text"].split("\n")[1] if shared else r["text"])
    # The registered SQL counts different ids, too.
    sql = duckdb.connect()
    with_ids = [r for r in rows if r[0] is not None]
    sql.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    sql.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in dict.fromkeys(with_ids) if r[0] != 208] + [rows[0]] * 9)
    want = {i: bool(n) for i, _, n, _ in sql.execute(ORACLE["op7_line_dedup"]).fetchall()}
    assert want == {r["doc_id"]: bool(r["n_dropped"]) for r in out if r["doc_id"] not in (None, 208)}


def test_all_window_sizes_are_one_scan_and_item_sets_are_exact(spark, tmp_path):
    rng = random.Random(8)
    made = [" ".join(rng.choices("abcdefgh", k=rng.choice([0, 5, 30, 300]))) for _ in range(60)]
    items = [(k, " ".join(rng.choices("abcdefgh", k=n))) for k, n in enumerate(list(range(1, 16)) * 3)]
    common = " ".join(f"w{k}" for k in range(20))  # a passage of all items
    items += [(100 + k, f"{common} own{k}") for k in range(40)] + [(None, f"{common} no id"), (100, f"{common} own0")]
    made += [f"x y {common} z", f"{common} own7", "w3 w4 " * 30]
    spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    stored = spark.read.parquet(f"{tmp_path}/d")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for limits in ({}, {"broadcast_bytes": 0}):
        out = decontaminate.contamination(stored, benchmark, **limits)
        got = {r["id"]: (r["n_words"], r["n_hit"], list(r["items"])) for r in out.collect()}
        assert got == {k: hit_words(t, items) for k, t in enumerate(made)}
        scans = out._jdf.queryExecution().sparkPlan().toString().count(f"{tmp_path}/d")
        assert scans == (3 if limits else 2)


def hit_words(text, items, size=13):
    cut = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or "")) if x]
    words, hit, found = cut(text), set(), set()
    for item, item_text in items:
        w = cut(item_text)
        n = min(size, len(w))
        windows = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in windows:
                hit.update(range(k, k + n))
                if item is not None:
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_decontamination(spark, docs, rows, broadcast_rows):
    texts = [t for _, t in rows if t and len(t.split()) > 20]
    items = [(1, " ".join(texts[0].split()[3:19])), (2, " ".join(texts[1].split()[:14]).upper()), (3, "word " * 15), (4, None)]
    items += [(5, ""), (6, "two WORDS"), (7, "zebra quick"), (None, "one"), (2, " ".join(texts[1].split()[:14])), (9, "x1 the of")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.contamination(docs, benchmark, broadcast_rows=broadcast_rows)
    got = in_order((r["id"], r["n_words"], r["n_hit"], list(r["items"])) for r in out.collect())
    assert got == in_order((i, *hit_words(t, items)) for i, t in rows)
    assert sum(g[2] for g in got) > 100
    if broadcast_rows:
        none = decontaminate.contamination(docs, benchmark.limit(0)).agg(F.sum("n_hit"), F.count("*")).head()
        assert tuple(none) == (0, len(rows))
        kept = decontaminate.drop_contaminated(docs, benchmark)
        clean = sum(not (h and 20 * h >= n) for n, h, _ in (hit_words(t, items) for _, t in rows))
        assert kept.columns == docs.columns and kept.count() == clean


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    count = [0] * 64
    for x in shingles:
        h = xxhash.xxh64_intdigest(x.encode(), seed=42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def smallest_reachable(values, near):
    """For each (id, value): the smallest id over chains of near values."""
    distinct = sorted({v for _, v in values})
    root = {v: v for v in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in distinct:
        for b in distinct:
            if near(a, b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, v in values:
        if i is not None:
            least[find(v)] = min(i, least.get(find(v), i))
    return [(i, v, least.get(find(v))) for i, v in values]


def test_simhash(docs, rows):
    want = smallest_reachable([(i, fingerprint(t)) for i, t in rows], lambda a, b: (a ^ b).bit_count() <= 3)
    out = simhash.near_duplicates(docs).collect()
    assert in_order((r["id"], r["fingerprint"] % (1 << 64), r["component"]) for r in out) == in_order(want)
    kept = simhash.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert in_order((r["doc_id"],) for r in kept.collect()) == in_order({(c,) for _, _, c in want})
    assert simhash.keep_one_each(docs.limit(0)).count() == 0


def test_covering_masks_and_dense_buckets(spark, monkeypatch):
    rng = random.Random(3)
    for places in (list(range(64)), list(range(5, 35)), [1, 2, 3, 9]):
        kept = [set(m) for m in simhash.masks(places, 3)]
        for _ in range(300):
            differ = set(rng.sample(places, min(3, len(places))))
            assert any(not (m & differ) for m in kept)
    monkeypatch.setattr(simhash, "DENSE", 4)  # most buckets are covered again, twice
    base = [rng.getrandbits(64) for _ in range(3)]
    values = {b for b in base}
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randrange(20)
            values.add(x)
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    roots = simhash.components(simhash.near_links(spark.createDataFrame(signed, "fingerprint long")))
    got = {r["node"] % (1 << 64): r["root"] for r in roots.collect()}
    want = smallest_reachable([(k, v) for k, v in enumerate(values)], lambda a, b: (a ^ b).bit_count() <= 3)
    groups, found = {}, {}
    for _, v, c in want:
        groups.setdefault(c, set()).add(v)
        found.setdefault(got.get(v, ("alone", v)), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def whole_ids(texts):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    return [np.array([*e.ids, 0], dtype="<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_packing(docs, rows):
    out = packing.pack(packing.token_pieces(docs, TOKENIZER, max_tokens=256, keep_ids=True), max_tokens=256).collect()
    want = []
    for (i, _), ids in zip(rows, whole_ids([t for _, t in rows]), strict=True):
        first = len(ids) % 256 or 256
        starts = [0, *range(first, len(ids), 256)]
        for k, a in enumerate(starts):
            part = ids[a : (starts + [len(ids)])[k + 1]]
            want.append((i, k, a, len(part), zlib.crc32(part.tobytes())))
            assert len(part) == 256 or k == 0
    assert in_order((r["id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == in_order(want)
    for r in out:
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 256
    assert len(sequences) <= -(-sum(r["length"] for r in out) // 256) + 2
    assert packing.pack(packing.token_pieces(docs.limit(0), TOKENIZER)).count() == 0


def test_vector_choice_differs_from_that_by_tokens_alone():
    length = np.array([50.0, 50.0, 100.0, 20.0])
    demands = np.stack([length, np.ones(4), length**2], axis=1)
    capacities = np.array([128.0, 128.0, 128.0**2])
    by_tokens, _ = packing.best_fit(demands, capacities, np.array([1.0, 0.0, 0.0]))
    by_all, _ = packing.best_fit(demands, capacities, np.array([1.0, 1.0, 1.0]))
    # Both bins have 28 tokens left; that of one long piece has less attention left.
    assert by_tokens.tolist() == [0, 0, 1, 0] and by_all.tolist() == [0, 0, 1, 1]


def test_packing_groups_are_bounded_in_pieces_and_deal_copies_out(spark):
    rows = spark.range(3_000).select(F.lit(5).alias("id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("length"), F.lit(9).cast("long").alias("ids_crc32"))
    out = packing.pack(rows, max_tokens=64, group_pieces=500)
    sizes = [r["n"] for r in out.groupBy(F.expr("sequence_id >> 32")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 6 and sum(sizes) == 3_000 and max(sizes) < 700
    assert out.columns == ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("measure", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(measure):
    rng = np.random.default_rng(4)
    length = np.sort(rng.integers(1, 100, 400))[::-1].astype(float)
    demands = np.stack([length, np.ones(400), length**2], axis=1)
    capacities = np.array([128.0, 5.0, 9000.0])
    capacities[2] = max(capacities[2], (length**2).max())
    bins, n = packing.best_fit(demands, capacities, np.ones(3), measure)
    used = np.zeros((n, 3))
    np.add.at(used, bins, demands)
    assert (used <= capacities + 1e-6).all() and (bins >= 0).all()
    assert n <= 1.15 * max(np.ceil(demands.sum(axis=0) / capacities))


def test_token_files(spark, docs, rows):
    folder = new_path(spark, "token-files-test")
    token_files.write_token_files(docs, folder, TOKENIZER, file_tokens=4_000)
    out = token_files.read_token_files(spark, folder, keep_ids=True).orderBy("start").collect()
    texts = sorted(zip([i for i, _ in rows], whole_ids([t for _, t in rows]), strict=True), key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32(x[1].tobytes())))
    start = 0
    for r, (i, ids) in zip(out, texts, strict=True):
        assert (r["id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        assert r["ids"] == ids.tolist()
        start += len(ids)
    empty = new_path(spark, "token-files-empty")
    token_files.write_token_files(docs.limit(0), empty, TOKENIZER)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_variable_length_ranks():
    ranks = np.array([0, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1, 7], dtype="<u4")
    for some in (ranks, ranks[:0], ranks[:1], ranks[::-1], np.tile(ranks, 50)):
        control, data = token_files.encode_ranks(some)
        back = token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(some))
        assert (back == some).all() and len(control) == -(-len(some) // 4)


def test_pieces_equal_the_library():
    from steploom.llm.tokens import encoder

    rng = random.Random(8)
    letters = list("ab Z'stdmrevl0 9\n\t\r.,-éß中²\U0001f600\xa0́\x1c\x85　_")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += [chr(c) + "a " + chr(c) + " 1" + chr(c) for c in range(0x2100)] + ["<|endoftext|> we'll 's  'S\n's '''s " + "x" * 500]
    encode = encoder(TOKENIZER)
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == [w.tolist()[:-1] for w in whole_ids(texts)]


def test_quick_pieces_cut_as_the_pattern_of_all_classes():
    """The standard module cuts texts of any characters up to U+FFFF, not of Latin ones only."""
    rng = random.Random(9)
    letters = list("ab Z's9\n\t\r.,-éß中²\xa0́\x1c\x85　_’Ж٤Ⅷ")
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += [f"{chr(c)}a {chr(c)} 1{chr(c)}{chr(c)} {chr(c)}'s'{chr(c)}\n {chr(c)}  {chr(c)}9" for c in range(0x10000)]
    quick, whole = tokens.quick_pieces().findall, regex.compile(tokens.PIECES).findall
    assert [t for t in texts if quick(t) != whole(t)] == []


def test_only_texts_beyond_ffff_take_the_slow_pattern(monkeypatch):
    class Slow:
        def findall(self, text):
            raise AssertionError(text)

    monkeypatch.setattr(tokens, "regex", SimpleNamespace(findall=regex.findall, compile=lambda pattern: Slow()))
    texts = ["“quoted” – it’s 5 €", "Жук и 中文 ٤Ⅷ", "\x1c a\x85 b\u3000", "plain", ""]
    encode = tokens.plain_encoder.__wrapped__(TOKENIZER)
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in texts] == [w.tolist()[:-1] for w in whole_ids(texts)]
    with pytest.raises(AssertionError):
        encode("a \U0001f600")


ODD_LETTERS = [*"ab Z'stdmrevl0 9\n\t\r.,-éß中²\U0001f600\xa0\u0301\x1c\x85\u3000_Жٸ٤Ⅷ", "'re", "'ll", "'ve", "''", "  ", "\U0001d400", "\U0001d7d7"]


def test_pieces_of_many_texts_are_cut_as_the_pattern_does():
    rng = random.Random(10)
    texts = ["".join(rng.choices(ODD_LETTERS, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += [f"{chr(c)}a {chr(c)} 1{chr(c)}{chr(c)} {chr(c)}'s'{chr(c)}\n {chr(c)}  {chr(c)}9" for c in [*range(0xD800), *range(0xE000, 0x20000)]]
    texts += ["'", "s", "'", "'l", "l", "a  ", " b", "x\u3000", "\u3000", ""]
    raw = [t.encode() for t in texts]
    starts = np.cumsum([0, *map(len, raw)])[:-1]
    data = b"".join(raw)
    bounds = tokens.piece_bounds(np.frombuffer(data, np.uint8), starts)
    whole = regex.compile(tokens.PIECES).findall
    assert [data[a:b].decode() for a, b in itertools.pairwise(bounds)] == [p for t in texts for p in whole(t)]


@pytest.mark.parametrize("part_bytes", [1, 1000, 1 << 22])
def test_ids_of_many_texts_equal_the_library(monkeypatch, part_bytes):
    monkeypatch.setattr(tokens, "PART_BYTES", part_bytes)
    rng = random.Random(11)
    texts = ["".join(rng.choices(ODD_LETTERS, k=rng.randint(0, 40))) for _ in range(500)]
    texts += [None, "", "x" * 3000, "a <|endoftext|> b", None, "<|endoftext|>", "'", "s"]
    library = Tokenizer.from_file(TOKENIZER)
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["before", *texts, "after"], kind).slice(1, len(texts))
        parts = list(tokens.batch_encoder(TOKENIZER)(column))
        assert [ids for part in parts for ids in part] == want
        assert len(parts) == 1 or part_bytes < 1 << 22
    assert list(tokens.batch_encoder(TOKENIZER)(pa.array([], pa.string()))) == []
    assert list(tokens.batch_encoder(TOKENIZER)(pa.array([None, ""], pa.string())))[-1][-1] == b""


def test_token_files_and_packing_look_up_a_piece_once_for_many_texts(spark, monkeypatch):
    """Not once for each place where it stands, nor by the slow pattern for texts beyond U+FFFF."""
    asked = []
    many = shared.Memo.many
    monkeypatch.setattr(shared.Memo, "many", lambda memo, texts, find_all: asked.extend(texts) or many(memo, texts, find_all))
    monkeypatch.setattr(tokens, "plain_encoder", None)
    column = pa.array(["some words and some words \U0001f600 \U0001f600"] * 50)
    ids = [b for part in tokens.batch_encoder(TOKENIZER)(column) for b in part]
    assert len(set(ids)) == 1 and np.frombuffer(ids[0], "<u4").tolist() == whole_ids([column[0].as_py()])[0].tolist()[:-1]
    assert sorted(asked) == sorted({b"some", b" words", b" and", b" some", " \U0001f600".encode()})
    assert token_files.batch_encoder is packing.batch_encoder is tokens.batch_encoder


def test_memos_find_many_together():
    asked = []
    memo = shared.Memo(len, 50, 8, "test")

    def find_all(texts):
        asked.extend(texts)
        return [len(t) for t in texts]

    for i in range(300):
        texts = [f"r{i} {k}" for k in range(7)] + ["often", "a long text"]
        assert memo.many(texts, find_all) == [len(t) for t in texts]
        assert len(memo) <= 50 and len(memo.older) <= 50
    assert asked.count("often") == 1 and asked.count("a long text") == 300 and len(set(asked)) == 2102


def test_ids_of_many_rows_are_counted_together(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_TOKENS", 10)
    ids = [np.arange(k % 4 + 1, dtype="<u2" if k % 2 else "<u4") for k in range(40)] + [np.arange(50, dtype="<u2")]
    rows = pd.DataFrame({"n": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]})
    out = list(token_files._together(iter([rows[:15], rows[:0], rows[15:]])))
    assert np.concatenate(out).tolist() == np.concatenate(ids).tolist()
    assert [len(x) for x in out[:-1]] == [10] * 10 and len(out[-1]) == 50
    assert list(token_files._together(iter([rows[:0]]))) == []


def test_memos_are_bounded_and_keep_what_is_frequent():
    asked = []
    memo = shared.Memo(lambda text: asked.append(text) or len(text), 50, 8, "test")
    for i in range(1000):
        assert memo[f"rare {i}"[:8]] == len(f"rare {i}"[:8]) and memo["often"] == 5 and memo["a long text"] == 11
        assert len(memo) <= 50 and len(memo.older) <= 50
    assert asked.count("often") == 1 and asked.count("a long text") == 1000


def test_a_worker_keeps_the_memos_of_one_operator():
    """Tasks of all stages run in the same workers."""
    def held():
        return {memo.use: len(memo) + len(memo.older) for memo in list(shared._memos.values()) if len(memo) + len(memo.older)}

    model = toxicity.ToxicityModel((toxicity.Dictionaries(b"bad bad", b"good good"),) * 2, (1, 1), (0.0,) * 7, 0.5)
    for _ in range(2):
        model.scorer()("some words to be remembered")
        assert set(held()) == {"toxicity"}
        tokens.encoder(TOKENIZER)("some words to be remembered")
        assert set(held()) == {"tokens"}
    for i in range(8):  # dictionaries of earlier models are no longer held
        toxicity.ToxicityModel((toxicity.Dictionaries(b"bad %d" % i, b"good"),) * 2, (1, 1), (0.0,) * 7, 0.5).scorer()
    assert toxicity._saver.cache_info().currsize <= len(toxicity.LENGTHS)


def test_added_tokens_as_the_library_reads_them(spark):
    library = Tokenizer.from_file(TOKENIZER)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext| > we'll", "plain", "", "<|endoftext|>" + "word " * 400]
    want = [np.array([*library.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for t in texts]
    assert want[0].tolist() == [64, 220, 50256, 275, 0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pieces = packing.token_pieces(docs, TOKENIZER).collect()
    assert {r["id"]: (r["length"], r["ids_crc32"]) for r in pieces} == {i: (len(w), zlib.crc32(w.tobytes())) for i, w in enumerate(want)}
    folder = new_path(spark, "token-files-added")
    token_files.write_token_files(docs, folder, TOKENIZER)
    out = {r["id"]: r for r in token_files.read_token_files(spark, folder, keep_ids=True).collect()}
    start = 0
    for i, ids in enumerate(want):
        assert (out[i]["start"], out[i]["n_tokens"], out[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert out[i]["ids"] == ids.tolist()
        start += len(ids)


def plain_score(text, model):
    """The score window by window, without memo or counting, by new compressors."""
    words = regex.findall(r"\w+|[^\w\s]+", (text or "").lower())
    features = [1.0]
    for length, (of, threshold) in enumerate(zip(model.dictionaries, model.thresholds, strict=True), 1):
        saved, known = [], {}
        for i in range(len(words) - length + 1):
            window = words[i : i + length]
            if length > 1 and not set(window) <= of.words:
                continue
            key = " ".join(window)
            if key not in known:
                framed = bytes(range(0x80, 0x98)) + f" {key} ".encode() + bytes(range(1, 13))
                size = [len(toxicity._compressor(d).compress(framed)) for d in (of.ordinary, of.toxic)]
                known[key] = max(size[0] - size[1], 0)
            saved.append(known[key])
        n = max(len(words), 1)
        features += [(sum(s >= threshold for s in saved) / n) ** 0.5, (sum(s * s for s in saved) / n) ** 0.5, max(saved, default=0) / 8]
    z = sum(w * x for w, x in zip(model.weights, features, strict=True))
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def test_toxicity_by_order_and_company(spark):
    """Toxic and ordinary texts hold the same words equally often; only which word follows which tells them apart."""
    rng = random.Random(5)
    usual = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(200)]
    pairs = [("zulmer", "wektop"), ("jinrosk", "quaddel"), ("yorvik", "xantip")]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(usual, k=rng.randint(15, 50))
        for a, b in rng.choices(pairs, k=3):
            at = rng.randrange(len(words))
            words[at:at] = [a, b] if i % 3 == 0 else [b, a]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = docs.filter(~toxicity.learning_rows(F.col("doc_id")))
    out = toxicity.toxicity(held, model).select("row.doc_id", "score").collect()
    wrong = [r for r in out if (r["score"] >= 0.5) != (r["doc_id"] % 3 == 0)]
    assert len(out) > 200 and len(wrong) <= len(out) // 20


def test_toxicity_learns_from_blocks_of_the_whole_text(spark):
    size = toxicity.SAMPLE_BLOCKS * toxicity.BLOCK_CHARS
    short, long = "ab " * (size // 3), "".join(f"{i:07d} " for i in range(200_000))
    table = spark.createDataFrame([(1, short), (2, long), (3, None), (4, ""), (None, long)], "id long, text string")
    got = [r[0] for r in table.select(toxicity._blocks(F.col("id"), F.col("text"))).collect()]
    assert got[0] == short and got[2] is None and got[3] == ""
    for text in (got[1], got[4]):
        blocks = [text[at : at + toxicity.BLOCK_CHARS] for at in range(0, len(text), toxicity.BLOCK_CHARS + 1)]
        starts = [long.index(b) for b in blocks]
        assert starts == sorted(set(starts)) and 2 <= len(starts) <= toxicity.SAMPLE_BLOCKS and starts[-1] > len(long) // 2
    assert got[1] != got[4]


def test_toxicity(spark):
    rng = random.Random(2)
    usual = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(usual, k=rng.randint(15, 60))
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["rotter", "swinish", "vilest"]))
        rows.append((i, " ".join(words), "x"))
        labels += [(i, int(i % 4 == 0), 9)] if i < 500 else [(i, None, 9)]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "quite " * 20_000 + "rotter", "x"), (None, "rotter vilest swinish", "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    truth = spark.createDataFrame(labels + labels[:3], "doc_id long, toxic int, text int")
    model = toxicity.fit_toxicity(docs, truth)
    out = toxicity.toxicity(docs, model).select("row.doc_id", "row.text", "score").collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    wrong = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 600 and (r["score"] >= 0.7) != (r["doc_id"] % 4 == 0)]
    assert len(wrong) <= 12
    empty = {r["doc_id"]: r["score"] for r in out}
    assert empty[1000] == empty[1001] < 0.5 and empty[None] >= 0.7
    kept = toxicity.drop_toxic(docs, truth)
    assert kept.columns == docs.columns and 430 <= kept.count() <= 470
    for r in out:
        assert r["score"] == pytest.approx(plain_score(r["text"], model), rel=1e-9)
    nothing = toxicity.fit_toxicity(docs, truth.filter("toxic = 0"))
    assert {r["score"] for r in toxicity.toxicity(docs, nothing).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), model).count() == 0


def test_language(spark):
    rng = random.Random(6)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "er", "ung"], "cc": ["é", "eau", "tre", "ou"]}
    rows = []
    for i in range(240):
        name = sorted(syllables)[i % 3]
        words = ["".join(rng.choices(syllables[name], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 200))]
        rows.append((i, " ".join(words).capitalize(), name if i % 5 else None))
    rows += [(900, None, "aa"), (901, "", None), (902, "12 !? 34", "bb"), (903, "kalomi " * 20_000, None), (None, "eautreou", "cc"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.fit_languages(docs)
    assert [name for name, _ in samples] == ["aa", "bb", "cc"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.languages(docs, samples).select("row.doc_id", "lang_pred", "score").collect()}
    assert [i for i in range(240) if got[i][0] != sorted(syllables)[i % 3]] == []
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "aa" and got[None][0] == "cc"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language.languages(docs, ()).filter("lang_pred = 'und'").count() == len(rows)
    assert language.languages(docs.limit(0), samples).count() == 0


def longest_phrases(text, reference):
    count = at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in reference and text[at] in reference:
            n += 1
        count, at = count + 1, at + n
    return count


@pytest.mark.parametrize(("letters", "sizes"), [("abc", (1, 250)), ("ab", (200, 5_000)), ("".join(map(chr, range(0x4E00, 0x4E00 + 3_000))), (50, 1_200))])
def test_cross_parsing_counts_phrases(letters, sizes):
    """Texts beyond one block, stretches of the reference longer than one, and more letters than the dense table has."""
    rng = random.Random(9)
    reference = "".join(rng.choices(letters, k=4_000 if len(letters) > 9 else 700))
    reader = language.LanguageReader((("aa", (reference,)),))
    texts = []
    for _ in range(12):
        text = "".join(rng.choices(letters + "é", k=rng.randint(*sizes)))
        at = rng.randrange(len(reference))
        texts.append(text[: len(text) // 2] + reference[at : at + 300] * 3 + text[len(text) // 2 :])
    symbols = [language._symbols(language._code_points(t), reader.symbol_of) for t in [*texts, ""]]
    want = [longest_phrases(t, reference) * reader.bits[0] for t in texts] + [0.0]
    assert reader.costs(symbols)[:, 0] == pytest.approx(want)


def test_reference_is_shared_by_all_sampled_rows():
    parts = [np.arange(5), np.arange(100), np.arange(100)]
    assert [len(p) for p in language._shared_evenly(parts, 65)] == [5, 30, 30]
    texts = tuple("".join(chr(0x4E00 + 40 * n + k) for k in range(40)) for n in range(1_000))
    reader = language.LanguageReader((("zz", texts),))
    assert (reader.tables[0].start[2:] > 0).sum() >= 29_000
