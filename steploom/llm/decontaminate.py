"""Find passages of benchmark items in documents by winnowing, exactly.

A window is 13 consecutive words of an item (all its words, if it has fewer). Of a window's k-word grams the smallest
hash is its fingerprint. Sliding the same window over a document keeps one gram per run of equal minima, about two in
ten, and any window that document and item share has the same minimum in both: so no shared window is missed. Kept
grams that meet a benchmark fingerprint are extended to the windows around them, and their words are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steploom.llm.shared import BROADCAST_ROWS, ascii_lower, written

WINDOW = 13
GRAM = 5
#: At most so many bytes of windows, or of items by set, are broadcast.
BROADCAST_BYTES = 20 << 20


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case. Null: none."""
    lower = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(tokens: Column, k: int) -> Column:
    """The hash of each k consecutive words, by the place of the first; none if there are fewer words."""
    last = F.size(tokens) - k + 1
    hashes = F.transform(F.sequence(F.lit(1), last), lambda at: F.xxhash64(F.slice(tokens, at, k)))
    return F.when(last > 0, hashes).otherwise(F.array().cast("array<long>"))


def _minima(grams: Column, count: int) -> Column:
    """The smallest of each ``count`` hashes, by the place of the first; none if there are fewer hashes."""
    if count == 1:
        return grams
    last = F.size(grams) - count + 1
    least = F.transform(F.sequence(F.lit(1), last), lambda at: F.array_min(F.slice(grams, at, count)))
    return F.when(last > 0, least).otherwise(F.array().cast("array<long>"))


def _barrier(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once, not again in every expression that reads it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Each window of each item once: ``n`` words, ``fingerprint``, ``words`` (space-joined), ``item``.

    Repeated ids count once; items without a word give nothing.
    """
    tokens = _barrier(items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("t")), "w", words(F.col("t")))
    sized = tokens.select("item", "w", F.least(F.size("w"), F.lit(window)).alias("n")).filter(F.col("n") > 0)
    starts = sized.select("item", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("s"))
    cut = starts.select("item", "n", F.slice("w", F.col("s"), F.col("n")).alias("w"))
    short = [F.when(F.size("w") == n, F.xxhash64("w")) for n in range(1, min(GRAM, window + 1))]
    fingerprint = F.coalesce(*short, F.array_min(_grams(F.col("w"), GRAM)))
    return cut.select("n", fingerprint.alias("fingerprint"), F.array_join("w", " ").alias("words"), "item").distinct()


def _with_sets(of_items: DataFrame) -> DataFrame:
    """Each distinct window with 128 bits (``set_a``, ``set_b``) that name the set of its items, so a row never holds the set."""
    sets = [F.bit_xor(F.xxhash64("item", F.lit(n))).alias(name) for n, name in enumerate(_SET)]
    return of_items.groupBy("n", "fingerprint", "words").agg(*sets)


_SET = ("set_a", "set_b")


def _with_minima(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` with words ``w``, once for each size ``n`` of windows with its ``minima``, instead of ``text``.

    Words are split and grams hashed once, whatever the number of sizes.
    """
    tokens = _barrier(rows, "w", words(F.col("text"))).drop("text")
    lengths = sorted({min(GRAM, n) for n in sizes})
    for k in lengths:
        tokens = _barrier(tokens, f"grams_{k}", _grams(F.col("w"), k))
    minima = [_minima(F.col(f"grams_{min(GRAM, n)}"), n - min(GRAM, n) + 1) for n in sizes]
    per_size = F.array(*[F.struct(F.lit(n).alias("n"), m.alias("minima")) for n, m in zip(sizes, minima, strict=True)])
    return tokens.select("*", F.inline(per_size)).drop(*[f"grams_{k}" for k in lengths])


def _reach() -> Column:
    """Windows of n words that can have one gram as their minimum, less one."""
    return F.col("n") - F.least(F.col("n"), F.lit(GRAM))


def _kept_grams(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """``rows`` (with ``text``) times the starts ``s`` where the minimum ``fingerprint`` of n words changes.

    Where one minimum lasts longer than a gram can (a text that repeats itself), each further start is kept too.
    """
    starts = _with_minima(rows, sizes).select("*", F.posexplode("minima").alias("s", "fingerprint"))
    s, span = F.col("s"), _reach() + 1
    before = F.when(s >= 1, F.col("minima")[s - 1])
    earlier = F.when(s >= span, F.col("minima")[s - span])
    here = F.col("fingerprint")
    return starts.filter(before.isNull() | (before != here) | F.coalesce(earlier == here, F.lit(False)))


def _extended(kept: DataFrame) -> DataFrame:
    """The windows of n words around each kept gram that have its fingerprint: ``s`` and ``words``."""
    last = F.least(F.col("s") + _reach(), F.size("minima") - 1)
    near = kept.select("*", F.explode(F.sequence(F.col("s"), last)).alias("start"))
    return near.filter(F.col("minima")[F.col("start")] == F.col("fingerprint")).select(
        "id", "text_hash", "n", F.col("start").alias("s"), F.array_join(F.slice("w", F.col("start") + 1, F.col("n")), " ").alias("words")
    )


def _hits(rows: DataFrame, windows: DataFrame, sizes: list[int], broadcast: bool) -> DataFrame:
    """Every occurrence of a window in a document: ``id``, ``text_hash``, ``s``, ``n`` and the set of its items."""
    prints = windows.select("n", "fingerprint").distinct()
    kept = _kept_grams(rows, sizes)
    if broadcast:  # documents never move; grams and windows are looked up where the text is read
        found = _extended(kept.join(F.broadcast(prints), ["n", "fingerprint"]))
        windows = F.broadcast(windows)
    else:  # grams meet fingerprints in a shuffle; then only documents with candidates read their words again
        starts = (
            kept.select("id", "text_hash", "n", "s", "fingerprint")
            .join(written(prints, "fingerprints"), ["n", "fingerprint"])
            .groupBy(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash"))
            .agg(F.collect_set(F.struct("n", "s")).alias("starts"))
        )
        same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))
        of_size = F.filter("starts", lambda start: start["n"] == F.col("n"))
        again = _with_minima(rows.join(starts, same), sizes).select("*", F.explode(of_size).alias("at")).select("*", F.col("at.s").alias("s"))
        found = _extended(again.select("*", F.col("minima")[F.col("s")].alias("fingerprint")))
    return found.join(windows.select("n", "words", *_SET), ["n", "words"]).select("id", "text_hash", "s", "n", *_SET)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Per row of ``docs``: ``id``, ``text_hash``, ``n_words``, ``n_hit``, sorted ``items``, ``spans`` (start, words).

    A word inside any occurrence of an item's window is hit; ``n_hit`` counts such words once. Items of null id hit words, but
    are not in ``items``.
    Null or empty text has no words and no hits; an empty benchmark hits nothing; an empty table gives no rows. Repeated
    rows get the same result each; documents of the same id and different texts are different documents.
    The documents are read twice, whatever the sizes of windows: for hits and for the number of words (a third time, joined
    with candidates, if nothing is broadcast). Benchmarks of up to ``broadcast_rows`` windows and ``broadcast_bytes`` (both
    counted) are broadcast; larger ones are joined by shuffle.
    """
    rows = docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text")
    )
    of_items = written(item_windows(benchmark, item_id, item_text, window), "windows-of-items")
    windows = written(_with_sets(of_items), "windows")
    size = F.sum(F.octet_length("words") + 64).alias("bytes")
    counted = windows.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), size).collect()  # at most ``window`` rows
    sized = rows.select("id", "text_hash", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    empty = F.array().cast("array<string>")
    none = F.array().cast("array<struct<s:int,n:int>>")
    if not counted:
        return sized.select("*", F.lit(0).cast("long").alias("n_hit"), empty.alias("items"), none.alias("spans"))
    broadcast = sum(r["rows"] for r in counted) <= broadcast_rows and sum(r["bytes"] for r in counted) <= broadcast_bytes
    hits = _hits(rows, windows, sorted(r["n"] for r in counted), broadcast)
    per_doc = hits.groupBy(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(
        F.sort_array(F.collect_set(F.struct("s", "n"))).alias("spans"), F.collect_set(F.struct(*_SET)).alias("sets")
    )
    # Spans in order of their start: each adds what lies beyond the furthest end so far.
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end")),
        lambda done, span: F.struct(
            (done["total"] + F.greatest(F.lit(0), span["s"] + span["n"] - F.greatest(done["end"], span["s"]))).alias("total"),
            F.greatest(done["end"], span["s"] + span["n"]).alias("end"),
        ),
        lambda done: done["total"],
    )
    members = of_items.filter(F.col("item").isNotNull()).join(windows, ["n", "fingerprint", "words"]).select(*_SET, "item").distinct()
    members = written(members, "items-of-sets")
    of_sets = members.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("item") + 64).alias("bytes")).head()
    if of_sets["rows"] <= broadcast_rows and (of_sets["bytes"] or 0) <= broadcast_bytes:
        members = F.broadcast(members)
    per_doc = (
        per_doc.select("of_id", "of_hash", "spans", covered.alias("covered"), F.inline("sets"))
        .join(members, list(_SET), "left")
        .groupBy("of_id", "of_hash")
        .agg(F.first("spans").alias("spans"), F.first("covered").alias("covered"), F.sort_array(F.collect_set("item")).alias("found"))
    )
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))
    return sized.join(per_doc, same, "left").select(
        "id",
        "text_hash",
        "n_words",
        F.coalesce("covered", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("found", empty).alias("items"),
        F.coalesce("spans", none).alias("spans"),
    )


def is_contaminated() -> Column:
    """At least a twentieth of the words is hit, and one at all."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    found = contamination(docs.select(doc_id, text), benchmark, doc_id, text).filter(is_contaminated())
    bad = written(found.select(F.col("id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct(), "contaminated")
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    same = F.col("row")[doc_id].eqNullSafe(F.col("_bad_id")) & (F.col("text_hash") == F.col("_bad_hash"))
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_ROWS else bad
    return rows.join(bad, same, "left_anti").select("row.*")
