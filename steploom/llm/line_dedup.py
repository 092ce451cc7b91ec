"""Drop lines that stand in many documents (exact, on normalised lines)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steploom.llm.shared import ASCII_SPACE, ascii_lower, small, written


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends and with A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _hash(key: Column) -> Column:
    """96 bits of two unrelated hashes: among 10^12 different lines no two are likely to share them."""
    return F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b"))


def frequent_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, doc_id: str | None = None) -> DataFrame:
    """Hashes ``a``, ``b`` of the line keys of at least ``min_chars`` code points that stand in at least ``min_docs`` documents.

    A document counts once per key, however often the line repeats in it. Rows of one id are one document, so are rows of
    null id and one text; without ``doc_id`` each row is one. Counts are summed before the shuffle, so a line that all
    documents share moves as one row per task; only lines of documents of several rows are first made distinct.
    """
    keys = F.filter(F.transform(F.split(F.col(text), "\n"), line_key), lambda key: F.char_length(key) >= min_chars)
    hashes = F.explode(F.array_distinct(F.transform(keys, _hash))).alias("h")

    def lines_of(rows: DataFrame, *of: str) -> DataFrame:
        return rows.select(*of, hashes).select(*of, "h.a", "h.b")

    if doc_id is None:
        lines = lines_of(docs)
    else:
        of_null = F.when(F.col(doc_id).isNull(), F.xxhash64(text))
        rows = docs.select(F.col(doc_id).alias("of"), of_null.alias("of_null"), text)
        several = rows.groupBy("of", "of_null").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        several = written(several.select(F.col("of").alias("again"), F.col("of_null").alias("again_null")), "repeated-documents")
        n_several = several.count()
        if not n_several:
            lines = lines_of(rows)
        else:
            same = F.col("of").eqNullSafe(F.col("again")) & F.col("of_null").eqNullSafe(F.col("again_null"))
            once = lines_of(rows.join(small(several, n_several), same, "left_anti"))
            repeated = lines_of(rows.join(small(several, n_several), same, "left_semi"), "of", "of_null")
            lines = once.unionAll(repeated.distinct().select("a", "b"))
    return (
        lines.groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_docs)
        .select("a", "b")
    )


def drop_frequent_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1
) -> DataFrame:
    """``docs`` with columns ``row`` (all its columns), ``n_lines``, ``n_dropped`` and ``kept`` (the text that stays).

    Lines are exploded, normalised and hashed; documents are counted per hash; positions of lines over the threshold
    are gathered per document (bounded by the document's own lines) and the rest is put together by position.
    Text is shuffled once, only to meet its dropped positions.

    Null or empty text is one empty line; a key of fewer than ``min_chars`` is never dropped. Null and repeated ids
    are fine: a document is recognised by id and text, and every row of ``docs`` gives one row. Empty table: no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col(doc_id).alias("id"),
        whole.alias("text"),
        F.xxhash64(whole).alias("text_hash"),
    )
    frequent = written(frequent_lines(rows, "text", min_docs, min_chars, "id"), "frequent-lines")
    key = line_key(F.col("line"))
    lines = (
        rows.select("id", "text_hash", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .withColumn("key", key)
        .filter(F.char_length("key") >= min_chars)
        .select("id", "text_hash", "at", _hash(F.col("key")).alias("h"))
        .select("id", "text_hash", "at", "h.a", "h.b")
    )
    dropped = (
        lines.join(small(frequent), ["a", "b"])
        .groupBy(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash"))
        .agg(F.collect_set("at").alias("dropped"))
    )
    lines_of = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines_of) - 1), F.col("dropped"))
    return (
        rows.join(dropped, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left")
        .select(
            "row",
            F.size(lines_of).cast("long").alias("n_lines"),
            F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("dropped").isNull(), F.col("text"))
            .otherwise(F.array_join(F.transform(kept, lambda at: lines_of[at]), "\n"))
            .alias("kept"),
        )
    )


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """``docs`` with its columns, ``text`` without the lines that stand in many documents; all documents stay."""
    out = drop_frequent_lines(docs, doc_id, text, **limits)
    return out.select(*[F.col("kept").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
