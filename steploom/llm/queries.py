"""One query per operator, with production parameters over its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.llm.alignment import aligned_texts, pair_of, with_link_counts
from steploom.llm.decontaminate import contamination, is_contaminated
from steploom.llm.embeddings import near_duplicate_vectors
from steploom.llm.language import fit_languages, languages
from steploom.llm.language import learning_rows as language_rows
from steploom.llm.licences import licences
from steploom.llm.line_dedup import drop_frequent_lines
from steploom.llm.packing import pack, token_pieces
from steploom.llm.periodic import find_runs
from steploom.llm.sharding import shard_rows
from steploom.llm.shared import new_path, ship_code
from steploom.llm.simhash import near_duplicates
from steploom.llm.token_files import read_token_files, write_token_files
from steploom.llm.toxicity import fit_toxicity, learning_rows, toxicity
from steploom.llm.warc import resolve_revisits

Query = Callable[[SparkSession, str], DataFrame]

#: The tokenizer file of the token queries, where the package of public tokenizers has it.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), F.array_join("families", ",").alias("families"), "n_paragraphs", "n_unknown")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.9)
    return found.select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity(docs, model).select(
        "row.doc_id",
        (~learning_rows(F.col("row.doc_id"))).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = fit_languages(docs.select("doc_id", "text", "lang"))
    return languages(docs.select("doc_id", "text"), samples).select(
        "row.doc_id", (~language_rows(F.col("row.doc_id"))).alias("held_out"), "lang_pred", "score"
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_frequent_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), TOKENIZER, max_tokens=2048)
    return pack(pieces, max_tokens=2048).withColumnRenamed("id", "doc_id")


def page_captures(pages: DataFrame) -> DataFrame:
    """Two captures of each page: a response (one in nine is not found), and a not-modified revisit around that time.

    Revisits write the address in another way; one in four has no entity tag, and half of these another date.
    """
    page, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    at = F.timestamp_add("MINUTE", page * 7919 % 100000, F.lit("2024-01-01").cast("timestamp"))
    tag = F.concat(F.lit('"'), F.md5(html), F.lit('"'))
    modified = F.concat(F.lit("day "), (page % 50).cast("string"))
    text = lambda time: F.date_format(time, "yyyy-MM-dd HH:mm:ss")
    given = lambda **fields: F.map_filter(
        F.create_map(*[x for k, v in fields.items() for x in (F.lit(k.replace("_", "-")), v)]), lambda k, v: v.isNotNull()
    )
    response = pages.select(
        (page * 2).alias("record_id"),
        F.lit("response").alias("kind"),
        "url",
        at.alias("captured"),
        F.when(page % 9 == 0, 404).otherwise(200).alias("status"),
        given(
            ETag=tag,
            Content_Length=F.octet_length(html).cast("string"),
            Content_Type=F.lit("text/html"),
            Date=text(at),
            Last_Modified=F.when(page % 3 != 0, modified),
        ).alias("headers"),
    )
    again = F.timestamp_add("HOUR", page % 5 - 1, at)
    joint = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    revisit = pages.select(
        (page * 2 + 1).alias("record_id"),
        F.lit("revisit").alias("kind"),
        F.when(page % 2 == 0, F.concat("url", F.lit("#again"))).otherwise(F.concat("url", joint, F.lit("utm_source=x"))).alias("url"),
        again.alias("captured"),
        F.lit(304).alias("status"),
        given(
            etag=F.when(page % 4 != 0, F.concat(F.lit("W/"), tag)),
            content_length=F.lit("0"),
            cache_control=F.lit("max-age=60"),
            date=text(again),
            last_modified=F.when(page % 4 == 0, F.when(page % 8 == 0, F.lit("another day")).otherwise(modified)),
        ).alias("headers"),
    )
    return response.unionAll(revisit)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(page_captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    fields = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select(
        ((F.col("record_id") - 1) / 2).cast("long").alias("page_id"),
        "record_id",
        F.coalesce("refers_to", F.lit(-1)).alias("refers_to"),
        "outcome",
        F.array_join(fields, "; ").alias("headers"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, TOKENIZER)
    return read_token_files(spark, folder).withColumnRenamed("id", "doc_id")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = aligned_texts(docs, TOKENIZER, PIECE_MODEL)
    digest = F.when(F.col("groups").isNull(), "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    aligned = aligned.withColumn("groups_sha256", digest).drop("groups")
    return with_link_counts(aligned, pair_of(TOKENIZER, PIECE_MODEL).size_a).withColumnRenamed("id", "doc_id")


#: The words of the contracts: what stands between ASCII white space.
_BETWEEN_WORDS = r"[\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``docs``, where in one document of ten, by the checksum of its id, the words from one on repeat a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.split(F.regexp_replace("text", rf"^{_BETWEEN_WORDS}|{_BETWEEN_WORDS}\z", ""), _BETWEEN_WORDS)
    whole = lambda x, y: F.call_function("div", x, y).cast("int")

    def repeated(held: Column) -> Column:
        words, n = held["words"], F.size(held["words"])
        g = whole(held["h"], F.lit(10))
        a = (g % n).cast("int")
        p = 1 + whole(n - a, (3 + g % 8).cast("int"))
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(places, lambda i: words[i]), " ")

    # The element of the array is computed once for all uses of it.
    planted = F.transform(F.array(F.struct(words.alias("words"), h.alias("h"))), repeated)[0]
    blank = F.col("text").rlike(rf"^(?:{_BETWEEN_WORDS})?\z")
    return docs.select("doc_id", F.when((h % 10 == 0) & ~blank, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))
    # The greatest exact length / period by cross products; runs come by start, then period, so the first of equals stays.
    better = lambda best, run: F.when(
        best["period"].isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run
    ).otherwise(best)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    of = found.select("id", "runs", "collapsed", F.aggregate("runs", none, better).alias("best"), F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("lines"))
    return of.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.col("lines")).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_rows(docs, shards=40, keep=()).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _with_code(query: Query) -> Query:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return query(spark, sf_dir)

    return run


_OPERATORS: dict[str, Query] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_licences": op3_licences,
    "op4_embeddings": op4_embeddings,
    "op5_toxicity": op5_toxicity,
    "op6_language": op6_language,
    "op7_line_dedup": op7_line_dedup,
    "op8_packing": op8_packing,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_token_files": op10_token_files,
    "op11_alignment": op11_alignment,
    "op12_periodic": op12_periodic,
    "op13_sharding": op13_sharding,
}

QUERIES = {name: _with_code(query) for name, query in _OPERATORS.items()}
