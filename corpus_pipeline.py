"""The corpus pipeline: each stage works on all documents that the one before kept.

All stages take nulls in any column, repeated rows, empty tables and further columns, whatever their names; all but the last return
the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steploom.llm.decontaminate import drop_contaminated
from steploom.llm.line_dedup import dedup_lines
from steploom.llm.packing import pack, token_pieces
from steploom.llm.shared import new_path, ship_code
from steploom.llm.simhash import keep_one_each
from steploom.llm.toxicity import drop_toxic

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go.

    Null and empty texts score as texts without a word. Repeated rows score alike. Without labels of both kinds all rows have the
    share of toxic labels as their score.
    """
    ship_code(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in ten or more documents go; ``n_chars`` follows the text.

    Null and empty texts are one empty line. Repeated rows are one document, and each keeps the same lines.
    """
    ship_code(spark)
    out = dedup_lines(docs, min_docs=10)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id; of rows with this id, that of the smallest text hash, once.

    Texts without words are one group. Null ids come last.
    """
    ship_code(spark)
    return keep_one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of which a twentieth of the words or more stands in windows of benchmark items.

    Null and empty texts have no words and stay, as do all without a benchmark. Repeated rows are judged alike.
    """
    ship_code(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their token ids, each with its place in a sequence of at most 2048 tokens.

    Null text is empty, one token (the end id). Every row is packed, repeated ones too; null ids stay null.
    """
    ship_code(spark)
    return pack(token_pieces(docs, TOKENIZER, max_tokens=2048, keep_ids=True), max_tokens=2048).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: The toxicity and packing stages fit a model and run a tokenizer, which SQL can't express; tests check by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
