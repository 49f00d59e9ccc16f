"""From raw documents to packed training sequences, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept. All but
the last return the columns of documents; documents with null fields, empty texts and extra columns
go through like others. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasoncast.llm.bin_packing import pack
from seasoncast.llm.common import read_table
from seasoncast.llm.near_dedup import near_duplicates
from seasoncast.llm.pieces import token_pieces
from seasoncast.llm.pii import redact, train
from seasoncast.llm.site_quality import score_quality
from seasoncast.sources.shared import scratch_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is at least one half."""
    judged = score_quality(docs, read_table(spark, sf_dir, "labels"))
    return judged.filter("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest doc_id.

    Rows that repeat a doc_id and a text are one document. Rows without a doc_id stay.
    """
    found = near_duplicates(docs).filter("NOT kept").select("doc_id").distinct()
    left = docs.join(found, "doc_id", "left_anti").select(*docs.columns)
    # Texts are shuffled for repeated ids only.
    repeated = docs.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL")
    once = left.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    more = left.join(repeated, "doc_id", "left_semi").select(*docs.columns)
    return once.unionByName(more.dropDuplicates(["doc_id", "text"]))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows the text."""
    clean = docs.withColumn("text", redact(F.col("text"), train(docs)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        chars = F.length("text").cast(kind)
        clean = clean.withColumn("n_chars", F.coalesce(chars, F.col("n_chars")))
    return clean.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence, as in ``op3``."""
    pieces = token_pieces(docs, WORD_BPE)
    return pack(
        pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    )


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: Trained models and MinHash have no SQL; a test compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written, and read by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
