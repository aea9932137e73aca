"""The corpus pipeline: toxicity, language ID, line dedup, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of documents. run() writes each stage's rows as Parquet into the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseforge.llm import common, languages, linededup, neardup, packing, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't scored as toxic; the model learns from the labels outside fold 0."""
    labels = common.table(spark, sf_dir, "labels").where(common.crc_fold() != 0)
    scored = toxicity.score_rows(docs, toxicity.fit(docs, labels))
    return scored.where("score < 0.5").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: no letters at all, or a cross-entropy far beyond what is usual, are rejected."""
    train, calibration = languages.folds(docs)
    return languages.accept_rows(docs, train, calibration).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines and runs; n_chars follows the text, and documents of which no word is left go.

    Texts that lose nothing stay as they are, null and empty ones too.
    """
    out = linededup.dedup_lines(docs)
    out = out.where((F.col("words_removed") == 0) | F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    return out.withColumn("n_chars", F.when(F.col("words_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near-duplicates; rows without id, text or words stay, and of rows of one id only the one with a partner goes."""
    return neardup.without_copies(docs).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers

    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("lines", line_stage),
    ("neardup", neardup_stage),
    ("packing", packing_stage),
]

#: Model scores, character models and sequences can't be told in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that all stages keep."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
