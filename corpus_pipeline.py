"""Training corpus from documents: quality, lines, near copies, benchmarks, tokens.

Every stage takes the rows its predecessor kept and returns the columns of documents;
the last one returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import bpe, decontamination, line_dedup, ngram_join, quality_rules
from loomdex.llm.queries import VOCABULARY
from loomdex.session import checkpointed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _records(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumnRenamed("doc_id", "documentId")


def _rows(records: DataFrame) -> DataFrame:
    return records.withColumnRenamed("documentId", "doc_id").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: too short, repeating themselves, or of low quality."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        F.col("doc_id").alias("documentId"), "quality")
    records = _records(docs)
    return _rows(quality_rules.kept(records, quality_rules.fit(records, labels)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later runs of repeated lines go, and documents that consisted of such runs."""
    found = line_dedup.deduplicated(_records(docs))
    left = found.filter((F.col("nRemovedLines") == 0) | (F.col("nRemovedLines") < F.col("nLines")))
    return _rows(left.withColumn("n_chars", F.length("text").cast("long")))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near copies the document with the smallest id stays."""
    return _rows(ngram_join.representatives(_records(docs)))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    questions = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.col("item_id").alias("id"), F.col("text").alias("question"))
    return _rows(decontamination.decontaminated(_records(docs), questions))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every text, and a digest of the decoded text."""
    return bpe.encode(_records(docs), VOCABULARY, decoded=True).select(
        F.col("documentId").alias("doc_id"), F.col("nTokens").alias("n_tokens"),
        F.col("tokenIds").alias("token_ids"),
        F.sha2(F.col("decodedText").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_copy_stage),
    ("decontamination", benchmark_stage),
    ("bpe", token_stage),
]

#: Models, trees and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the rows between two stages are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
