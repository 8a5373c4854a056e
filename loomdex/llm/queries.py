"""The numbered queries: given tables -> operators of this subpackage -> contract columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import (
    bpe,
    centroid_clusters,
    chat_formatting,
    decontamination,
    hard_negatives,
    line_dedup,
    lm_scoring,
    ngram_join,
    quality_classifier,
    quality_rules,
    substring_dedup,
    token_files,
    url_filters,
)
from loomdex.session import shared_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


#: Fixed values of the query: verdict, host and start of the path.
URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(
        F.col("doc_id").alias("documentId"), "text")


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet").select(
        F.col("doc_id").alias("documentId"), "quality")


def _held_out(number: str):
    return F.crc32(F.col(number).cast("string")) % 3 == 1


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(_documents(spark, folder), VOCABULARY, decoded=True).select(
        F.col("documentId").alias("doc_id"), F.col("nTokens").alias("n_tokens"),
        F.sha2("tokenIds", 256).alias("ids_sha256"),
        F.sha2(F.col("decodedText").cast("binary"), 256).alias("decoded_sha256"))


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.linked(_documents(spark, folder)).select(
        F.col("documentId").alias("doc_id"), F.col("nShingles").alias("n_shingles"),
        F.col("componentId").alias("component_id"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.deduplicated(_documents(spark, folder)).select(
        F.col("documentId").alias("doc_id"), F.col("nLines").alias("n_lines"),
        F.col("nRemovedLines").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = _documents(spark, folder)
    labels = _quality(spark, folder).filter(~_held_out("documentId"))
    model = quality_classifier.fit(documents, labels)
    return quality_classifier.score(documents, model).select(
        F.col("documentId").alias("doc_id"), _held_out("documentId").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet").select(
        F.col("page_id").alias("documentId"), F.col("url").alias("sourceUrl"))
    rules = spark.createDataFrame(URL_RULES, "verdict string, rule string")
    return url_filters.verdicts(pages, rules).withColumnRenamed("documentId", "page_id")


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.deduplicated(_documents(spark, folder)).select(
        F.col("documentId").alias("doc_id"), F.col("nWords").alias("n_words"),
        F.col("nRemoved").alias("n_removed"),
        F.sha2(F.col("keptText").cast("binary"), 256).alias("kept_sha256"))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/benchmark.parquet").select(
        F.col("item_id").alias("id"), F.col("text").alias("question"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and benchmark item it contains."""
    return decontamination.contaminated(
        _documents(spark, folder), _questions(spark, folder)).select(
        F.col("documentId").alias("doc_id"), F.col("id").alias("item_id"), "similarity",
        F.col("firstWord").alias("first_word"))


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Target: the turns of all conversations. Background: all documents."""
    documents = _documents(spark, folder)
    target = spark.read.parquet(f"{folder}/conversations.parquet").select("text")
    return lm_scoring.score(documents, lm_scoring.fit(target, documents)).select(
        F.col("documentId").alias("doc_id"), F.col("nWords").alias("n_words"),
        F.col("targetLoss").alias("target_loss"),
        F.col("backgroundLoss").alias("background_loss"), "score")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    documents = _documents(spark, folder)
    model = quality_rules.fit(documents, _quality(spark, folder))
    return quality_rules.judged(documents, model).select(
        F.col("documentId").alias("doc_id"), F.col("nWords").alias("n_words"),
        F.col("wordChars").alias("word_chars"), F.col("nSymbols").alias("n_symbols"),
        F.col("nDupLines").alias("n_dup_lines"), F.col("nRepeatWords").alias("n_repeat_words"),
        F.col("baseFailed").alias("base_failed"), "probability", "kept")


def op10_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = spark.read.parquet(f"{folder}/conversations.parquet").withColumnRenamed("conv_id", "id")
    return chat_formatting.repaired(turns).select(
        F.col("id").alias("conv_id"), "turn", "role", "action",
        F.col("repairedRole").alias("repaired_role"), "cost", "rendered")


def op11_token_files(spark: SparkSession, folder: str) -> DataFrame:
    store = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(_documents(spark, folder), BYTE_VOCABULARY, store)
    return token_files.read(spark, store).select(
        F.col("documentId").alias("doc_id"), "start", F.col("nTokens").alias("n_tokens"),
        F.crc32("tokenIds").alias("ids_crc32"))


def _embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet").withColumnRenamed("vec_id", "chunkId")


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """A vector's label is the document it comes from."""
    chunks = _embeddings(spark, folder).withColumn("documentId", F.when(
        F.col("chunkId") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mined(chunks, F.col("chunkId") % 100 == 0).select(
        F.col("anchorId").alias("anchor_id"), F.col("positiveId").alias("positive_id"), "rank",
        F.col("negativeId").alias("negative_id"), F.col("positiveScore").alias("positive_score"),
        F.col("negativeScore").alias("negative_score"))


def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    start = F.sha2(F.concat(F.lit("2:"), F.col("chunkId").cast("string")).cast("binary"), 256)
    return centroid_clusters.clustered(_embeddings(spark, folder), start).select(
        F.col("chunkId").alias("vec_id"), "cluster", "distance",
        F.col("clusterInertia").alias("cluster_inertia"), "inertia",
        F.col("centroidSha256").alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_bpe, op2_ngram_join, op3_line_dedup, op4_quality_classifier, op5_url_filters,
    op6_substring_dedup, op7_decontamination, op8_lm_scoring, op9_quality_rules,
    op10_chat_formatting, op11_token_files, op12_hard_negatives, op13_centroid_clusters,
)}
_LINE_DEDUP = """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
numbered AS (
  SELECT doc_id, i, lines[i] AS line, trim(lines[i], E' \\t\\v\\f\\r') AS words
  FROM cut, unnest(range(1, len(lines) + 1)) AS u(i)),
worded AS (
  SELECT doc_id, i, words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place
  FROM numbered WHERE words <> ''),
pairs AS (
  SELECT doc_id, place, words AS a, lead(words) OVER (PARTITION BY doc_id ORDER BY place) AS b
  FROM worded),
ranked AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, place) AS k
  FROM pairs WHERE b IS NOT NULL),
gone AS (
  SELECT DISTINCT doc_id, place + d AS place FROM ranked, (VALUES (0), (1)) AS v(d) WHERE k > 1),
marked AS (
  SELECT n.doc_id, n.i, n.line, n.words <> '' AS worded, g.doc_id IS NOT NULL AS gone
  FROM numbered n LEFT JOIN worded w ON w.doc_id = n.doc_id AND w.i = n.i
  LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.place = w.place)
SELECT doc_id, count(*) FILTER (WHERE worded) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
_URL_FILTERS = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3)
    ELSE '' END AS rest FROM pages),
parted AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fitting AS (
  SELECT p.page_id, r.host || r.path AS rule, r.verdict, row_number() OVER (
    PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM parted p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host))
    AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parted p LEFT JOIN fitting f ON f.page_id = p.page_id AND f.k = 1
"""
SQL: dict[str, str] = {"op3_line_dedup": _LINE_DEDUP, "op5_url_filters": _URL_FILTERS}
