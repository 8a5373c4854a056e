"""The driver's tables in the roles of this library's tables.

Everything here is derived from whole tables; nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.vectors import hashed_embedder
from loomdex.operators.answers import assembled_records, retrieved_lists
from loomdex.operators.chunks import chunk_documents
from loomdex.operators.experiments import retrieval_results
from loomdex.operators.passages import containing_documents
from loomdex.operators.retrieval import retrieve_from_documents, valid_questions
from loomdex.operators.runs import evaluation_results
from loomdex.session import written

NO_CONTEXT_ANSWER = (
    "Nothing that was found helps here: it does not provide enough information for an answer."
)
ANSWER_FROM_COSINE = 0.8    # below it, the stand-in answer says the context is insufficient
EXPERIMENTS = {"chunk-300": (300, 50), "chunk-800": (800, 100)}
INPUT_PARTITIONS = "spark.loomdex.inputPartitions"


SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; where the schema is known no job is spent on reading footers."""
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Deal the rows out over as many partitions as the session asks for, if it does.

    A small file has one row group, which keeps one core busy; a session for such files (the
    benchmark) names a number. Otherwise the table is read as it lies.
    """
    parts = rows.sparkSession.conf.get(INPUT_PARTITIONS, None)
    return rows.repartition(int(parts)) if parts else rows


def document_id(number: str | Column) -> Column:
    return F.concat(F.lit("doc-"), F.col(number) if isinstance(number, str) else number)


def _url(source: str, number: str) -> Column:
    return F.concat(F.lit("https://corpus.example/"), F.col(source), F.lit("/"), F.col(number))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as cleaned document records."""
    return spread(table(spark, folder, "documents")).select(
        document_id("doc_id").alias("documentId"),
        F.concat("lang", F.lit(" / "), "source").alias("title"),
        "source", _url("source", "doc_id").alias("sourceUrl"),
        F.col("lang").alias("category"),
        F.concat(F.lit("data/raw/doc-"), "doc_id", F.lit(".txt")).alias("originalFile"), "text",
    )


def chunks(spark: SparkSession, folder: str, experiment: str = "chunk-800") -> DataFrame:
    return chunk_documents(documents(spark, folder), *EXPERIMENTS[experiment])


# --- questions ------------------------------------------------------------------
def first_containing_document(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: the document with the smallest number whose text contains the item.

    The smallest is taken before the shuffle too, so a passage copied into very many
    documents is one row per task.
    """
    found = containing_documents(docs, items, document_id="doc_id", passage_id="item_id",
                                 passage="passage", payload=("lang", "source"))
    first = found.groupBy("item_id").agg(F.min(F.struct("doc_id", "lang", "source")).alias("d"))
    return first.select("item_id", "d.*")


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """``benchmark`` passages as questions.

    The expected source is the first document that contains the passage; a
    passage in no document is out of scope.
    """
    items = table(spark, folder, "benchmark").select("item_id", "text")
    expected = first_containing_document(
        spread(table(spark, folder, "documents")), items.withColumnRenamed("text", "passage"))
    joined = items.join(expected, "item_id", "left")
    known = F.col("doc_id").isNotNull()
    return joined.select(
        F.concat(F.lit("Q"), "item_id").alias("id"),
        F.coalesce("lang", F.lit("out-of-scope")).alias("category"),
        F.col("text").alias("question"),
        F.when(known, F.col("text")).otherwise("insufficient").alias("groundTruth"),
        F.when(known, document_id("doc_id")).otherwise("").alias("expectedSource"),
        F.when(known, _url("source", "doc_id")).otherwise("").alias("expectedSourceUrl"),
        F.when(known, "in_scope").otherwise("out_of_scope").alias("scope"),
        F.col("item_id").alias("position"),
    )


def retrieved(spark: SparkSession, folder: str, experiment: str = "chunk-800") -> DataFrame:
    """Top five chunks of every benchmark passage."""
    asked = table(spark, folder, "benchmark").select(
        F.concat(F.lit("Q"), "item_id").alias("id"), F.col("text").alias("question")
    )
    size, overlap = EXPERIMENTS[experiment]
    return retrieve_from_documents(
        documents(spark, folder), asked, hashed_embedder(), size=size, overlap=overlap)


# --- runs and results --------------------------------------------------------------
def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as a log with latencies in whole milliseconds and error messages."""
    key = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    code = F.when(key < 30, "429").when(key < 60, "503").otherwise("400")
    message = F.concat(
        F.lit('{"error":{"code":'), code, F.lit(',"message":"'),
        F.when(key % 2 == 0, "Quota exceeded for user ").otherwise("Request failed for user "),
        F.repeat(F.concat(F.col("user_id").cast("string"), F.lit(" ")), F.lit(60)), F.lit('"}}'),
    )
    return table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.round(F.col("value") * 100).cast("long").alias("ms"),
        F.when(F.col("event_type") == "error", message).alias("message"),
    )


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Answer records of all benchmark questions.

    Answers are input data; here the best chunk's text stands in for a model's
    answer. It is taken from the retrieved list, so retrieval runs once.
    """
    lists = retrieved_lists(retrieved(spark, folder)).withColumnRenamed("queryId", "id")
    asked = table(spark, folder, "benchmark").select(
        F.concat(F.lit("Q"), "item_id").alias("id"), F.col("text").alias("question")
    )
    times = run_log(spark, folder).select(
        F.concat(F.lit("Q"), "event_id").alias("id"),
        F.col("ms").alias("retrievalMs"), (F.col("ms") * 7).alias("generationMs"),
    )
    best = F.get(F.col("retrieved"), F.lit(0))
    answer = F.when(best["cosine"] < ANSWER_FROM_COSINE, NO_CONTEXT_ANSWER).otherwise(best["text"])
    joined = valid_questions(asked).join(lists, "id", "left").join(times, "id", "left")
    return assembled_records(joined.withColumn("answer", answer), NO_CONTEXT_ANSWER)


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation results of all benchmark questions; ``error`` events are failed runs."""
    log = run_log(spark, folder)
    failures = log.filter(F.col("message").isNotNull()).select(
        F.concat(F.lit("Q"), "event_id").alias("id"), "message", F.col("ms").alias("elapsedMs")
    )
    return evaluation_results(
        questions(spark, folder), records(spark, folder), failures
    )


def experiment_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Per-question retrieval results of both chunk configurations."""
    asked = written(questions(spark, folder))    # both read it; passages are sought once
    log = run_log(spark, folder)
    out = None
    for at, experiment in enumerate(sorted(EXPERIMENTS)):
        failed = (F.col("event_type") == "error") if at == 0 else (
            (F.col("event_type") == "signup") & (F.col("ms") > 5000)
        )
        latencies = log.select(
            F.concat(F.lit("Q"), "event_id").alias("id"),
            (F.col("ms") * (at + 1)).alias("latencyMs"), F.when(failed, "failed").alias("error"),
        )
        found = retrieved_lists(retrieved(spark, folder, experiment))
        rows = retrieval_results(asked, found, experiment, latencies=latencies)
        out = rows if out is None else out.unionByName(rows)
    return out


def customer_questions(spark: SparkSession, folder: str) -> DataFrame:
    """``customer`` as a larger question list for run bookkeeping."""
    return table(spark, folder, "customer").select(
        F.concat(F.lit("Q"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("category"),
        F.col("c_name").alias("question"), F.col("c_custkey").alias("position"),
    )


def previous_runs(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as earlier attempts at those questions, several per question."""
    good = (F.col("event_type") == "purchase") & (F.col("value") > 100)
    return table(spark, folder, "events").select(
        F.concat(F.lit("Q"), "user_id").alias("id"), F.col("event_id").alias("attempt"),
        F.when(good, "success").otherwise("error").alias("status"), "value",
    )


def new_runs(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as the rows of a new run over the questions that were left."""
    latest = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.max("o_orderkey").alias("attempt"),
        F.max_by("o_orderstatus", "o_orderkey").alias("s"),
        F.max_by("o_totalprice", "o_orderkey").alias("value"),
    )
    return latest.select(
        F.concat(F.lit("Q"), "o_custkey").alias("id"), "attempt",
        F.when(F.col("s") == "F", "error").otherwise("success").alias("status"), "value",
    )


# --- corpus and vector tables ------------------------------------------------------------
def selection(spark: SparkSession, folder: str) -> DataFrame:
    """``part`` as the list of selected documents."""
    return table(spark, folder, "part").select(
        document_id("p_partkey").alias("id"), F.col("p_name").alias("title"),
        F.concat(F.lit("https://corpus.example/part/"), "p_partkey").alias("url"),
        F.col("p_brand").alias("category"),
    )


def marked_up(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` with markup around the text, as a raw corpus.

    Spanish documents sit inside a directive as a whole, so nothing is left of them.
    """
    text = F.concat(
        F.lit(".. meta::\n   :keywords: "), "lang", F.lit("\n\n.. _"), "source",
        F.lit(":\n\n=====\n "), "source", F.lit(" page\n=====\n\n.. default-domain:: corpus\n\n"),
        F.lit("See :ref:`the "), "lang", F.lit(" index <idx-"), "source", F.lit(">` and :doc:`/"),
        "source", F.lit("`, ``"), "source", F.lit("`` or |"), "lang",
        F.lit("| {+name+}.\n\nBody\n----\n\n.. note::\n   :class: x\n\n   not kept\n\n"),
        F.lit(".. code-block:: text\n\n     kept code\n\n.. include:: /x.rst\n\n"),
        "text", F.lit("\n\n  .. tip:: orphan\n- .. include:: /y.rst\n.. closing comment\n"),
    )
    inside = F.concat(
        F.lit(".. note::\n   "), F.replace(F.col("text"), F.lit("\n"), F.lit("\n   ")), F.lit("\n")
    )
    return spread(table(spark, folder, "documents")).select(
        document_id("doc_id").alias("id"),
        F.when(F.col("lang") == "es", inside).otherwise(text).alias("text"),
    )


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` as the manifest: it has an entry for a part of the documents."""
    return table(spark, folder, "embeddings").select(
        document_id("vec_id").alias("id"), F.concat(F.lit("Document "), "vec_id").alias("title"),
        F.lit("corpus").alias("source"),
        F.concat(F.lit("https://corpus.example/"), "vec_id").alias("sourceUrl"),
        F.concat(F.lit("data/raw/doc-"), "vec_id", F.lit(".txt")).alias("file"),
        F.concat(F.lit("label-"), "label").alias("category"),
    )


def vector_records(spark: SparkSession, folder: str) -> DataFrame:
    """Vector records with every kind of fault: documents without a vector,
    labelled documents a second time, some of those without id or text."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding"
    )
    labels = table(spark, folder, "labels")
    again = docs.join(labels, "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 0, document_id("doc_id")).alias("chunkId"),
        F.when((F.col("quality") == 0), " \n\t ").otherwise(F.col("text")).alias("text"),
    )
    every = docs.select("doc_id", document_id("doc_id").alias("chunkId"), "text").unionByName(again)
    return every.join(vectors, "doc_id", "left").select("chunkId", "text", "embedding")


def label_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vector of each label of ``embeddings``, as query vectors."""
    cells = table(spark, folder, "embeddings").select("label", F.posexplode("embedding"))
    means = cells.groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy("label").agg(
        F.transform(ordered, lambda c: c["mean"]).alias("centroid")
    )
