"""Incremental ingest: new raw files are cleaned, chunked, embedded and upserted.

A digest of each source (text, manifest entry, chunk settings) is kept beside the table, so a
source that is loaded already is not cleaned or embedded again, and of a source that changed the
chunks it no longer has are removed. A repeated micro-batch leaves the table as it was.

Spark reads a path once: a changed text has to arrive under a path of its own, such as
``<folder>/<date>/<id>.txt``, with ``<folder>/*`` as the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loomdex import fixed_values as fv
from loomdex import schemas
from loomdex.functions.vectors import Embedder
from loomdex.operators.embedding import embedded_rows, failed_rows
from loomdex.operators.store import read_store, upsert_table
from loomdex.plans.ingest import write_ingest
from loomdex.sources.files import raw_documents


SOURCES = T.StructType([
    T.StructField("documentId", T.StringType()), T.StructField("sourceDigest", T.StringType())])


def raw_file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """id and text of new files, with their path and time of modification."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    texts = stream.text(folder, wholetext=True, pathGlobFilter="*.txt")
    return raw_documents(
        texts, F.col("_metadata.file_modification_time").alias("modified"),
        F.col("_metadata.file_path").alias("path"))


def _digested(batch: DataFrame, manifest: DataFrame, size: int, overlap: int) -> DataFrame:
    """The batch with a digest of everything that its chunks depend on."""
    entry = F.struct(*[c for c in manifest.columns if c != "id"]).alias("entry")
    content = F.struct("text", "entry", F.lit(size), F.lit(overlap))
    digest = F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256)
    return batch.join(manifest.select("id", entry), "id", "left").select(
        *batch.columns, digest.alias("sourceDigest"))


def _latest(texts: DataFrame) -> DataFrame:
    """One text per id: that of the file modified last. Texts are not grouped for it."""
    last = texts.groupBy("id").agg(F.max(F.struct("modified", "path")).alias("last")).select("id", "last.*")
    return texts.join(last, ["id", "modified", "path"], "left_semi")


def start_ingest(spark: SparkSession, folder: str, manifest: DataFrame, table: str,
                 staging: str, checkpoint: str, embedder: Embedder, experiment: str,
                 size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> StreamingQuery:
    """Process all files that are there now and stop; start again for later ones.

    Each batch is cleaned and embedded once into ``staging`` (overwritten per batch), then
    upserted from there. Chunks that could not be embedded are kept in ``<table>_failures``,
    documents without a manifest entry or empty after cleaning in ``<table>_rejects``; what
    was stored of them before is removed. ``<table>_sources`` has the digests of documents
    that are loaded without a failure; the others are tried again when they arrive again.
    """
    sources = f"{table}_sources"

    def load(batch: DataFrame, batch_id: int) -> None:
        _digested(batch, manifest, size, overlap).write.mode("overwrite").parquet(f"{staging}/arrived")
        arrived = _latest(spark.read.parquet(f"{staging}/arrived"))
        known = read_store(spark, sources, SOURCES).filter(F.col("experiment") == experiment).select(
            F.col("documentId").alias("id"), "sourceDigest")
        arrived.join(known, ["id", "sourceDigest"], "left_anti").write.mode("overwrite").parquet(
            f"{staging}/changed")
        changed = spark.read.parquet(f"{staging}/changed")
        ids = changed.select(F.col("id").alias("documentId"))

        done, rejects = write_ingest(changed.select("id", "text"), manifest, embedder, staging, size, overlap)
        # a batch that is run again after a failure replaces its own rejects and dead letters
        rejects.write.mode("overwrite").parquet(f"{table}_rejects/batch={batch_id}")
        failed_rows(done).write.mode("overwrite").parquet(f"{table}_failures/batch={batch_id}")

        # Digests go before the chunks change and come after: no digest tells of chunks that
        # are not stored, wherever the batch ends.
        upsert_table(spark, sources, spark.createDataFrame([], SOURCES), experiment, "documentId", removed=ids)
        stored = read_store(spark, table, schemas.EMBEDDED_CHUNKS).filter(F.col("experiment") == experiment)
        before = stored.select("chunkId", "documentId").join(ids, "documentId", "left_semi")
        upsert_table(spark, table, embedded_rows(done), experiment, removed=before)
        whole = done.groupBy("documentId").agg(F.count("error").alias("failed")).filter("failed = 0")
        loaded = changed.select(F.col("id").alias("documentId"), "sourceDigest").join(
            whole, "documentId", "left_semi")
        upsert_table(spark, sources, loaded, experiment, "documentId")

    return (
        raw_file_stream(spark, folder).writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
