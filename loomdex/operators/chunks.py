"""Documents to chunk rows, and reports on a chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex import fixed_values as fv
from loomdex.functions.chunking import check_chunk_config, chunk_texts
from loomdex.functions.text import is_blank, round_half_up, trimmed


def chunk_documents(documents: DataFrame, size: int = fv.CHUNK_SIZE,
                    overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk; blank documents give none. No shuffle.

    The id is the document id and the index, padded to at least four digits.
    """
    check_chunk_config(size, overlap)
    meta = ["documentId", "title", "source", "sourceUrl", "category"]
    pieces = documents.filter(~is_blank(F.col("text"))).select(
        *meta, F.posexplode(chunk_texts(F.col("text"), size, overlap)).alias("chunkIndex", "text")
    )
    index = F.col("chunkIndex").cast("string")
    digits = F.greatest(F.lit(fv.CHUNK_INDEX_DIGITS), F.length(index))
    return pieces.select(
        F.concat("documentId", F.lit("-"), F.lpad(index, digits, F.lit("0"))).alias("chunkId"),
        *meta, "chunkIndex", "text",
        F.lit(size).alias("chunkSize"), F.lit(overlap).alias("overlap"),
    )


def chunk_document_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: its length, number of chunks, shortest, longest, average chunk.

    Lengths are aggregated before the join, so a document with very many chunks
    reaches the join as one row.
    """
    length = F.length("text")
    per_document = chunks.groupBy("documentId").agg(
        F.count(F.lit(1)).alias("num_chunks"),
        F.min(length).alias("min_len"), F.max(length).alias("max_len"),
        round_half_up(F.avg(length), 0).cast("long").alias("avg_len"),
    )
    sizes = documents.select("documentId", F.length("text").alias("doc_len"))
    return sizes.join(per_document, "documentId").select(
        "documentId", "doc_len", "num_chunks", "min_len", "max_len", "avg_len"
    )


def chunk_report(documents: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """Totals over the chunk table; the smallest id wins among equal lengths.

    Documents and chunks are counted in one aggregation over their union.
    """
    rows = chunks.select("chunkId", F.length("text").alias("n")).unionByName(
        documents.select(F.lit(None).cast("string").alias("chunkId"),
                         F.lit(None).cast("int").alias("n"))
    )
    is_chunk = F.col("chunkId").isNotNull()
    totals = rows.agg(
        F.count_if(~is_chunk).alias("documents"),
        F.count_if(is_chunk).alias("chunks"),
        round_half_up(F.avg("n"), 0).cast("long").alias("avg_len"),
        F.min(F.when(is_chunk, F.struct("n", "chunkId"))).alias("shortest"),
        F.min(F.when(is_chunk, F.struct((-F.col("n")).alias("n"), "chunkId"))).alias("longest"),
    )
    return totals.select(
        "documents", "chunks",
        F.when(F.col("documents") > 0,
               round_half_up(F.col("chunks") / F.col("documents"), 1)).alias("chunks_per_document"),
        "avg_len",
        F.col("shortest.n").alias("min_len"), F.col("shortest.chunkId").alias("min_chunk"),
        (-F.col("longest.n")).alias("max_len"), F.col("longest.chunkId").alias("max_chunk"),
        F.lit(int(size / fv.CHARS_PER_TOKEN + 0.5)).alias("tokens_per_chunk"),
    )


def overlap_check(chunks: DataFrame) -> DataFrame:
    """For every pair of neighbouring chunks: is the carried tail found in the next one?

    Each chunk sends its tail to its own place and its head to the place before;
    both meet under the key (document, index). One pass over the chunks, at most
    two rows per key, so a document with very many chunks spreads over all tasks.
    """
    tail = trimmed(F.left(F.expr("right(text, overlap)"), F.lit(fv.OVERLAP_PROBE_CHARS)))
    head = F.left(F.col("text"), F.col("overlap") + fv.OVERLAP_PROBE_SLACK)
    nothing = F.lit(None).cast("string")
    sent = chunks.select("documentId", F.inline(F.array(
        F.struct(F.col("chunkIndex"), tail.alias("probe"), nothing.alias("head")),
        F.struct((F.col("chunkIndex") - 1).alias("chunkIndex"), nothing.alias("probe"),
                 head.alias("head")),
    )))
    met = sent.groupBy("documentId", "chunkIndex").agg(
        F.max("probe").alias("probe"), F.max("head").alias("head")
    )
    return met.filter(F.col("probe").isNotNull() & F.col("head").isNotNull()).select(
        "documentId", "chunkIndex", F.contains("head", "probe").alias("overlap_found")
    )
