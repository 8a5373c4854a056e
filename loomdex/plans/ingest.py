"""The offline load: clean, chunk, embed; in one lazy plan, or with its rejects written."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomdex import fixed_values as fv
from loomdex.functions.vectors import Embedder
from loomdex.operators.chunks import chunk_documents
from loomdex.operators.corpus import clean_corpus, parse_rejects, parsed_documents
from loomdex.operators.embedding import embed


def ingest_plan(raw: DataFrame, manifest: DataFrame, embedder: Embedder,
                size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """Raw texts to chunk rows with ``embedding`` and ``error``.

    No shuffle except the manifest join (a broadcast join while the manifest is
    below the broadcast threshold of the session). Rejected documents are not in it.
    """
    documents = parsed_documents(clean_corpus(raw, manifest))
    return embed(chunk_documents(documents, size, overlap), embedder)


def write_ingest(raw: DataFrame, manifest: DataFrame, embedder: Embedder, folder: str,
                 size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> tuple[DataFrame, DataFrame]:
    """The same, written below ``folder``: (chunk rows, rejects with file and reason).

    The cleaned texts are written first, so that both come from one cleaning.
    """
    spark = raw.sparkSession
    clean_corpus(raw, manifest).drop("rawText").write.mode("overwrite").parquet(f"{folder}/cleaned")
    cleaned = spark.read.parquet(f"{folder}/cleaned")
    chunks = chunk_documents(parsed_documents(cleaned), size, overlap)
    embed(chunks, embedder).write.mode("overwrite").parquet(f"{folder}/embedded")
    return spark.read.parquet(f"{folder}/embedded"), parse_rejects(cleaned)
