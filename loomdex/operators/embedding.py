"""Turning chunk texts into vectors, with row-level dead letters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex import fixed_values as fv
from loomdex.functions.text import is_blank
from loomdex.functions.vectors import HASH_BUCKETS, Embedder, hash_bucket, terms
from loomdex.operators.ordering import numbered
from loomdex.schemas import VECTOR

_SLICE_ROWS = 20 * fv.EMBED_BATCH   # rows embedded before they are handed on

def _vectors_of(texts: list[str], embedder: Embedder) -> list[np.ndarray]:
    """Vectors of one batch, or an exception naming what is wrong with the batch."""
    matrix = embedder(texts)
    if len(matrix) != len(texts):
        raise ValueError(f"embedder returned {len(matrix)} vectors for {len(texts)} texts")
    if any(len(v) == 0 for v in matrix):
        raise ValueError("embedder returned an empty vector")
    return [np.asarray(v, dtype=np.float32) for v in matrix]


def embedded_texts(texts: Sequence[str | None], embedder: Embedder,
                   batch_size: int = fv.EMBED_BATCH) -> tuple[list, list]:
    """(vectors, errors) of the texts; exactly one of the two is None at each place.

    The embedder gets ``batch_size`` texts per call. A batch that fails is tried again row
    by row. Blank texts never reach the embedder.
    """
    def one_call(batch: list[str]) -> tuple[list, list]:
        try:
            return _vectors_of(batch, embedder), [None] * len(batch)
        except Exception as failure:  # noqa: BLE001 - any embedder failure is a dead letter
            if len(batch) == 1:
                return [None], [str(failure)]
        parts = [one_call([t]) for t in batch]
        return [p[0][0] for p in parts], [p[1][0] for p in parts]

    vectors: list = [None] * len(texts)
    errors: list = ["empty text"] * len(texts)
    good = [i for i, t in enumerate(texts) if t is not None and t.strip(fv.WHITESPACE)]
    for begin in range(0, len(good), batch_size):
        at = good[begin:begin + batch_size]
        found, failed = one_call([texts[i] for i in at])
        for i, vector, error in zip(at, found, failed):
            vectors[i], errors[i] = vector, error
    return vectors, errors


def embed(rows: DataFrame, embedder: Embedder, *, id_col: str = "chunkId", text: str = "text",
          out: str = "embedding", batch_size: int = fv.EMBED_BATCH) -> DataFrame:
    """Add ``embedding`` and ``error``; exactly one of the two is null in each row.

    The embedder gets ``batch_size`` texts per call. A batch that fails is tried
    again row by row, so only the rows at fault become dead letters and the job
    goes on. Blank texts never reach the embedder.
    """
    kept = [f for f in rows.schema.fields if f.name not in (out, "error")]
    schema = T.StructType(
        kept + [T.StructField(out, VECTOR), T.StructField("error", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # vectors are many times the size of their texts, so a few rows are held at a time
            for begin in range(0, whole.num_rows, _SLICE_ROWS):
                batch = whole.slice(begin, _SLICE_ROWS)
                vectors, errors = embedded_texts(batch.column(text).to_pylist(), embedder, batch_size)
                sizes = [0 if v is None else len(v) for v in vectors]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                present = [v for v in vectors if v is not None]
                flat = np.concatenate(present) if present else np.empty(0, dtype=np.float32)
                column = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(flat, type=pa.float32()),
                    mask=pa.array([v is None for v in vectors]),
                )
                columns = [batch.column(f.name) for f in kept]
                columns += [column, pa.array(errors, type=pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return rows.select(*[f.name for f in kept]).mapInArrow(run, schema)


def embedded_rows(embedded: DataFrame) -> DataFrame:
    return embedded.filter(F.col("error").isNull()).drop("error")


def failed_rows(embedded: DataFrame, id_col: str = "chunkId") -> DataFrame:
    """The dead letters: id and error."""
    return embedded.filter(F.col("error").isNotNull()).select(id_col, "error")


def rejected_texts(chunks: DataFrame, id_col: str = "chunkId", text: str = "text") -> DataFrame:
    """Rows that cannot be embedded at all, found without calling an embedder."""
    return chunks.filter(is_blank(F.col(text))).select(id_col, F.lit("empty text").alias("error"))


def hashed_terms(chunks: DataFrame, id_col: str = "chunkId", text: str = "text",
                 buckets: int = HASH_BUCKETS) -> DataFrame:
    """The hashed vectors in sparse form: (id, bucket, n), native expressions only.

    One row's terms are counted inside the row (sorted buckets, run lengths), so
    no term occurrence is ever shuffled.
    """
    rows = chunks.select(id_col, F.array_sort(
        F.transform(terms(F.col(text)), lambda t: hash_bucket(t, buckets))
    ).alias("sorted"))
    # the last position of each bucket in the sorted list, then differences of positions
    ends = F.filter(
        F.transform(F.col("sorted"), lambda b, i: F.struct(b.alias("bucket"), i.alias("at"))),
        lambda e: ~F.coalesce(F.get(F.col("sorted"), e["at"] + 1) == e["bucket"], F.lit(False)),
    )
    rows = rows.select(id_col, ends.alias("ends"))
    counted = F.transform(F.col("ends"), lambda e, i: F.struct(
        e["bucket"].alias("bucket"),
        (e["at"] - F.coalesce(F.get(F.col("ends"), i - 1)["at"], F.lit(-1))).alias("n"),
    ))
    return rows.select(id_col, F.inline(counted))


def batch_labels(chunks: DataFrame, batch_size: int = fv.EMBED_BATCH) -> DataFrame:
    """One row per embedding batch with the range of chunk numbers it covers.

    The ranges follow from the row count alone, so nothing is numbered or sorted;
    ``batch_members`` tells which chunks a batch held.
    """
    span = 1_000_000  # batches per outer step; keeps each sequence array small
    total = chunks.agg(F.count(F.lit(1)).alias("n_chunks")).withColumn(
        "n_batches", F.ceil(F.col("n_chunks") / batch_size)
    ).filter(F.col("n_batches") > 0)
    outer = total.withColumn(
        "step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_batches - 1) div {span}")))
    )
    first = F.col("step") * span + 1
    last = F.least(F.col("n_batches"), (F.col("step") + 1) * span)
    return outer.select(
        F.explode(F.sequence(first, last)).alias("batch"), "n_batches", "n_chunks"
    ).select(
        "batch", "n_batches",
        ((F.col("batch") - 1) * batch_size + 1).alias("first_chunk"),
        F.least(F.col("batch") * batch_size, F.col("n_chunks")).alias("last_chunk"),
    )


def batch_members(chunks: DataFrame, batch_size: int = fv.EMBED_BATCH,
                  order: Sequence[str] = ("documentId", "chunkIndex")) -> DataFrame:
    """batch, n_batches, first_chunk, last_chunk and chunkIds (in order) of every batch.

    Batches are cut from the chunks in ``order``, numbered from 1; the last may be shorter.
    """
    rows = numbered(chunks.select("chunkId", *order), order)
    batches = rows.groupBy((F.floor(F.col("number") / batch_size) + 1).alias("batch")).agg(
        F.min("number").alias("first"), F.max("number").alias("last"),
        F.array_sort(F.collect_list(F.struct("number", "chunkId"))).alias("held"))
    n_batches = -(-rows.count() // batch_size)
    return batches.select(
        "batch", F.lit(n_batches).cast("long").alias("n_batches"), (F.col("first") + 1).alias("first_chunk"),
        (F.col("last") + 1).alias("last_chunk"),
        F.transform("held", lambda h: h["chunkId"]).alias("chunkIds"))


def embed_todo(chunks: DataFrame, embedded: DataFrame, id_col: str = "chunkId") -> DataFrame:
    """Chunks that have no usable vector yet; the rest is not embedded again."""
    done = embedded.filter(F.size(F.col("embedding")) > 0).select(id_col)
    return chunks.join(done, id_col, "left_anti")
