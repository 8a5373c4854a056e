"""Models fitted on a bounded sample of labelled documents, in one task.

Only fitting is bounded. Scoring covers every document.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.word_arrays import Words, memory_returned, slices

MAX_LABELLED = 6000     # rows a model is fitted on at most, chosen by a hash of documentId


def fitted(
    documents: DataFrame, labels: DataFrame, features: Callable[[Words], np.ndarray],
    fit: Callable[[np.ndarray, np.ndarray, np.ndarray], Any], max_rows: int = MAX_LABELLED,
) -> Any:
    """What ``fit`` makes of (feature rows, quality 0/1, fold 0..4) of the labelled documents.

    ``labels``: documentId, quality. Rows without either are left out; a document labelled
    several times has its majority's label. At most ``max_rows`` documents and rows are
    taken, in the order of hashes of documentId and text. The sample is broadcast to the
    documents, which ``max_rows`` bounds, so no text is shuffled; its features come together
    in one task, and only what ``fit`` returns, plain arrays and numbers, comes to the driver.
    """
    chosen = (
        labels.select("documentId", "quality").dropna()
        .groupBy("documentId").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
        .orderBy(F.xxhash64("documentId"), "documentId").limit(max_rows)
    )
    rows = documents.select("documentId", "text").join(F.broadcast(chosen), "documentId").select(
        "text", "quality", F.pmod(F.crc32(F.col("documentId").cast("string")), F.lit(5)).alias("fold"),
        F.xxhash64("documentId").alias("place"), F.xxhash64("text").alias("content"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches, 0):
            found = features(Words(texts)).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in found], pa.binary()), *piece.columns[1:]],
                names=["features", "quality", "fold", "place", "content"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, others = [], []
        for batch in batches:
            raw = b"".join(batch.column(0).to_pylist())
            parts.append(np.frombuffer(raw, np.float16).reshape(batch.num_rows, -1))
            others.append(np.stack([batch.column(i).to_numpy() for i in (1, 2)], 1))
        if parts:
            held, other = np.concatenate(parts), np.concatenate(others)
            parts.clear()
        else:
            held, other = np.zeros((0, features(Words([None])).shape[1]), np.float16), np.zeros((0, 2))
        # One order, whatever the order of the tasks was: sums of floats depend on it.
        order = np.lexsort((other[:, 0], *held[:, :64].T, other[:, 1]))
        held = held[order].astype(np.float32)
        model = fit(held, other[order, 0].astype(np.float64), other[order, 1])
        del held
        memory_returned()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    sample = rows.mapInArrow(
        made, "features binary, quality int, fold long, place long, content long",
    ).orderBy("place", "content").limit(max_rows).select("features", "quality", "fold")
    found = sample.coalesce(1).mapInArrow(together, "model binary").collect()
    if not found:   # Spark leaves out tasks of tables that it knows to be empty
        return fit(np.zeros((0, features(Words([None])).shape[1]), np.float32), *np.zeros((2, 0)))
    return pickle.loads(found[0]["model"])
