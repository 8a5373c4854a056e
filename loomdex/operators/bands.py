"""Approximate search that prunes: questions meet chunks under band keys of a sign sketch.

A vector has one key per band: the signs of a few fixed projections. Keys are stored with
the vectors. A question probes, in every band, all keys within ``radius`` bits of its own,
so chunks that share no such key are never scored. Whoever meets gets an exact cosine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex import fixed_values as fv
from loomdex.functions.vectors import cosine, score_of

BANDS = 12
BITS = 10
RADIUS = 2
SCALE = 1024                # components enter a projection as floor(SCALE * x), so sums are exact
BUCKET_ROWS = 1 << 16       # buckets with more chunks are split


def plane_signs(dimension: int, bands: int = BANDS, bits: int = BITS) -> np.ndarray:
    """+1 or -1 per band, bit and component: whether md5("band:bit:component") begins below 8."""
    return np.array([[[1 if hashlib.md5(f"{b}:{j}:{d}".encode()).hexdigest()[0] < "8" else -1
                       for d in range(dimension)] for j in range(bits)] for b in range(bands)])


def with_band_keys(vectors: DataFrame, dimension: int, *, vector: str = "embedding",
                   out: str = "bandKeys", bands: int = BANDS, bits: int = BITS) -> DataFrame:
    """Add the array of band keys; null where the vector is null, empty or has null parts.

    Store it with the vectors: a search then reads these few numbers per chunk. Vectors of
    another length than ``dimension`` are an error.
    """
    planes = plane_signs(dimension, bands, bits).reshape(bands * bits, dimension).T.astype(np.float64)
    weights = 1 << np.arange(bits)
    schema = T.StructType(vectors.schema.fields + [T.StructField(out, T.ArrayType(T.IntegerType()))])
    place = vectors.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            sizes = np.asarray(column.value_lengths().fill_null(0))
            if set(np.unique(sizes[sizes > 0]).tolist()) - {dimension}:
                raise ValueError(f"vectors of other than {dimension} dimensions")
            keys: list[list[int] | None] = [None] * batch.num_rows
            rows = np.flatnonzero(sizes > 0)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.floor(SCALE * values.reshape(len(rows), dimension))
            signs = (whole @ planes >= 0).reshape(len(rows), bands, bits) @ weights
            known = ~np.isnan(whole).any(1)
            for row, own in zip(rows[known].tolist(), signs[known].tolist()):
                keys[row] = own
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.list_(pa.int32()))], names=schema.names)

    return vectors.mapInArrow(run, schema)


def meeting_pairs(chunks: DataFrame, questions: DataFrame, *, chunk_id: str = "chunkId",
                  query_id: str = "queryId", keys: str = "bandKeys", bits: int = BITS,
                  radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """query id and chunk id of all pairs with a band whose keys differ in ``radius`` bits at most.

    A pair that meets in several bands comes from the first of them, so nothing has to be
    made distinct. The chunks of a large bucket are dealt to slots that each probe visits;
    bucket sizes are at most bands * 2**bits rows, whatever the table holds.
    """
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    stored = chunks.select(F.col(chunk_id).alias("__chunk"), F.col(keys).alias("__own"))
    placed = stored.select("*", F.posexplode("__own").alias("band", "key"))
    sizes = placed.groupBy("band", "key").agg(
        F.ceil(F.count(F.lit(1)) / bucket_rows).cast("int").alias("slots"))
    large = F.broadcast(sizes.filter("slots > 1"))
    slots = F.coalesce("slots", F.lit(1))
    dealt = placed.join(large, ["band", "key"], "left").withColumn(
        "slot", F.pmod(F.xxhash64("__chunk"), slots).cast("int")).drop("slots")
    probes = (
        questions.select(F.col(query_id).alias("__query"), F.col(keys).alias("__asked"))
        .select("*", F.posexplode("__asked").alias("band", "near"))
        .withColumn("key", F.explode(F.transform(
            F.array(*[F.lit(m) for m in masks]), lambda m: F.col("near").bitwiseXOR(m))))
        .join(large, ["band", "key"], "left")
        .withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1))).drop("slots"))
    close = F.zip_with("__asked", "__own", lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius)
    return (
        dealt.join(probes, ["band", "key", "slot"])
        .filter(F.array_position(close, F.lit(True)) == F.col("band") + 1)
        .select(F.col("__query").alias(query_id), F.col("__chunk").alias(chunk_id)))


def nearest_in_bands(chunks: DataFrame, questions: DataFrame, k: int = fv.TOP_K, *,
                     chunk_id: str = "chunkId", vector: str = "embedding",
                     query_id: str = "queryId", query_vector: str = "embedding",
                     keys: str = "bandKeys", bits: int = BITS, radius: int = RADIUS,
                     bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The k nearest chunks of every question among those that it meets in some band.

    ``chunks`` (unique chunk ids) and ``questions`` (unique query ids) carry the keys of
    ``with_band_keys``. Returns query id, chunk id, ``cosine``, ``score`` and ``rank``;
    equal cosines are ordered by chunk id, vectors without direction are not found. The
    pairs carry ids only; vectors are joined to them.
    """
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError(f"k must be a positive integer, got {k!r}")
    pairs = meeting_pairs(chunks, questions, chunk_id=chunk_id, query_id=query_id, keys=keys,
                          bits=bits, radius=radius, bucket_rows=bucket_rows)
    scored = (
        pairs.join(chunks.select(chunk_id, F.col(vector).alias("__v")), chunk_id)
        .join(questions.select(query_id, F.col(query_vector).alias("__q")), query_id)
        .select(query_id, chunk_id, cosine(F.col("__v"), F.col("__q")).alias("cosine"))
        .filter(F.col("cosine").isNotNull()))
    best = Window.partitionBy(query_id).orderBy(F.desc("cosine"), F.asc(chunk_id))
    return (
        scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .withColumn("score", score_of(F.col("cosine"))))
