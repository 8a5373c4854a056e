"""Clusters of chunk vectors around centroids, in whole numbers, with Ptolemaic bounds.

For a vector x, a centroid c and two pivots p, s, Ptolemy's inequality gives
d(x, c) * d(p, s) >= |d(x, p) * d(c, s) - d(x, s) * d(c, p)|. The distances of all vectors
to a few fixed pivots are stored with them once. Each round needs those of the centroids
only, bounds all distances from below, and computes exactly the ones that may be nearest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.session import written

CENTROIDS = 40
ROUNDS = 5
WIDTH = 64
SCALE = 256                 # a component x counts as floor(SCALE * x)
PIVOTS = 4
LARGEST = 1 << 27           # of a whole component; squared distances then fit a long
_SLACK = 1e-9               # relative; far above the rounding of the bounds
_ROWS = 4096


def _kept(chunks: DataFrame, width: int) -> DataFrame:
    """chunkId and whole components of the chunks whose vectors take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return chunks.filter((F.size("embedding") == width) & finite).select("chunkId", whole.alias("whole"))


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to a few rows, exact (int64)."""
    return np.stack([((left - r) ** 2).sum(1) for r in right], 1)


def _spread(rows: np.ndarray, n: int) -> np.ndarray:
    """``n`` different rows at most, each far from those before it."""
    chosen = [0]
    apart = _distances(rows, rows[:1])[:, 0]
    while len(chosen) < n and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, _distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def nearest(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray,
            pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances computed) of every vector.

    ``to_pivots``: distances of the vectors to the pivots. Of equally near centroids the
    smaller number wins. A centroid is left out only if its bound, lowered by more than
    rounding can add, exceeds a distance that was computed exactly.
    """
    own = np.sqrt(_distances(centroids, pivots).astype(np.float64))
    between = np.sqrt(_distances(pivots, pivots).astype(np.float64))
    low = np.zeros((len(vectors), len(centroids)))
    for p, s in combinations(range(len(pivots)), 2):
        # the rounding of both products is relative to their size, not to the difference
        one, other = np.outer(to_pivots[:, p], own[:, s]), np.outer(to_pivots[:, s], own[:, p])
        bound = np.abs(one - other) - _SLACK * (one + other)
        np.maximum(low, bound / between[p, s], out=low)
    low = low * (1 - _SLACK)
    low *= low
    rows = np.arange(len(vectors))
    first = low.argmin(1)
    best = ((vectors - centroids[first]) ** 2).sum(1)
    survivors = low <= best[:, None]
    survivors[rows, first] = False
    exact = np.full(low.shape, np.iinfo(np.int64).max)
    exact[rows, first] = best
    for c in range(len(centroids)):
        left = np.flatnonzero(survivors[:, c])
        exact[left, c] = ((vectors[left] - centroids[c]) ** 2).sum(1)
    number = exact.argmin(1)
    return number, exact[rows, number], len(rows) + int(survivors.sum())


def _read(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, _ROWS):
        piece = batch.slice(at, _ROWS)
        yield (piece.column(0), piece.column(1).flatten().to_numpy().reshape(piece.num_rows, width),
               piece.column(2).flatten().to_numpy().reshape(piece.num_rows, -1))


def clustered(chunks: DataFrame, start: Column, centroids: int = CENTROIDS, rounds: int = ROUNDS,
              width: int = WIDTH) -> DataFrame:
    """chunkId, cluster, distance, clusterInertia, inertia (long) and centroidSha256.

    ``chunks``: embedded chunks (``chunkId`` of any type, ``embedding``); other columns are
    ignored. Vectors of exactly ``width`` components, none null or not finite, take part as
    whole components floor(SCALE * x). Centroids 0, 1, ... start as the vectors whose
    ``start``, a column of chunkId, is smallest, in that order (ties: the smaller vector);
    with fewer vectors there are fewer. In each of ``rounds`` every vector goes to the
    nearest centroid (ties: the smaller number), then each centroid that has vectors
    becomes their componentwise floor(sum / count). Then vectors are assigned once more.
    distance is squared; clusterInertia and inertia are its sums over the cluster and over
    all; centroidSha256 is of the final components in decimal, joined by commas.

    Repeated and null chunkIds are rows like others. An empty table gives no rows. Whole
    components beyond LARGEST raise ValueError, as distances might not fit a long.
    """
    spark = chunks.sparkSession
    rows = _kept(chunks, width)
    opening = rows.orderBy(start, "whole").limit(centroids).collect()
    key = rows.schema["chunkId"].dataType
    out = T.StructType([
        T.StructField("chunkId", key), T.StructField("cluster", T.IntegerType()),
        T.StructField("distance", T.LongType()), T.StructField("clusterInertia", T.LongType()),
        T.StructField("inertia", T.LongType()), T.StructField("centroidSha256", T.StringType())])
    if not opening:
        return spark.createDataFrame([], out)
    middle = np.array([r["whole"] for r in opening], np.int64)
    if np.abs(middle).max() > LARGEST:
        raise ValueError(f"whole components beyond {LARGEST}")
    pivots = _spread(middle, PIVOTS)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, width)
            if whole.size and max(-int(whole.min()), int(whole.max())) > LARGEST:
                raise ValueError(f"whole components beyond {LARGEST}")
            apart = np.sqrt(_distances(whole, pivots).astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(whole.astype(np.int32)), pa.list_(pa.int32())),
                 pa.array(list(apart), pa.list_(pa.float64()))], names=["chunkId", "whole", "toPivots"])

    cached = written(rows.mapInArrow(measured, T.StructType([
        T.StructField("chunkId", key), T.StructField("whole", T.ArrayType(T.IntegerType())),
        T.StructField("toPivots", T.ArrayType(T.DoubleType()))])))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(middle.shape, np.int64), np.zeros(len(middle), np.int64)
        for batch in batches:
            for _, whole, apart in _read(batch, width):
                number, _, _ = nearest(whole.astype(np.int64), apart, middle, pivots)
                np.add.at(total, number, whole)
                count += np.bincount(number, minlength=len(middle))
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met.astype(np.int32)), pa.array(count[met]),
             pa.array(total[met].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    for _ in range(rounds):
        # one row per task and cluster; the sums of all are as many numbers as the centroids have
        found = cached.mapInArrow(sums, "cluster int, n long, total array<long>").select(
            "cluster", "n", F.posexplode("total").alias("column", "part")).groupBy(
            "cluster", "column").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
        middle = middle.copy()
        for r in found.collect():
            middle[r["cluster"], r["column"]] = int(r["total"]) // r["n"]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, whole, apart in _read(batch, width):
                number, distance, _ = nearest(whole.astype(np.int64), apart, middle, pivots)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(number.astype(np.int32)), pa.array(distance)],
                    names=out.names[:3])

    final = written(cached.mapInArrow(assigned, T.StructType(out.fields[:3])))
    inertia = {r["cluster"]: r["inertia"] for r in final.groupBy("cluster").agg(
        F.sum("distance").alias("inertia")).collect()}
    clusters = spark.createDataFrame(
        [(c, inertia.get(c, 0), sum(inertia.values()),
          hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
         for c, row in enumerate(middle.tolist())], T.StructType([out["cluster"], *out.fields[3:]]))
    return final.join(F.broadcast(clusters), "cluster").select(*out.names)
