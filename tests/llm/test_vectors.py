"""Hard negatives and centroid clusters against brute force in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import centroid_clusters, hard_negatives
from loomdex.llm.residue_products import LARGEST, primes_for, products, residues

CHUNKS = "chunkId long, documentId int, embedding array<float>, anchor string, cell string, cluster string"


def whole(vector, scale=256):
    return [math.floor(scale * float(np.float32(x))) for x in vector]


@pytest.mark.parametrize("size, width", [(3, 1), (500, 64), (40_000, 130), (1 << 27, 64)])
def test_products_are_exact(size, width):
    rng = np.random.default_rng(size)
    a, b = (rng.integers(-size, size + 1, (n, width)).astype(np.float64) for n in (7, 9))
    a[0], b[0], b[1] = size, size, -size
    primes = primes_for(width * size * size)
    exact = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert products(residues(a, primes), residues(b, primes), primes).tolist() == exact
    with pytest.raises(ValueError):
        primes_for(LARGEST + 1)


def brute_negatives(rows, is_anchor):
    kept = [(i, d, whole(v)) for i, d, v in rows
            if d is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = lambda i: (i is not None, i or 0)
    out = []
    for anchor, document, vector in kept:
        if anchor is None or not is_anchor(anchor):
            continue
        scored = sorted(((-sum(x * y for x, y in zip(vector, v)), first(i), i, d) for i, d, v in kept),
                        key=lambda s: s[:2])
        for score, _, positive, _ in [s for s in scored if s[3] == document and s[2] != anchor][:5]:
            fitting = [s for s in scored if s[3] != document and 30 * -score <= 100 * -s[0] <= 90 * -score]
            out += [(anchor, positive, k, s[2], -score, -s[0]) for k, s in enumerate(fitting[:10], 1)]
    return sorted(out)


def vector_rows(n, width, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(4), [rng.gauss(0.2, 0.4) for _ in range(width)]) for i in range(n)]
    rows += [(1000 + i, i % 4, rows[0][2]) for i in range(40)]         # one very common vector
    rows += [(2000, None, rows[0][2]), (2010, 1, None), (2020, 1, [float("nan")] * width),
             (2030, 1, [float("inf")] + [0.0] * (width - 1)), (2040, 1, [None] * width),
             (2050, 1, [0.5] * (width - 1)), (2060, 2, []), (2070, 0, [0.0] * width), (None, 1, rows[3][2])]
    return rows


@pytest.mark.parametrize("shape", [(), ("BLOCK_ANCHORS", 3), ("_ROWS", 5)])
def test_hard_negatives(spark, monkeypatch, shape):
    if shape:
        monkeypatch.setattr(hard_negatives, *shape)
    rows = vector_rows(150, 8, 1)
    rows += rows[7:9] * 2                                              # repeated rows, no anchors
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], CHUNKS).repartition(5)
    found = hard_negatives.mined(frame, F.col("chunkId") % 10 == 0)
    assert sorted(map(tuple, found.collect())) == brute_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_of_repeated_anchors_and_names(spark):
    rows = vector_rows(30, 3, 2)
    rows += [rows[10], rows[20]]
    brute = brute_negatives(rows, lambda i: i % 10 == 0)
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], CHUNKS)
    assert sorted(map(tuple, hard_negatives.mined(frame, F.col("chunkId") % 10 == 0).collect())) == brute
    named = frame.select(F.format_string("k%04d", "chunkId").alias("chunkId"),
                         F.col("documentId").cast("string"), "embedding").filter("chunkId < 'k5'")
    found = hard_negatives.mined(named, F.col("chunkId").endswith("0")).collect()
    assert sorted((int(r[0][1:]), int(r[1][1:])) for r in found) == sorted(
        b[:2] for b in brute_negatives([r for r in rows if r[0] is not None], lambda i: i % 10 == 0))


def test_hard_negatives_of_nothing_and_of_too_much(spark):
    empty = spark.createDataFrame([], CHUNKS)
    assert hard_negatives.mined(empty, F.col("chunkId") % 2 == 0).collect() == []
    wide = spark.createDataFrame([(0, 1, [1e12], "", "", "")], CHUNKS)
    with pytest.raises(ValueError):
        hard_negatives.mined(wide, F.col("chunkId") % 2 == 0)


def brute_clusters(rows, k, rounds, width):
    kept = [(i, whole(v)) for i, v in rows if v is not None and len(v) == width
            and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    middle = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle)) for _, v in kept]

    for _ in range(rounds):
        near = assign()
        for n in range(len(middle)):
            own = [v for (_, v), (_, m) in zip(kept, near) if m == n]
            if own:
                middle[n] = [sum(c) // len(own) for c in zip(*own)]
    near = assign()
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted((i, n, d, sum(e for e, m in near if m == n), sum(e for e, _ in near), names[n])
                  for (i, _), (d, n) in zip(kept, near))


@pytest.mark.parametrize("n, k", [(200, 12), (6, 40), (1, 3)])
def test_centroid_clusters(spark, n, k):
    rows = [(i, v) for i, _, v in vector_rows(n, 8, 3) if i is not None] + [(5, [0.25] * 8), (5, [0.25] * 8)]
    if n == 1:
        rows = [(i, [0.25] * 8) for i in range(5)]
    frame = spark.createDataFrame([(i, 1, v, "a", "b", "c") for i, v in rows], CHUNKS).repartition(4)
    start = F.sha2(F.concat(F.lit("2:"), F.col("chunkId").cast("string")).cast("binary"), 256)
    found = centroid_clusters.clustered(frame, start, centroids=k, width=8)
    assert sorted(map(tuple, found.collect())) == brute_clusters(rows, k, 5, 8)


def test_clusters_of_nothing_and_of_too_much(spark):
    start = F.col("chunkId").cast("string")
    empty = spark.createDataFrame([(1, 1, [0.5], "", "", ""), (2, 1, None, "", "", "")], CHUNKS)
    assert centroid_clusters.clustered(empty, start).collect() == []
    wide = spark.createDataFrame([(0, 1, [1e9], "", "", "")], CHUNKS)
    with pytest.raises(ValueError):
        centroid_clusters.clustered(wide, start, width=1)


def test_bounds_leave_out_and_never_lose():
    rng = np.random.default_rng(4)
    centres = rng.integers(-300, 300, (10, 64))
    vectors = (centres[rng.integers(0, 10, 3000)] + rng.integers(-9, 10, (3000, 64))).astype(np.int64)
    pivots = centroid_clusters._spread(centres, 4)
    apart = np.sqrt(centroid_clusters._distances(vectors, pivots).astype(float))
    number, distance, computed = centroid_clusters.nearest(vectors, apart, centres, pivots)
    every = centroid_clusters._distances(vectors, centres)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert computed < 0.5 * every.size
