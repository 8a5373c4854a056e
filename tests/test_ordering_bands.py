"""Numbers in a total order, and the search by band keys against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.operators import bands
from loomdex.operators.embedding import batch_members
from loomdex.operators.ordering import first_in_order, numbered


def test_numbers_of_ties_nulls_and_one_common_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "hot", "hot", "z"]), rng.randrange(4), i) for i in range(3000)]
    rows += [rows[0]] * 50
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "k string, n int, number__ int")
    found = sorted((tuple(r) for r in numbered(frame, ["k", "n"]).collect()), key=lambda r: r[3])
    assert [r[3] for r in found] == list(range(len(rows)))
    key = lambda r: (r[0] is not None, r[0] or "", r[1])
    assert [key(r) for r in found] == sorted(map(key, rows))
    assert sorted(r[:3] for r in map(tuple, found) if r[0]) == sorted(r for r in rows if r[0])
    for n in (1, 500, 10_000):
        first = first_in_order(frame, ["k", "n"], n)
        assert sorted(map(key, first.collect())) == sorted(map(key, rows))[:n]
    # many rows stay in several tasks
    assert first_in_order(frame, ["k", "n"], 2500).select(F.spark_partition_id()).distinct().count() > 1
    assert numbered(frame.limit(0), ["k"]).count() == 0 == first_in_order(frame.limit(0), ["k"], 5).count()


def test_batches_hold_their_chunks(spark):
    ids = [f"c{i:03}" for i in range(123)]
    chunks = spark.createDataFrame([(c, "d", i) for i, c in enumerate(ids)],
                                   "chunkId string, documentId string, chunkIndex int").repartition(4)
    found = sorted(map(tuple, batch_members(chunks, 50).collect()))
    assert found == [(b + 1, 3, 50 * b + 1, min(50 * b + 50, 123), ids[50 * b:50 * b + 50]) for b in range(3)]
    assert batch_members(chunks.limit(0)).collect() == []


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 32))
    made = centres[rng.integers(0, 60, 3000)] + 0.4 * rng.standard_normal((3000, 32))
    made[5:400] = made[5]                       # one very common vector
    rows = [(f"c{i:04}", v) for i, v in enumerate(made.tolist())] + [("none", None), ("part", [None] * 32)]
    asked = [(i, (c + 0.4 * rng.standard_normal(32)).tolist()) for i, c in enumerate(centres[:20])]
    chunks = bands.with_band_keys(
        spark.createDataFrame(rows, "chunkId string, embedding array<double>"), 32).cache()
    questions = bands.with_band_keys(
        spark.createDataFrame(asked, "queryId int, embedding array<double>"), 32).cache()
    return made, np.array([v for _, v in asked]), chunks, questions


def test_band_search_prunes_and_finds(vectors):
    made, asked, chunks, questions = vectors
    pairs = bands.meeting_pairs(chunks, questions)
    n = pairs.count()
    assert n == pairs.distinct().count() and n < 0.5 * len(made) * len(asked)
    cosines = asked @ made.T / np.linalg.norm(asked, axis=1)[:, None] / np.linalg.norm(made, axis=1)
    found = {}
    for r in bands.nearest_in_bands(chunks, questions, 5).collect():
        place = int(r.chunkId[1:])
        assert r.cosine == pytest.approx(cosines[r.queryId, place]) and r.score == pytest.approx((1 + r.cosine) / 2)
        found.setdefault(r.queryId, []).append((r.rank, place))
    assert all([rank for rank, _ in sorted(f)] == [1, 2, 3, 4, 5] for f in found.values())
    best = np.argsort(-cosines, 1, kind="stable")[:, :5]
    hits = sum(len({p for _, p in found[q]} & set(best[q].tolist())) for q in range(20))
    assert hits >= 0.9 * best.size


def test_split_buckets_give_the_same_pairs(vectors):
    _, _, chunks, questions = vectors
    whole = sorted(map(tuple, bands.meeting_pairs(chunks, questions).collect()))
    assert sorted(map(tuple, bands.meeting_pairs(chunks, questions, bucket_rows=7).collect())) == whole


def test_band_edges(spark, vectors):
    _, _, chunks, questions = vectors
    assert bands.nearest_in_bands(chunks.limit(0), questions).count() == 0
    assert bands.nearest_in_bands(chunks, questions.limit(0)).count() == 0
    for k in (0, True, 1.5):
        with pytest.raises(ValueError):
            bands.nearest_in_bands(chunks, questions, k)
    with pytest.raises(Exception, match="other than 9 dimensions"):
        bands.with_band_keys(chunks.drop("bandKeys"), 9).collect()
