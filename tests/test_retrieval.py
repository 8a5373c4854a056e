import hashlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomdex.functions import vectors
from loomdex.functions.vectors import cosine, hashed_embedder
from loomdex.operators import retrieval
from loomdex.operators.chunks import chunk_documents
from loomdex.operators.embedding import embed, embedded_rows, failed_rows, hashed_terms


def chunk_table(spark, matrix, parts=6):
    rows = [(f"c{i:05d}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "chunkId string, embedding array<float>").repartition(parts)


def question_table(spark, matrix):
    rows = [(f"q{i:03d}", [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, "queryId string, embedding array<float>")


def brute_force(chunks, questions, k):
    """Ranked ids per question, ties by id."""
    c, q = chunks.astype(np.float32).astype(float), questions.astype(np.float32).astype(float)
    sims = (q @ c.T) / np.sqrt((q * q).sum(1)[:, None] * (c * c).sum(1)[None, :])
    return {
        f"q{i:03d}": [f"c{j:05d}" for j in sorted(range(len(c)), key=lambda j: (-sims[i, j], j))[:k]]
        for i in range(len(q))
    }


def found_ids(frame):
    out = {}
    for r in frame.orderBy("queryId", "rank").collect():
        out.setdefault(r.queryId, []).append(r.chunkId)
    return out


def test_exact_search_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    chunks, questions = rng.standard_normal((3000, 16)), rng.standard_normal((40, 16))
    found = retrieval.nearest(chunk_table(spark, chunks), question_table(spark, questions), 7)
    assert found_ids(found) == brute_force(chunks, questions, 7)


def test_whole_numbers_with_many_copies(spark):
    """A third of all chunks are copies of one text; ties fall in id order."""
    rng = np.random.default_rng(2)
    chunks = rng.integers(0, 3, (3000, 8)).astype(float)
    chunks[:, 0] += 1
    chunks[::3] = chunks[0]
    questions = np.vstack([chunks[0], rng.integers(1, 4, (9, 8))])
    found = retrieval.nearest(chunk_table(spark, chunks), question_table(spark, questions), 5)
    expected = brute_force(chunks, questions, 5)
    assert found_ids(found)["q000"] == expected["q000"] == [f"c{3 * i:05d}" for i in range(5)]
    assert found_ids(found) == expected


def test_question_table_larger_than_one_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    chunks, questions = rng.standard_normal((500, 8)), rng.standard_normal((90, 8))
    monkeypatch.setattr(retrieval, "MAX_BLOCK_ROWS", 20)
    found = retrieval.nearest(chunk_table(spark, chunks), question_table(spark, questions), 3)
    assert found_ids(found) == brute_force(chunks, questions, 3)
    monkeypatch.setattr(retrieval, "MAX_BLOCK_ROWS", 4096)
    monkeypatch.setattr(retrieval, "MAX_BLOCK_BYTES", 1000)
    found = retrieval.nearest(chunk_table(spark, chunks), question_table(spark, questions), 3)
    assert found_ids(found) == brute_force(chunks, questions, 3)


def test_missing_and_zero_vectors_are_never_found(spark):
    chunks = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", None), ("c", []), ("d", [0.0, 0.0]), ("e", [0.0, 1.0])],
        "chunkId string, embedding array<float>",
    )
    found = retrieval.nearest(chunks, question_table(spark, np.array([[1.0, 0.1]])), 5)
    assert found_ids(found) == {"q000": ["a", "e"]}
    none = retrieval.nearest(chunks, question_table(spark, np.array([[0.0, 0.0]])), 5)
    assert none.collect() == []
    empty = retrieval.nearest(chunks, question_table(spark, np.array([[1.0, 1.0]])).limit(0), 5)
    assert empty.collect() == []


def test_payload_self_and_score(spark):
    chunks = spark.createDataFrame(
        [("a", [1.0, 0.0], "x", 1), ("b", [0.8, 0.6], None, 2)],
        "chunkId string, embedding array<float>, title string, n int",
    )
    asked = chunks.select(F.col("chunkId").alias("queryId"), "embedding")
    rows = retrieval.nearest(chunks, asked, 2, payload=["title", "n"], exclude_self=True).collect()
    assert {(r.queryId, r.chunkId, r.title, r.n, round(r.score, 6)) for r in rows} == {
        ("a", "b", None, 2, 0.9), ("b", "a", "x", 1, 0.9)
    }


@pytest.mark.parametrize("k", [0, -1, 2.5, True])
def test_k_must_be_a_positive_whole_number(spark, k):
    with pytest.raises(ValueError):
        retrieval.nearest(chunk_table(spark, np.eye(2)), question_table(spark, np.eye(2)), k)


def test_mixed_dimensions_are_an_error(spark):
    chunks = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "chunkId string, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        retrieval.nearest(chunks, question_table(spark, np.array([[1.0, 0.0]])), 1).collect()


def test_approximate_search_finds_nearly_all(spark):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((50, 32))
    chunks = centers[rng.integers(0, 50, 4000)] + 0.4 * rng.standard_normal((4000, 32))
    questions = centers[:20] + 0.4 * rng.standard_normal((20, 32))
    table = chunk_table(spark, chunks)
    found = found_ids(retrieval.nearest_approximate(table, question_table(spark, questions), 5, dimension=32))
    exact = brute_force(chunks, questions, 5)
    hits = sum(len(set(found[q]) & set(exact[q])) for q in exact)
    assert hits / (5 * len(exact)) >= 0.9
    # with every chunk as a candidate the search is exact; a stored sketch gives the same
    stored = retrieval.with_sketch(table, 32)
    full = retrieval.nearest_approximate(
        stored, question_table(spark, questions), 5, dimension=32, candidates=4000, sketch="sketch"
    )
    assert found_ids(full) == exact


def test_cosine_column(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "a array<float>, b array<float>")
    assert row.select(cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.96)


def test_native_terms_equal_the_embedder(spark):
    texts = ["The cat, the CAT; a hat", "Straße über x", "", "123 !"]
    frame = spark.createDataFrame(list(enumerate(texts)), "chunkId int, text string")
    sparse = {}
    for r in hashed_terms(frame).collect():
        sparse.setdefault(r.chunkId, {})[r.bucket] = r.n
    matrix = hashed_embedder()(texts)
    for i in range(len(texts)):
        assert sparse.get(i, {}) == {int(b): int(matrix[i, b]) for b in np.flatnonzero(matrix[i])}


def test_dead_letters_are_single_rows(spark):
    def embedder(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("model refused")
        return np.ones((len(texts), 3))

    rows = [(f"c{i}", "bad" if i == 7 else " " if i == 8 else f"text {i}") for i in range(120)]
    done = embed(spark.createDataFrame(rows, "chunkId string, text string"), embedder)
    assert {tuple(r) for r in failed_rows(done).collect()} == {
        ("c7", "model refused"), ("c8", "empty text")
    }
    assert embedded_rows(done).filter(F.size("embedding") == 3).count() == 118


def test_embedder_contract_is_checked(spark):
    frame = spark.createDataFrame([("a", "x"), ("b", "y")], "chunkId string, text string")
    short = embed(frame, lambda texts: np.ones((0, 2)))
    assert "0 vectors" in failed_rows(short).first().error
    empty = embed(frame, lambda texts: [[] for _ in texts])
    assert "empty vector" in failed_rows(empty).first().error


def test_blocks_and_separate_texts_give_the_same(spark):
    words = ["red", "green", "blue", "red green", "green blue", "red blue blue", "grey"]
    chunks = spark.createDataFrame([(f"c{i}", w) for i, w in enumerate(words)], "chunkId string, text string")
    asked = spark.createDataFrame([(f"q{i}", w) for i, w in enumerate(words)], "id string, question string")
    vectors = embedded_rows(embed(chunks, hashed_embedder()))
    whole = retrieval.retrieve(vectors, asked, hashed_embedder(), 3)
    parts = retrieval.retrieve(vectors.drop("text"), asked, hashed_embedder(), 3, texts=chunks, block_rows=2)
    assert set(whole.columns) == set(parts.columns)
    rows = [sorted(map(tuple, f.select(whole.columns).collect())) for f in (whole, parts)]
    assert rows[0] == rows[1] and len(rows[0]) == 21


def test_failed_questions_are_listed(spark):
    def refusing(texts):
        if "bad" in texts:
            raise ValueError("refused")
        return hashed_embedder()(texts)

    asked = spark.createDataFrame([("a", "bad"), ("b", "good")], "id string, question string")
    assert [tuple(r) for r in retrieval.failed_questions(asked, refusing).collect()] == [("a", "refused", None)]


def test_a_search_task_holds_slices_of_a_batch(monkeypatch):
    """Memory of a task must not grow with the rows of its Arrow batches."""
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((5000, 8)).astype(np.float32)
    batch = pa.record_batch({
        "chunkId": [f"c{i:05d}" for i in range(5000)], "embedding": pa.array(list(vectors))})
    questions = rng.standard_normal((3, 8)).astype(np.float32).astype(float)
    shared = SimpleNamespace(value=(pa.array(["q000", "q001", "q002"]), questions))
    held, whole = [], retrieval._matrix
    monkeypatch.setattr(retrieval, "_matrix", lambda c, bits: held.append(len(c)) or whole(c, bits))
    task = retrieval._search_task(shared, 4, "chunkId", "embedding", (), False, 0, "queryId")
    found = pa.Table.from_batches(list(task(iter([batch])))).to_pydict()
    assert sum(held) == 5000 and max(held) <= 1024
    expected = brute_force(vectors, questions, 4)
    for q in expected:
        assert [c for i, c in zip(found["queryId"], found["chunkId"]) if i == q] == expected[q]


def test_embedded_rows_leave_in_slices(spark):
    """Vectors are many times the size of their texts: a batch of texts is several of vectors."""
    class Frame:
        """Keeps the function that embed gives to mapInArrow."""
        schema = spark.createDataFrame([], "chunkId string, text string").schema

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    run = embed(Frame(), lambda texts: np.ones((len(texts), 1024)))
    texts = pa.record_batch({
        "chunkId": [str(i) for i in range(3000)], "text": [f"word {i}" for i in range(3000)]})
    taken = [out.num_rows for out in run(iter([texts]))]
    assert sum(taken) == 3000 and max(taken) <= 1000


def test_documents_searched_in_one_step_give_the_same(spark):
    texts = ["red green blue\nred red", "green " * 80, "blue grey\n" * 40, " \n", None, "red green blue\nred red"]
    docs = spark.createDataFrame(
        [(f"doc-{i}", "t", "s", f"u{i}", "c", t) for i, t in enumerate(texts)],
        "documentId string, title string, source string, sourceUrl string, category string, text string")
    asked = spark.createDataFrame(
        [("a", "red blue"), ("b", "grey"), ("c", " "), ("d", "123")], "id string, question string")
    pieces = chunk_documents(docs, 120, 20)
    stored = retrieval.retrieve(
        embedded_rows(embed(pieces.select("chunkId", "text"), hashed_embedder())), asked,
        hashed_embedder(), 4, texts=pieces)
    direct = retrieval.retrieve_from_documents(docs, asked, hashed_embedder(), 4, size=120, overlap=20)
    assert set(direct.columns) == set(stored.columns)
    rows = [sorted(map(tuple, f.select(sorted(stored.columns)).collect())) for f in (stored, direct)]
    assert rows[0] == rows[1] and len(rows[0]) == 8


def test_texts_that_cannot_be_embedded_are_not_found(spark):
    def embedder(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("model refused")
        return np.array([[float(len(t)), 1.0] for t in texts])

    chunks = spark.createDataFrame(
        [("c0", "one"), ("c1", "bad"), ("c2", " "), ("c3", None), ("c4", "three")], "chunkId string, text string")
    found = retrieval.nearest(
        chunks, question_table(spark, np.array([[1.0, 0.0]])), 5, vector="text", embedder=embedder)
    assert found_ids(found) == {"q000": ["c4", "c0"]}


def test_embedder_remembers_a_bounded_number_of_terms():
    known = vectors._Buckets(1024)
    found = [known[f"term{i}"] for i in range(150_000)]
    assert len(known) <= vectors.KNOWN_TERMS
    assert found == [int(hashlib.md5(f"term{i}".encode()).hexdigest()[:7], 16) % 1024 for i in range(150_000)]
    assert known["again"] is known["again"]
