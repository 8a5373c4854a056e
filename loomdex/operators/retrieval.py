"""Nearest-chunk search for whole question tables.

The question side is a small matrix: blocks of at most ``block_rows`` questions
are shipped to the tasks, and a larger question table is searched in several
passes over the chunks. Each task scores its chunks with one matrix product per
Arrow batch and emits its own best K per question, so the shuffle carries at
most K rows per question and task and never a (question, chunk) pair table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex import fixed_values as fv
from loomdex.functions.text import is_blank
from loomdex.functions.vectors import Embedder, cosine, score_of, sign_sketcher
from loomdex.operators.chunks import chunk_documents
from loomdex.operators.embedding import embed, embedded_texts
from loomdex.session import checkpointed, written

MAX_BLOCK_ROWS = 4096     # questions per pass
MAX_BLOCK_BYTES = 64 << 20  # and at most this much of question matrix
MAX_BROADCAST_ROWS = 1_000_000  # rows of question id, chunk id, cosine
_SLICE_ROWS = 1024        # rows per matrix product inside a task
_MERGE_GROUPS = 64        # first-level groups when merging the task results


def valid_questions(questions: DataFrame, text: str = "question") -> DataFrame:
    return questions.filter(~is_blank(F.col(text)))


def rejected_questions(questions: DataFrame, text: str = "question") -> DataFrame:
    return questions.filter(is_blank(F.col(text)))


def _check_k(k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError(f"k must be a positive integer, got {k!r}")


def _matrix(column: pa.Array, sketch_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float64 matrix) of the non-empty vectors of a batch."""
    if sketch_bits:
        keep = np.flatnonzero(np.asarray(column.is_valid()))
        packed = np.frombuffer(b"".join(column.take(pa.array(keep)).to_pylist()), dtype=np.uint8)
        bits = np.unpackbits(packed.reshape(len(keep), -1), axis=1)[:, :sketch_bits]
        return keep, bits.astype(np.float64) * 2.0 - 1.0
    sizes = np.asarray(column.value_lengths().fill_null(0))
    keep = np.flatnonzero(sizes > 0)
    if len(keep) == 0:
        return keep, np.empty((0, 0))
    dims = np.unique(sizes[keep])
    if len(dims) > 1:
        raise ValueError(f"vectors of different dimensions: {dims.tolist()}")
    if len(keep) < len(column):
        column = column.take(pa.array(keep))
    values = column.flatten().to_numpy(zero_copy_only=False)
    return keep, values.astype(np.float64).reshape(len(keep), int(dims[0]))


def _embedded_matrix(column: pa.Array, embedder: Embedder) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float64 matrix) of the texts that could be embedded."""
    vectors, _ = embedded_texts(column.to_pylist(), embedder)
    keep = np.array([i for i, v in enumerate(vectors) if v is not None], dtype=np.int64)
    if len(keep) == 0:
        return keep, np.empty((0, 0))
    dims = sorted({len(vectors[i]) for i in keep})
    if len(dims) > 1:
        raise ValueError(f"vectors of different dimensions: {dims}")
    matrix = np.empty((len(keep), dims[0]))
    for row, i in enumerate(keep):
        matrix[row] = vectors[i]
    return keep, matrix


def _search_task(shared, k: int, chunk_id: str, vector: str, payload: Sequence[str],
                 exclude_self: bool, sketch_bits: int, query_id: str,
                 embedder: Embedder | None = None):
    """mapInArrow function: the best k chunks of this task for every question.

    With an ``embedder`` the column ``vector`` holds texts. Only a slice of a batch is a
    matrix at a time, so the memory of a task does not depend on the size of its batches.
    """
    def slices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        column = batch.column(vector)
        for begin in range(0, len(column), _SLICE_ROWS):
            held = column.slice(begin, _SLICE_ROWS)
            rows, matrix = (
                _embedded_matrix(held, embedder) if embedder else _matrix(held, sketch_bits))
            if len(rows):
                yield rows + begin, matrix

    def prune(table: pa.Table) -> pa.Table:
        """Best k rows per question, score descending, then chunk id."""
        question = table["__q"].to_numpy()
        value = table["cosine"].to_numpy()
        ids = np.asarray(table[chunk_id].to_pylist())
        order = np.lexsort((ids, -value, question))
        question = question[order]
        first = np.r_[True, question[1:] != question[:-1]]
        starts = np.flatnonzero(first)
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
        return table.take(pa.array(order[place < k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, questions = shared.value
        question_ids = np.asarray(names.to_pylist())
        question_norms = np.einsum("ij,ij->i", questions, questions)
        transposed = questions.T
        best: pa.Table | None = None
        # the k-th best cosine and its chunk id, for questions that have k chunks
        floor = np.full(len(questions), -np.inf)
        floor_id = np.full(len(questions), None, dtype=object)
        for batch in batches:
            for part_rows, part in slices(batch):
                if part.shape[1] != questions.shape[1]:
                    raise ValueError(
                        f"chunk vectors have {part.shape[1]} dimensions, "
                        f"questions have {questions.shape[1]}"
                    )
                ids = np.asarray(batch.column(chunk_id).take(pa.array(part_rows)).to_pylist())
                by_id = np.argsort(ids, kind="stable")  # ties then fall in id order
                part, part_rows, ids = part[by_id], part_rows[by_id], ids[by_id]
                scale = np.sqrt(
                    np.einsum("ij,ij->i", part, part)[:, None] * question_norms[None, :]
                )
                values = np.full(scale.shape, -np.inf)
                np.divide(part @ transposed, scale, out=values, where=scale > 0)
                if exclude_self:
                    values[ids[:, None] == question_ids[None, :]] = -np.inf
                top = values.max(axis=0)
                picked_rows, picked_questions = [], []
                for q in np.flatnonzero((top >= floor) & (top > -np.inf)):
                    column = values[:, q]
                    better = column > floor[q]
                    if floor_id[q] is not None:  # of many equal copies only smaller ids count
                        better |= (column == floor[q]) & (ids < floor_id[q])
                    near = np.flatnonzero(better)
                    near = near[np.argsort(-column[near], kind="stable")[:k]]
                    picked_rows.append(near)
                    picked_questions.append(np.full(len(near), q, dtype=np.int64))
                at = np.concatenate(picked_rows) if picked_rows else np.empty(0, dtype=np.int64)
                if len(at) == 0:
                    continue
                asked = np.concatenate(picked_questions)
                found = pa.Table.from_batches([batch.select([chunk_id, *payload])]).take(
                    pa.array(part_rows[at])
                )
                found = found.append_column("__q", pa.array(asked))
                found = found.append_column("cosine", pa.array(values[at, asked]))
                best = prune(found if best is None else pa.concat_tables([best, found]))
                asked = best["__q"].to_numpy()
                full = np.flatnonzero(np.bincount(asked, minlength=len(questions)) >= k)
                last = np.searchsorted(asked, full, side="right") - 1
                floor[full] = best["cosine"].to_numpy()[last]
                floor_id[full] = best[chunk_id].take(pa.array(last)).to_pylist()
        if best is None:
            return
        columns = [names.take(best["__q"].combine_chunks())]
        columns += [best[c].combine_chunks() for c in [chunk_id, *payload, "cosine"]]
        table = pa.Table.from_arrays(columns, names=[query_id, chunk_id, *payload, "cosine"])
        yield from table.to_batches(max_chunksize=10_000)

    return run


def _question_blocks(questions: DataFrame, vector: str, sketch_bits: int, block_rows: int):
    """(ids, matrix) blocks of about ``block_rows`` at most; one job when one is enough."""
    query_id = questions.columns[0]

    def block_of(table: pa.Table, rows: np.ndarray, matrix: np.ndarray):
        return table[query_id].combine_chunks().take(pa.array(rows)), matrix

    first = questions.limit(block_rows + 1).toArrow()
    if first.num_rows == 0:
        return
    width = 0
    if first.num_rows <= block_rows:
        rows, matrix = _matrix(first[vector].combine_chunks(), sketch_bits)
        width = matrix.shape[1] if len(rows) else 0
        if first.num_rows * width * 8 <= MAX_BLOCK_BYTES:
            if len(rows):
                yield block_of(first, rows, matrix)
            return
    if not width:
        _, sample = _matrix(first.slice(0, 64)[vector].combine_chunks(), sketch_bits)
        width = max(1, sample.shape[1])
    size = max(1, min(block_rows, MAX_BLOCK_BYTES // (width * 8)) // 2)
    questions = checkpointed(questions)  # every block reads it again
    blocks = -(-questions.count() // size)
    for block in range(blocks):
        chosen = questions.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == block).toArrow()
        if chosen.num_rows == 0:
            continue
        rows, matrix = _matrix(chosen[vector].combine_chunks(), sketch_bits)
        if len(rows):
            yield block_of(chosen, rows, matrix)


def top_k(ranked: DataFrame, query_id: str, order: Sequence[Column], k: int) -> DataFrame:
    """Best k rows per question, in two levels so that no single task sees
    the results of all tasks for a question."""
    slot = F.pmod(F.spark_partition_id(), F.lit(_MERGE_GROUPS))
    level1 = Window.partitionBy(query_id, "__slot").orderBy(*order)
    level2 = Window.partitionBy(query_id).orderBy(*order)
    return (
        ranked.withColumn("__slot", slot)
        .withColumn("__r", F.row_number().over(level1)).filter(F.col("__r") <= k)
        .withColumn("rank", F.row_number().over(level2)).filter(F.col("rank") <= k)
        .drop("__slot", "__r")
    )


def nearest(chunks: DataFrame, questions: DataFrame, k: int = fv.TOP_K, *,
            chunk_id: str = "chunkId", vector: str = "embedding",
            query_id: str = "queryId", query_vector: str = "embedding",
            payload: Sequence[str] = (), texts: DataFrame | None = None,
            exclude_self: bool = False, sketch_bits: int = 0,
            block_rows: int = MAX_BLOCK_ROWS, carried: Sequence[str] = (),
            embedder: Embedder | None = None) -> DataFrame:
    """The exact k nearest chunks of every question by cosine.

    Returns query id, chunk id, payload columns, ``cosine``, ``score``, ``rank``.
    Equal cosines are ordered by chunk id. The search carries ids and cosines only;
    ``payload`` columns are joined to the final k rows, from ``texts`` (unique chunk ids;
    by default ``chunks``, which is then read twice). Questions are searched in blocks of
    at most ``block_rows``, and each block reads ``chunks``: pass a stored table.
    ``carried`` columns are short ones of ``chunks`` that the search takes along instead.
    With an ``embedder`` the column ``vector`` holds texts, which are embedded where they are
    searched: no vector leaves the task. Texts that cannot be embedded are never found.
    """
    _check_k(k)
    spark = chunks.sparkSession
    payload, carried = list(payload), list(carried)
    side = chunks.select(chunk_id, *carried, vector)
    asked = questions.select(F.col(query_id), F.col(query_vector).alias("__vector"))
    out = T.StructType(
        [T.StructField(query_id, questions.schema[query_id].dataType)]
        + [side.schema[c] for c in (chunk_id, *carried)]
        + [T.StructField("cosine", T.DoubleType())]
    )
    order = [F.desc("cosine"), F.asc(chunk_id)]
    passes = []
    for block in _question_blocks(asked, "__vector", sketch_bits, block_rows):
        shared = spark.sparkContext.broadcast(block)
        task = _search_task(
            shared, k, chunk_id, vector, carried, exclude_self, sketch_bits, query_id, embedder
        )
        passes.append(top_k(side.mapInArrow(task, out), query_id, order, k))
    if not passes:
        passes.append(top_k(spark.createDataFrame([], out), query_id, order, k))
    if payload:
        rest = (chunks if texts is None else texts).select(chunk_id, *payload)
        # the result of a block has k rows per question at most, so the texts stay in place
        small = block_rows * k <= MAX_BROADCAST_ROWS
        passes = [rest.join(F.broadcast(p) if small else p, chunk_id) for p in passes]
    found = reduce(DataFrame.unionByName, passes)
    return found.select(
        query_id, chunk_id, *carried, *payload, "cosine", "rank", score_of(F.col("cosine")).alias("score"))


def with_sketch(vectors: DataFrame, dimension: int, *, vector: str = "embedding",
                bits: int = 256, seed: int = 7, out: str = "sketch") -> DataFrame:
    """Add a packed sign sketch of each vector. Store it next to the vector table:
    the candidate scan then reads ``bits / 8`` bytes per chunk and no vectors."""
    sketch = sign_sketcher(dimension, bits, seed)
    schema = T.StructType(vectors.schema.fields + [T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, matrix = _matrix(batch.column(vector), 0)
            packed: list[bytes | None] = [None] * batch.num_rows
            if len(rows):
                for row, code in zip(rows, sketch(matrix)):
                    packed[row] = code.tobytes()
            columns = [*batch.columns, pa.array(packed, type=pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, out])

    return vectors.mapInArrow(run, schema)


def nearest_approximate(chunks: DataFrame, questions: DataFrame, k: int = fv.TOP_K, *,
                        dimension: int, candidates: int | None = None,
                        chunk_id: str = "chunkId", vector: str = "embedding",
                        query_id: str = "queryId", query_vector: str = "embedding",
                        bits: int = 256, seed: int = 7, exclude_self: bool = False,
                        sketch: str | None = None) -> DataFrame:
    """Approximate search: ``candidates`` (10 k by default) per question by sketch
    similarity, exact cosine on those, best k.

    ``sketch`` names a sketch column already stored in ``chunks``.
    """
    _check_k(k)
    candidates = candidates or fv.CANDIDATE_FACTOR * k
    if candidates < k:
        raise ValueError("candidates must not be fewer than k")
    if sketch is None:
        sketch = "__sketch"
        sketched = with_sketch(chunks.select(chunk_id, vector), dimension, vector=vector,
                               bits=bits, seed=seed, out=sketch)
    else:
        sketched = chunks
    asked = with_sketch(questions.select(query_id, F.col(query_vector).alias("__qv")), dimension,
                        vector="__qv", bits=bits, seed=seed, out="__qs")
    near = nearest(
        sketched.select(chunk_id, sketch), asked, candidates, chunk_id=chunk_id, vector=sketch,
        query_id=query_id, query_vector="__qs", exclude_self=exclude_self, sketch_bits=bits,
    ).select(query_id, chunk_id)
    asked_vectors = asked.select(query_id, "__qv")
    n_questions = questions.count()
    # Both sides have a known size. While it is small they go to the vectors, which
    # then are not shuffled; otherwise Spark shuffles.
    if n_questions * candidates <= MAX_BROADCAST_ROWS:
        near = F.broadcast(near)
    if n_questions * dimension * 8 <= MAX_BLOCK_BYTES:
        asked_vectors = F.broadcast(asked_vectors)
    scored = (
        chunks.select(chunk_id, vector).join(near, chunk_id).join(asked_vectors, query_id)
        .select(query_id, chunk_id, cosine(F.col(vector), F.col("__qv")).alias("cosine"))
    )
    best = Window.partitionBy(query_id).orderBy(F.desc("cosine"), F.asc(chunk_id))
    return (
        scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .withColumn("score", score_of(F.col("cosine")))
    )


PUBLIC_CHUNK_FIELDS = (
    "documentId", "title", "source", "sourceUrl", "category", "chunkIndex", "text",
)


def _embedded_questions(questions: DataFrame, embedder: Embedder, query_id: str,
                        text: str) -> DataFrame:
    return embed(
        valid_questions(questions, text).select(F.col(query_id).alias("queryId"),
                                                F.col(text).alias("__text")),
        embedder, id_col="queryId", text="__text",
    )


def failed_questions(questions: DataFrame, embedder: Embedder, *, query_id: str = "id",
                     text: str = "question") -> DataFrame:
    """id, message and elapsedMs (unknown) of the questions that could not be embedded.

    The shape of the ``failures`` of :func:`~loomdex.operators.runs.evaluation_results`, so
    that such a question becomes an error and not one whose context is insufficient.
    """
    failed = _embedded_questions(questions, embedder, query_id, text).filter(
        F.col("error").isNotNull())
    return failed.select(
        F.col("queryId").alias("id"), F.col("error").alias("message"),
        F.lit(None).cast("long").alias("elapsedMs"))


def retrieve(embedded_chunks: DataFrame, questions: DataFrame, embedder: Embedder,
             k: int = fv.TOP_K, *, query_id: str = "id", text: str = "question",
             texts: DataFrame | None = None, block_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """Embed the whole question table and find the k nearest chunks of each question.

    ``embedder`` is the one for questions; a model with separate modes for
    documents and questions is given in its question mode here. Chunk metadata
    and text come along (from ``texts`` if given, see :func:`nearest`), the vector does not. A question that could not be embedded has no
    rows here; :func:`failed_questions` lists those, as failures of the run.
    """
    asked = _embedded_questions(questions, embedder, query_id, text).filter(F.col("error").isNull())
    payload = [c for c in PUBLIC_CHUNK_FIELDS if c in (embedded_chunks if texts is None else texts).columns]
    return nearest(embedded_chunks, asked, k, payload=payload, texts=texts, block_rows=block_rows)


def retrieve_from_documents(documents: DataFrame, questions: DataFrame, embedder: Embedder,
                            k: int = fv.TOP_K, *, size: int = fv.CHUNK_SIZE,
                            overlap: int = fv.CHUNK_OVERLAP, query_id: str = "id",
                            text: str = "question", block_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """:func:`retrieve` where neither chunks nor vectors are stored.

    Chunks are embedded in the tasks that search them. What was found, k rows per question, is
    written to the shared folder; only its documents are chunked again, for the texts.
    """
    asked = _embedded_questions(questions, embedder, query_id, text).filter(F.col("error").isNull())
    pieces = chunk_documents(documents, size, overlap)
    found = written(nearest(pieces, asked, k, vector="text", carried=["documentId"],
                            block_rows=block_rows, embedder=embedder))
    hit = documents.join(found.select("documentId").distinct(), "documentId", "left_semi")
    texts = chunk_documents(hit, size, overlap).select("chunkId", *PUBLIC_CHUNK_FIELDS)
    return found.drop("documentId").join(texts, "chunkId").select(
        "queryId", "chunkId", *PUBLIC_CHUNK_FIELDS, "cosine", "rank", "score")


def searched(embedded_chunks: DataFrame, questions: DataFrame, embedder: Embedder,
             k: int = fv.TOP_K, *, query_id: str = "id", text: str = "question",
             texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of :func:`retrieve`, rows of :func:`failed_questions`), embedding questions once.

    The vectors of the questions are written to the shared folder.
    """
    asked = written(_embedded_questions(questions, embedder, query_id, text))
    failed = asked.filter(F.col("error").isNotNull()).select(
        F.col("queryId").alias("id"), F.col("error").alias("message"),
        F.lit(None).cast("long").alias("elapsedMs"))
    payload = [c for c in PUBLIC_CHUNK_FIELDS if c in (embedded_chunks if texts is None else texts).columns]
    found = nearest(embedded_chunks, asked.filter(F.col("error").isNull()), k, payload=payload, texts=texts)
    return found, failed
