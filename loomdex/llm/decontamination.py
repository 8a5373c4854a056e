"""Documents that contain evaluation questions, verbatim or nearly.

Every window of a document that is as long as a question is fingerprinted with a
weighted SimHash of its five-word shingles. A fingerprint within the Hamming radius of a
question's has, by the pigeonhole principle, at least one of its blocks within the
radius per block; windows without such a block are dropped, then those outside the
radius, and what remains is verified by the exact weighted similarity of the shingles.
Windows that share no shingle with a question have similarity zero and are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.word_arrays import SHINGLE_WORDS, Words, slices, worker_cached
from loomdex.session import checkpointed

MIN_SIMILARITY = 0.75
RADIUS = 20                 # of 64 bits; similarity 0.75 lies 11 bits apart on average
BLOCKS = 4
BLOCK_BYTES = 16 << 20      # of question text that is broadcast at once; more take turns
_REMEMBERED = 100_000       # verified windows a task remembers
_BITS = np.arange(64, dtype=np.uint64)


def _signs(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    bits = (shingles[:, None] >> _BITS) & np.uint64(1)
    return np.where(bits == 1, weights[:, None], -weights[:, None])


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(1, dtype=np.uint64)


def _near(windows: np.ndarray, item: int) -> np.ndarray:
    """Which fingerprints lie within RADIUS of the item's; blocks are looked at first."""
    apart = windows ^ np.uint64(item)
    width = 64 // BLOCKS
    mask = np.uint64((1 << width) - 1)
    each = [np.bitwise_count((apart >> np.uint64(i * width)) & mask) for i in range(BLOCKS)]
    some = np.min(each, axis=0) <= RADIUS // BLOCKS
    return some & (np.sum(each, axis=0) <= RADIUS)


def _shingle_set(words: Words, row: int, windows: dict[int, np.ndarray]) -> np.ndarray:
    """Distinct shingles of a question; fewer than five words are one of their length."""
    g = min(SHINGLE_WORDS, int(words.counts[row]))
    return np.unique(words.row_windows(row, windows[g], g)) if g else np.zeros(0, np.uint64)


class QuestionIndex:
    """Shingles, weights and fingerprints of a block of questions.

    ``total`` is the number of all questions and ``shared`` how many of them hold a shingle,
    for those that more than one holds: weights do not depend on how questions are dealt out.
    """

    def __init__(self, ids: list, texts: list[str | None], total: int, shared: dict[int, int]) -> None:
        words = Words(texts, letters=True)
        self.ids, self.sizes = ids, words.counts
        #: Questions of fewer than five words are one shingle of their own length.
        self.grams = sorted({int(min(SHINGLE_WORDS, n)) for n in words.counts if n})
        windows = {g: words.windows(g) for g in self.grams}
        sets, self.owners = [], {}
        for i, n in enumerate(words.counts):
            own = _shingle_set(words, i, windows)
            sets.append(own)
            for shingle in own.tolist():
                self.owners.setdefault(shingle, []).append(i)
        #: Shingles of many questions weigh less; unknown ones weigh as one question's.
        self.top = float(np.log1p(total))
        self.weights = {s: float(np.log1p(total / shared.get(s, 1))) for s in self.owners}
        self.known = np.sort(np.array(list(self.owners), np.uint64))
        self.sets = [dict.fromkeys(s.tolist()) for s in sets]
        self.totals = [sum(self.weights[x] for x in s) for s in self.sets]
        self.prints = []
        for i, n in enumerate(words.counts):
            g = min(SHINGLE_WORDS, int(n))
            every = words.row_windows(i, windows[g], g) if g else np.zeros(0, np.uint64)
            sums = _signs(every, self._weigh(every)).sum(0, keepdims=True)
            self.prints.append(int(_fingerprints(sums)[0]))
        self.verified: dict[tuple[int, int], float] = {}

    def _weigh(self, shingles: np.ndarray) -> np.ndarray:
        get, top = self.weights.get, self.top
        return np.array([get(s, top) for s in shingles.tolist()])

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        """Shared weight over the weight of all distinct shingles of window and question."""
        own, get, top = self.sets[item], self.weights.get, self.top
        window = set(shingles.tolist())
        shared = sum(get(s, top) for s in window if s in own)
        return shared / (sum(get(s, top) for s in window) + self.totals[item] - shared)

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, int]]:
        """(text, question, similarity, first word) of the best window of each match."""
        if not len(self.known):
            return
        words = Words(texts, letters=True)
        for gram in self.grams:
            windows = words.windows(gram)
            at = np.minimum(np.searchsorted(self.known, windows), len(self.known) - 1)
            hits = np.flatnonzero(self.known[at] == windows)
            rows = np.searchsorted(words.first, hits, "right") - 1
            inside = hits + gram <= words.first[rows + 1]
            for row in np.unique(rows[inside]):
                yield from self._row(words, windows, gram, int(row), hits[inside & (rows == row)])

    def _row(self, words, windows, gram, row, hits):
        where: dict[int, list[int]] = {}
        for place in hits.tolist():
            for item in self.owners[int(windows[place])]:
                if min(SHINGLE_WORDS, int(self.sizes[item])) == gram:
                    where.setdefault(item, []).append(place)
        first, end = int(words.first[row]), int(words.first[row + 1])
        for item, places in where.items():
            # A text shorter than the question is one window; it may still be similar.
            size = min(int(self.sizes[item]), end - first)
            span = size - gram + 1
            starts = np.unique(np.concatenate(
                [np.arange(max(first, p - span + 1), min(p, end - size) + 1) for p in places]))
            if not len(starts):
                continue
            low, high = int(starts[0]), int(starts[-1]) + span
            part = windows[low:high]
            sums = np.zeros((len(part) + 1, 64))
            np.cumsum(_signs(part, self._weigh(part)), axis=0, out=sums[1:])
            prints = _fingerprints(sums[starts - low + span] - sums[starts - low])
            best = (0.0, 0)
            for start in starts[_near(prints, self.prints[item])].tolist():
                content = windows[start:start + span]
                key = item, hash(content.tobytes())
                found = self.verified.get(key)
                if found is None:
                    if len(self.verified) >= _REMEMBERED:
                        self.verified.clear()
                    found = self.verified[key] = self.similarity(item, content)
                if found > best[0]:
                    best = found, start - first
            if best[0] >= MIN_SIMILARITY:
                yield row, item, best[0], best[1]


def _indexes(questions: DataFrame) -> list:
    """Broadcast question blocks of bounded size; they are collected one after the other."""
    rows = questions.select("id", "question").dropna(subset=["question"]).distinct().withColumn(
        "item", F.xxhash64("id", "question"))
    total = rows.count()

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches, 1):
            words = Words(texts, letters=True)
            sizes = {int(min(SHINGLE_WORDS, n)) for n in words.counts if n}
            windows = {g: words.windows(g) for g in sizes}
            sets = [_shingle_set(words, i, windows) for i in range(len(texts))]
            row = np.repeat(np.arange(len(texts)), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [piece.column(2).take(pa.array(row)),
                 pa.array(np.concatenate(sets).astype(np.uint64).view(np.int64))], names=["item", "shingle"])

    # Of all questions: how many hold a shingle, where that is more than one.
    held = rows.mapInArrow(shingled, "item long, shingle long")
    often = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(held.join(often, "shingle").groupBy("item").agg(
        F.collect_list(F.struct("shingle", "n")).alias("shared")), "item", "left")
    rows = checkpointed(rows)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("question") + 16 + 16 * F.coalesce(F.size("shared"), F.lit(0))), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("id", "question"), F.lit(blocks))
    context = questions.sparkSession.sparkContext
    out = []
    for b in range(blocks):
        # Sorted, so that all tasks and runs number the questions alike.
        held = rows.filter(block == b).orderBy("id", "question").collect()
        shared = {s["shingle"] & (1 << 64) - 1: s["n"] for r in held for s in r["shared"] or ()}
        out.append(context.broadcast(
            ([r["id"] for r in held], [r["question"] for r in held], total, shared)))
    return out


def _index(shared) -> QuestionIndex:
    ids, texts, total, held = shared.value
    key = hash((tuple(map(str, ids)), tuple(texts), total, frozenset(held.items())))
    return worker_cached(("questions", key), lambda: QuestionIndex(ids, texts, total, held))


def contaminated(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """documentId, id, similarity and firstWord for every question that a document contains.

    ``documents``: document records (``documentId``, ``text``); ``questions``: question
    records (``id``, ``question``). Other columns are ignored. Case and ASCII punctuation
    do not count. A match is a window of the question's length (of the text's, if that is
    shorter) whose weighted similarity is MIN_SIMILARITY or more; the best one is reported.
    Null and empty texts and questions match nothing; repeated document rows are reported
    each, repeated question rows once. Windows whose fingerprint lies beyond RADIUS
    are not compared, so a near copy may be missed (in tests none was). How many blocks
    the questions are read in does not change the result.
    """
    rows = documents.select("documentId", "text")
    out = T.StructType([
        T.StructField("documentId", rows.schema["documentId"].dataType),
        T.StructField("id", questions.schema["id"].dataType),
        T.StructField("similarity", T.DoubleType()), T.StructField("firstWord", T.LongType())])

    def searched(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for piece, texts in slices(batches, 1):
                found = list(index.matches(texts))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                     pa.array([index.ids[f[1]] for f in found], id_type),
                     pa.array([f[2] for f in found], pa.float64()),
                     pa.array([f[3] for f in found], pa.int64())], names=out.names)

        return rows.mapInArrow(run, out)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(out["id"].dataType)
    made = [searched(shared) for shared in _indexes(questions)]
    result = made[0]
    for more in made[1:]:
        result = result.unionByName(more)
    return result


def decontaminated(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """The document rows, with all their columns, that contain none of the questions.

    The same test as in ``contaminated``, applied as the rows pass; nothing is shuffled.
    """
    result = documents
    place = documents.columns.index("text")
    for shared in _indexes(questions):
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for piece, texts in slices(batches, place):
                dirty = {f[0] for f in index.matches(texts)}
                yield piece.filter(pa.array([i not in dirty for i in range(len(texts))]))

        result = result.mapInArrow(run, documents.schema)
    return result
