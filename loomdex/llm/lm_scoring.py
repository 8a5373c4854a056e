"""Cross-entropy difference of two matched bigram models.

The target and the background model share one vocabulary, that is every word of both, and
one smoothing; they differ in their counts only. A document's score is the mean over its
words of the target's loss minus the background's: the lower, the more the document is
like the target rather than like the corpus at large.

All words and all pairs of neighbours are counted, none is cut off and none shares a
cell; both are known by 64-bit hashes. Texts are counted in chunks: a chunk sends each of
its distinct words and pairs once, to the bucket that their hash falls into. A bucket adds
up the counts of all chunks, and answers the chunks that ask with the counts of what they
sent. A word or pair that fills the corpus is one entry of each chunk, so no bucket grows
with it, and the driver only gets three numbers per model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.word_arrays import Words, mixed, slices

PAIR_WEIGHT = 0.6           # of the pair estimate, if the first word was seen
CHUNK_BYTES = 1 << 22       # texts that are counted together
BUCKET_BYTES = 1 << 24      # of text for each bucket of words and pairs
_ADDED = 0.5                # to every word's count
_TARGET, _BACKGROUND, _ASKS = 1, 2, 4
_SENT = "bucket long, chunk long, role int, n int, low long, codes binary, counts binary"
_ANSWER = "chunk long, bucket long, target binary, background binary"


@dataclass
class PairModels:
    """Texts of both models; their counts are tables, which ``score`` makes and joins."""

    target: DataFrame
    background: DataFrame

    @cached_property
    def sums(self) -> tuple[int, int, int]:
        """Distinct words of both models, words of the target, words of the background."""
        buckets = _buckets(self.target, self.background)
        sent = _counted(self.target, _TARGET, buckets, False).unionByName(
            _counted(self.background, _BACKGROUND, buckets, False))
        found = sent.groupBy("bucket").applyInArrow(_summed, "n long, target long, background long")
        return tuple(found.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in found.columns]).first())

    def counts(self, pairs: bool = True) -> DataFrame:
        """item (hash of a word or, with ``pairs``, of a pair), target and background."""
        buckets = _buckets(self.target, self.background)
        return _counted(self.target, _TARGET, buckets, pairs).unionByName(
            _counted(self.background, _BACKGROUND, buckets, pairs),
        ).groupBy("bucket").applyInArrow(_listed, "item long, target long, background long")

    @cached_property
    def _words(self) -> pa.Table:
        return self.counts(pairs=False).toArrow()

    @property
    def known(self) -> np.ndarray:
        """Sorted hashes of the vocabulary. Collected for looking at small models only."""
        return np.sort(self._words["item"].to_numpy().view(np.uint64))

    @property
    def words(self) -> np.ndarray:
        """2 x (vocabulary + 1) counts, the last column is the unknown word; as ``known``."""
        order = np.argsort(self._words["item"].to_numpy().view(np.uint64))
        return np.array([np.append(self._words[c].to_numpy()[order], 0)
                         for c in ("target", "background")])


def _buckets(*texts: DataFrame) -> int:
    """Buckets for the words and pairs of so much text."""
    return max(2 * _partitions(texts[0]), sum(map(_bytes, texts)) // BUCKET_BYTES)


def _partitions(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _bytes(texts: DataFrame) -> int:
    return texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers from 0, lowest bytes first; as many bytes each as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _values(planes: bytes, n: int) -> np.ndarray:
    held = np.zeros((n, 8), np.uint8)
    width = len(planes) // n
    held[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return held.view("<u8").ravel()


def _pairs(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all pairs of neighbours in a row, and the places of their second words."""
    second = np.flatnonzero(rows[1:] == rows[:-1]) + 1
    first = mixed(hashes[second - 1] + np.uint64(0x2545F4914F6CDD1D))
    return mixed(first * np.uint64(0xD6E8FEB86659FD93) + hashes[second]), second


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    words = Words(texts, letters=True)
    return words.hashes, np.repeat(np.arange(len(texts)), words.counts)


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    return (((codes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _sent(codes: np.ndarray, counts: np.ndarray, buckets: int, chunk: int | None,
          role: int) -> pa.RecordBatch:
    """Sorted distinct codes and their counts, a row per bucket: a bucket is a range of codes."""
    bucket = _bucket(codes, buckets)
    there, at = np.unique(bucket, return_index=True)
    ends = [*at[1:].tolist(), len(codes)]
    n = np.diff([*at, len(codes)]).astype(np.int32)
    blobs = [(_planes(np.diff(codes[a:b], prepend=codes[a:a + 1])), _planes(counts[a:b]))
             for a, b in zip(at.tolist(), ends)]
    return pa.RecordBatch.from_arrays([
        pa.array(there), pa.array([chunk] * len(there), pa.int64()),
        pa.array(np.full(len(there), role, np.int32)), pa.array(n), pa.array(codes[at].view(np.int64)),
        pa.array([x for x, _ in blobs], pa.binary()), pa.array([x for _, x in blobs], pa.binary()),
    ], names=["bucket", "chunk", "role", "n", "low", "codes", "counts"])


def _counted(texts: DataFrame, role: int, buckets: int, pairs: bool) -> DataFrame:
    """What the chunks of ``texts`` send to the buckets, without a wish for answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            return _sent(*np.unique(np.concatenate(held), return_counts=True), buckets, None, role)

        for _, part in slices(batches, 0):
            hashes, rows = _hashed(part)
            held += [hashes, _pairs(hashes, rows)[0]] if pairs else [hashes]
            size += 8 * len(hashes)
            if size >= CHUNK_BYTES:
                yield made()
                held, size = [], 0
        if size:
            yield made()

    return texts.select("text").mapInArrow(run, _SENT)


def _added(bucket: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct codes of a bucket, their counts in both models, and the place of each code sent."""
    codes, counts = [], ([], [])
    for role, n, low, steps, number in zip(
            *(bucket[c].to_pylist() for c in ("role", "n", "low", "codes", "counts"))):
        step = _values(steps, n)
        step[0] = low % (1 << 64)
        codes.append(np.cumsum(step, dtype=np.uint64))
        number = _values(number, n).astype(np.int64)
        counts[0].append(number * bool(role & _TARGET))
        counts[1].append(number * bool(role & _BACKGROUND))
    every = np.concatenate(codes)
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    places = np.empty(len(every), np.int64)
    places[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return every[first], [np.add.reduceat(np.concatenate(c)[order], first) for c in counts], places


def _listed(bucket: pa.Table) -> pa.Table:
    codes, (target, background), _ = _added(bucket)
    return pa.table({"item": codes.view(np.int64), "target": target, "background": background})


def _summed(bucket: pa.Table) -> pa.Table:
    """A row: distinct codes with a count, and the sums of both models."""
    _, (target, background), _ = _added(bucket)
    return pa.table({"n": [len(target)], "target": [target.sum()], "background": [background.sum()]})


def _answered(bucket: pa.Table) -> pa.Table:
    """For every chunk that asks, the counts of what it sent, in the order of its codes."""
    _, counts, places = _added(bucket)
    out, end = {"chunk": [], "bucket": [], "target": [], "background": []}, 0
    for role, n, chunk, number in zip(
            *(bucket[c].to_pylist() for c in ("role", "n", "chunk", "bucket"))):
        at, end = places[end:end + n], end + n
        if role & _ASKS:
            for name, value in (("chunk", chunk), ("bucket", number),
                                ("target", _planes(counts[0][at])), ("background", _planes(counts[1][at]))):
                out[name].append(value)
    return pa.table(out, pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()),
                                    ("target", pa.binary()), ("background", pa.binary())]))


def _chunk_items(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words and then pairs of a chunk, the row of each word, and the pairs' second words."""
    hashes, rows, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    batches = pa.table({"text": texts}).to_batches()
    for _, part in slices(iter(batches), 0):
        h, r = _hashed(part)
        hashes.append(h)
        rows.append(r + at)
        at += len(part)
    words, rows = np.concatenate(hashes), np.concatenate(rows)
    pairs, second = _pairs(words, rows)
    return words, pairs, rows, second


def score(documents: DataFrame, models: PairModels) -> DataFrame:
    """documentId, nWords, targetLoss, backgroundLoss and score of every whole text.

    ``documents``: document records (``documentId``, ``text``); other columns are ignored.
    Losses are means per word in nats; score is their difference. Texts without words,
    null ones too, have no losses and score null. Rows map to rows. Words that neither
    model has count as one more word of the vocabulary, which was never seen.

    Documents that are the background are counted as they ask.
    """
    rows = documents.select("documentId", "text")
    same = documents.select("text").sameSemantics(models.background.select("text"))
    sources = [models.target, rows] if same else [models.target, models.background, rows]
    buckets = _buckets(*sources)
    chunks = max(2 * _partitions(rows), _bytes(rows) // CHUNK_BYTES)
    distinct, *totals = models.sums
    role = _ASKS | _BACKGROUND if same else _ASKS
    names = ["nWords", "targetLoss", "backgroundLoss", "score"]
    out = T.StructType([
        T.StructField("documentId", rows.schema["documentId"].dataType),
        T.StructField("nWords", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names[1:]]])

    def asked(chunk: pa.Table) -> pa.Table:
        words, pairs, _, _ = _chunk_items(chunk["text"])
        codes, counts = np.unique(np.concatenate([words, pairs]), return_counts=True)
        return pa.Table.from_batches([_sent(codes, counts, buckets, chunk["chunk"][0].as_py(), role)])

    def scored(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        words, pairs, row, second = _chunk_items(chunk["text"])
        codes, places = np.unique(np.concatenate([words, pairs]), return_inverse=True)
        sizes = np.bincount(_bucket(codes, buckets), minlength=buckets)
        answers = answers.sort_by("bucket")
        numbers = answers["bucket"].to_pylist()
        if numbers != np.flatnonzero(sizes).tolist():
            raise ValueError("a bucket's answer is missing")
        n = np.bincount(row, minlength=chunk.num_rows)
        means = []
        for name, total in zip(("target", "background"), totals):
            count = np.concatenate([np.zeros(0, np.uint64), *(
                _values(b, sizes[k]) for k, b in zip(numbers, answers[name].to_pylist()))])
            seen = count[places].astype(np.float64)
            single = (seen[:len(words)] + _ADDED) / (total + _ADDED * (distinct + 1))
            chance = single.copy()
            context = seen[second - 1]
            there = context > 0
            at = second[there]
            chance[at] = (PAIR_WEIGHT * seen[len(words):][there] / context[there]
                          + (1 - PAIR_WEIGHT) * single[at])
            sums = np.bincount(row, -np.log(chance), chunk.num_rows)
            means.append(sums / np.maximum(n, 1))
        columns = [*means, means[0] - means[1]]
        return pa.Table.from_arrays(
            [chunk["documentId"], pa.array(n.astype(np.int64)),
             *[pa.array(c, pa.float64(), mask=n == 0) for c in columns]], names=out.names)

    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("documentId", "text"), F.lit(chunks)))
    sent = _counted(models.target, _TARGET, buckets, True)
    if not same:
        sent = sent.unionByName(_counted(models.background, _BACKGROUND, buckets, True))
    sent = sent.unionByName(dealt.groupBy("chunk").applyInArrow(asked, _SENT))
    answers = sent.groupBy("bucket").applyInArrow(_answered, _ANSWER)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(scored, out)


def fit(target: DataFrame, background: DataFrame) -> PairModels:
    """Models of all rows of ``target`` and ``background`` (``text`` each).

    The vocabulary is every word of both. Words are compared without case and ASCII
    punctuation. Null and empty texts add nothing; repeated rows count each.
    """
    return PairModels(target.select("text"), background.select("text"))
