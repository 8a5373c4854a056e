"""Removal of word runs that occurred earlier, by suffix automata of reference shards.

A shard holds the passages around one fingerprint: of every window of WINDOW_WORDS words
the five-word run with the smallest hash, so that equal windows come to the same shard.
In a shard the passages pass in the order of the corpus; each is streamed through the
suffix automaton of those before it, and where the matching length reaches
WINDOW_WORDS, the window occurred earlier. Fingerprints met once are dropped first.
Passages around a frequent fingerprint are cut again by the second smallest hash of their
windows; only what many different passages share even then is compared by whole windows.

The automata of all shards together grow with the corpus. So they are not broadcast;
each task builds those of its shards, next to the passages that can match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.partitions import IdFilter, sorted_groups
from loomdex.llm.suffix_automaton import SuffixAutomaton
from loomdex.llm.word_arrays import Words, memory_returned, mixed, slices
from loomdex.session import written

WINDOW_WORDS = 20
GRAM_WORDS = 5
SHARD_PASSAGES = 500        # shards with more different passages are cut again, then by whole windows
_START = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
FILTER_BITS = 1 << 26       # of the filter for repeated fingerprints: eight mebibytes


def _passages(words: Words, row: int, grams: np.ndarray,
              but: np.uint64 | None = None) -> tuple[np.ndarray, ...]:
    """(fingerprint, first window, number of windows) of the passages of a text.

    A passage is a maximal range of windows that select the same run of words. Runs with
    the hash ``but`` are selected last.
    """
    own = words.row_windows(row, grams, GRAM_WORDS)
    if but is not None:
        own = np.where(own == but, _LAST, own)
    span = WINDOW_WORDS - GRAM_WORDS + 1
    if len(own) < span:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    chosen = np.lib.stride_tricks.sliding_window_view(own, span).argmin(1)
    chosen += np.arange(len(chosen))
    start = np.concatenate([[0], np.flatnonzero(np.diff(chosen)) + 1])
    return own[chosen[start]], start, np.diff(np.concatenate([start, [len(chosen)]]))


def _fingerprints(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, 1):
            words = Words(texts)
            grams = words.windows(GRAM_WORDS)
            found = [_passages(words, i, grams)[0] for i in range(len(texts))]
            values, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(values.astype(np.int64)), pa.array(n)], names=["fingerprint", "n"])

    return documents.mapInArrow(run, "fingerprint long, n long")


def _every_passage(documents: DataFrame, key: str, text: bool, wanted: IdFilter) -> DataFrame:
    """fingerprint, documentId, row, start, windows, head; and the content's hash, or its text.

    head is a hash of fingerprint, documentId and start. ``wanted`` filters by fingerprint, or
    by head where texts are asked for, in the worker that makes the passages.
    """
    met = wanted.test()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in slices(batches, 1):
            words = Words(texts)
            grams = words.windows(GRAM_WORDS)
            found = [_passages(words, i, grams) for i in range(len(texts))]
            prints, starts, counts = (np.concatenate([f[i] for f in found]) for i in range(3))
            row = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
            ids = piece.column(3).to_numpy().astype(np.uint64)
            heads = mixed(mixed(ids[row] + starts.astype(np.uint64) * _START) ^ prints)
            kept = np.flatnonzero(met(heads if text else prints))
            prints, starts, counts, row, heads = (a[kept] for a in (prints, starts, counts, row, heads))
            first = words.first[row] + starts
            if text:
                place = np.stack([words.starts[first], words.ends[first + counts + WINDOW_WORDS - 2]])
                content = pa.array([words.bytes[a:b].decode() for a, b in place.T.tolist()], pa.string())
            else:
                content = pa.array(words.ranges(first, first + counts + WINDOW_WORDS - 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(prints.astype(np.int64)), piece.column(0).take(pa.array(row)),
                 piece.column(2).take(pa.array(row)), pa.array(starts.astype(np.int32)),
                 pa.array(counts.astype(np.int32)), pa.array(heads.astype(np.int64)), content],
                names=["fingerprint", "documentId", "row", "start", "windows", "head", "content"])

    return documents.mapInArrow(run, f"fingerprint long, documentId {key}, row long, start int, "
                                     f"windows int, head long, content {'string' if text else 'long'}")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of windows that an earlier passage of the same shard holds.

    Passages of smaller documentIds are in the automaton. Those of one documentId compare
    their windows by place, as rows may share it: a window does not remove itself.
    """
    for shard in sorted_groups(batches, 1):
        if shard.num_rows < 2:
            continue
        automaton = SuffixAutomaton()
        rows, starts = [], []
        ids, numbers, offsets, passages = (
            shard[c].to_pylist() for c in ("documentId", "row", "start", "passage"))
        begin = 0
        while begin < len(ids):
            end = begin + 1
            while end < len(ids) and ids[end] == ids[begin]:
                end += 1
            holders: dict[tuple[int, str], set[int]] = {}
            for i in range(begin, end):
                holders.setdefault((offsets[i], passages[i]), set()).add(numbers[i])
            own = [(offset, passage.encode().split(), holders[offset, passage])
                   for offset, passage in sorted(holders)]
            first = {}
            for offset, words, _ in own if len(own) > 1 else ():
                for place in range(len(words) - WINDOW_WORDS + 1):
                    window = tuple(words[place:place + WINDOW_WORDS])
                    first[window] = min(first.get(window, offset + place), offset + place)
            for offset, words, held in own:
                lengths = automaton.matching_lengths(words) if begin else [0] * len(words)
                for last, size in enumerate(lengths, 1):
                    place = last - WINDOW_WORDS
                    if size >= WINDOW_WORDS or place >= 0 and first.get(
                            tuple(words[place:last]), offset + place) < offset + place:
                        rows.extend(held)
                        starts.extend([offset + place] * len(held))
            for _, words, _ in own if end < len(ids) else ():
                automaton.add(words)
            begin = end
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(starts, pa.int32()), pa.array([1] * len(rows), pa.int32())],
                names=["row", "start", "windows"])


def _narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages in parts by their second fingerprint. Equal windows come to equal parts' keys."""
    for piece, texts in slices(batches, 4):
        words = Words(texts)
        grams = words.windows(GRAM_WORDS)
        before = piece.column(0).to_numpy().astype(np.uint64)
        found = [_passages(words, i, grams, before[i]) for i in range(len(texts))]
        prints, starts, counts = (np.concatenate([f[i] for f in found]) for i in range(3))
        row = np.repeat(np.arange(len(texts)), [len(f[0]) for f in found])
        first = words.first[row] + starts
        end = first + counts + WINDOW_WORDS - 1
        parts = [words.bytes[a:b].decode()
                 for a, b in zip(words.starts[first].tolist(), words.ends[end - 1].tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(mixed(mixed(before[row]) ^ prints).astype(np.int64)),
             *(piece.column(c).take(pa.array(row)) for c in (1, 2)),
             pa.array((piece.column(3).to_numpy()[row] + starts).astype(np.int32)),
             pa.array(counts.astype(np.int32)), pa.array(words.ranges(first, end).astype(np.int64)),
             pa.array(parts, pa.string())],
            names=["fingerprint", "documentId", "row", "start", "windows", "content", "passage"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per window of the passages."""
    for batch in batches:
        rows, starts, texts = [], [], []
        offsets = batch.column(2).to_pylist()
        for i, passage in enumerate(batch.column(3).to_pylist()):
            words = passage.encode().split()
            for j in range(len(words) - WINDOW_WORDS + 1):
                rows.append(i)
                starts.append(offsets[i] + j)
                texts.append(b" ".join(words[j:j + WINDOW_WORDS]).decode())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)),
             pa.array(starts, pa.int32()), pa.array(texts, pa.string())],
            names=["documentId", "row", "start", "window"])


def repeated_windows(documents: DataFrame) -> DataFrame:
    """row, start and windows: ranges of windows whose words also start earlier.

    row is the hash of documentId and text. Earlier means a smaller documentId, or the same
    one and a smaller start, be it in another row. Windows that start at the same word of
    rows that share a documentId do not remove each other.
    """
    documents = documents.select(
        "documentId", "text", _row().alias("row"), F.xxhash64("documentId").alias("idHash"))
    key = documents.schema["documentId"].dataType.simpleString()
    often = _fingerprints(documents).groupBy("fingerprint").agg(F.sum("n").alias("n")).filter("n > 1")
    # Fingerprint and content are hashes of different words, so that both name the passage.
    passages = written(_every_passage(
        documents, key, False, IdFilter(often.select("fingerprint"), FILTER_BITS, hashed=True)))
    at = F.struct("documentId", "start")
    contents = passages.groupBy("fingerprint", "content").agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.min_by("head", at).alias("head"))
    # Of equal passages only the first can hold a window that is not a copy.
    copies = (
        passages.join(contents.filter(~F.col("first").eqNullSafe(F.col("last")))
                      .select("fingerprint", "content", "first"), ["fingerprint", "content"])
        .filter(~F.col("first").eqNullSafe(at)).select("row", "start", "windows"))
    several = contents.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("different")).filter(
        "different > 1")
    heads = written(contents.join(several, "fingerprint").select("head", "different"))
    texts = _every_passage(documents, key, True, IdFilter(heads.select("head"), FILTER_BITS, hashed=True))
    firsts = written(texts.select(
        "head", "fingerprint", F.col("content").alias("passage"), "documentId", "row", "start",
    ).join(heads, "head"))
    passage = ["fingerprint", "documentId", "row", "start", "passage"]
    # Common runs of words: parts of their passages by a second fingerprint, equal ones once.
    parts = written(firsts.filter(F.col("different") > SHARD_PASSAGES).select(*passage).mapInArrow(
        _narrowed, f"fingerprint long, documentId {key}, row long, start int, windows int, "
                   "content long, passage string"))
    known = parts.groupBy("fingerprint", "content").agg(F.min(at).alias("first"))
    different = known.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("different"))
    parts = written(parts.join(known.join(different, "fingerprint"), ["fingerprint", "content"]))
    equal = parts.filter(~F.col("first").eqNullSafe(at)).select("row", "start", "windows")
    others = parts.filter(F.col("first").eqNullSafe(at) & (F.col("different") > 1))
    streamed = (
        firsts.filter(F.col("different") <= SHARD_PASSAGES).select(*passage)
        .unionByName(others.filter(F.col("different") <= SHARD_PASSAGES).select(*passage))
        .repartition("fingerprint").sortWithinPartitions("fingerprint", "documentId", "start")
        .mapInArrow(_streamed, "row long, start int, windows int"))
    # What is frequent even so: by windows, which are made once.
    split = written(
        others.filter(F.col("different") > SHARD_PASSAGES).select("documentId", "row", "start", "passage")
        .mapInArrow(_split, f"documentId {key}, row long, start int, window string")
        .withColumn("window", F.sha2("window", 256)))
    earliest = split.groupBy("window").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter(
        ~F.col("first").eqNullSafe(F.col("last"))).select("window", "first")
    later = split.join(earliest, "window").filter(~F.col("first").eqNullSafe(at)).select(
        "row", "start", F.lit(1).alias("windows"))
    return copies.unionByName(equal).unionByName(streamed).unionByName(later)


def _row() -> Column:
    return F.xxhash64("documentId", "text")


def deduplicated(documents: DataFrame) -> DataFrame:
    """documentId, nWords, nRemoved (long) and keptText of every document.

    ``documents``: document records (``documentId`` of any ordered type, ``text``); other
    columns are ignored. Words are runs without ASCII white space, unchanged. keptText has
    the words that no removed window covers, joined by one blank. Null and empty texts
    have no words. All windows are judged on the input. Rows that share a documentId (null
    is smaller than any) lose each what ``repeated_windows`` says of that row.
    """
    documents = documents.select("documentId", "text", _row().alias("row"))
    key = documents.schema["documentId"].dataType.simpleString()
    ranges = written(repeated_windows(documents).groupBy("row").agg(
        F.collect_list(F.struct("start", "windows")).alias("ranges")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                counts.append(len(words))
                gone = np.zeros(len(words) + 1, np.int64)
                for span in spans.as_py() or ():
                    gone[span["start"]] += 1
                    gone[span["start"] + span["windows"] + WINDOW_WORDS - 1] -= 1
                stays = np.cumsum(gone[:-1]) == 0
                removed.append(len(words) - int(stays.sum()))
                if removed[-1]:
                    words = [words[i] for i in np.flatnonzero(stays)]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string())], names=["documentId", "nWords", "nRemoved", "keptText"])
        batch = None
        memory_returned()

    found = IdFilter(ranges.select("row"))
    spans = ranges.schema["ranges"].dataType
    touched = found.keep(documents, "row").join(ranges, "row", "left").select(
        "documentId", "text", "ranges")
    out = f"documentId {key}, nWords long, nRemoved long, keptText string"
    others = found.keep(
        documents.select("documentId", "text", F.lit(None).cast(spans).alias("ranges"), "row"),
        "row", met=False, then=run, schema=out)
    return touched.mapInArrow(run, out).unionByName(others)
