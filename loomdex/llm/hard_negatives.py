"""Hard negatives for chunk vectors: near chunks of other documents, by exact scores.

Anchors meet all chunks in a grid: blocks of anchors of bounded size, and for each block
slots that the chunks are dealt to. A task holds one block and streams the chunks of its
slot past it, so neither side is collected, and the anchors may grow with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.residue_products import primes_for, products, residues
from loomdex.session import written

POSITIVES = 5
NEGATIVES = 10
LOWEST, HIGHEST = 30, 90    # a negative's score in hundredths of the positive's
SCALE = 256                 # a component x counts as floor(SCALE * x)
BLOCK_BYTES = 64 << 20      # of residues of one block of anchors
BLOCK_ANCHORS = 1 << 16     # most anchors of a block on average
_ROWS, _ANCHORS = 2048, 1024    # scores that are looked at together
_NONE = np.iinfo(np.int64).min


def _taking_part(chunks: DataFrame) -> DataFrame:
    """The chunks with a document and a vector of finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return chunks.filter(F.col("documentId").isNotNull() & F.col("embedding").isNotNull() & finite)


def _whole(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of every component; shorter vectors end in zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[row, column] = np.floor(SCALE * values)
    return out


class _Best:
    """The first ``most`` candidates of every key, by score and then by arrival."""

    def __init__(self, keys: int, most: int) -> None:
        self.most = most
        self.key, self.score, self.place = (np.zeros(0, np.int64) for _ in range(3))
        self.ids: pa.Array | None = None
        #: Score that a later candidate must exceed.
        self.floor = np.full(keys, _NONE)

    def add(self, key: np.ndarray, score: np.ndarray, place: np.ndarray, ids: pa.Array) -> None:
        key, score, place = (np.concatenate(pair) for pair in (
            (self.key, key), (self.score, score), (self.place, place)))
        ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        order = np.lexsort((place, -score, key))
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.concatenate([first, [len(key)]])))
        stays = rank < self.most
        order = order[stays]
        self.key, self.score, self.place = key[stays], score[order], place[order]
        self.ids = ids.take(pa.array(order))
        full = rank[stays] == self.most - 1
        self.floor[self.key[full]] = self.score[full]


def _leading(scores: np.ndarray, able: np.ndarray, most: int) -> np.ndarray:
    """``able`` with at most ``most`` marks in a row: the highest scores, the first of ties."""
    for row in np.flatnonzero(able.sum(1) > most).tolist():
        places = np.flatnonzero(able[row])
        able[row] = False
        able[row, places[np.argsort(-scores[row, places], kind="stable")[:most]]] = True
    return able


class _Block:
    """A block of anchors with what has been found for them so far."""

    def __init__(self, rows: pa.Table, width: int, primes: tuple[int, ...]) -> None:
        self.width, self.primes = width, primes
        rows = rows.combine_chunks()
        self.anchors = rows["anchor"].to_numpy()
        vectors = rows["embedding"].combine_chunks()
        self.residues = residues(_whole(vectors, width), primes)
        self.ids = pc.unique(rows["chunkId"])
        self.id_codes = pc.index_in(rows["chunkId"], self.ids).to_numpy(zero_copy_only=False)
        self.documents = pc.unique(rows["documentId"])
        self.codes = pc.index_in(rows["documentId"], self.documents).to_numpy(zero_copy_only=False)
        self.positives = [np.array(p or [], np.int64) for p in rows["positives"].to_pylist()]
        n = len(self.anchors)
        self.seen = 0
        self.slots = max(map(len, self.positives), default=0)
        self.best = _Best(n * max(1, self.slots), NEGATIVES if self.slots else POSITIVES)
        scores = np.full((n, max(1, self.slots)), _NONE)
        for i, own in enumerate(self.positives):
            scores[i, :len(own)] = own
        # bounds of whole numbers; a negative score leaves no room between them
        self.low = np.where(scores < 0, 0, -(-LOWEST * np.maximum(scores, 0) // 100))
        self.high = np.where(scores < 0, -1, HIGHEST * np.maximum(scores, 0) // 100)

    def _scores(self, anchors: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        return products([r[anchors] for r in self.residues], rows, self.primes)

    def meet(self, batch: pa.RecordBatch) -> None:
        """Score a batch of chunks, which arrive in the order of their ids."""
        for at in range(0, batch.num_rows, _ROWS):
            piece = batch.slice(at, _ROWS)
            ids = piece.column(piece.schema.get_field_index("chunkId"))
            vectors = piece.column(piece.schema.get_field_index("embedding"))
            rows = residues(_whole(vectors, self.width), self.primes)
            codes = pc.fill_null(pc.index_in(
                piece.column(piece.schema.get_field_index("documentId")), self.documents), -1)
            search = self._negatives if self.slots else self._positives
            search(rows, codes.to_numpy(zero_copy_only=False), ids)
            self.seen += piece.num_rows

    def _add(self, anchors, slot, scores, able, places, ids) -> None:
        row, column = np.nonzero(able)
        if len(row):
            found = places[column]
            self.best.add(anchors[row] * max(1, self.slots) + slot, scores[row, column],
                          self.seen + found, ids.take(pa.array(found)))

    def _positives(self, rows: list[np.ndarray], codes: np.ndarray, ids: pa.Array) -> None:
        """Chunks of the anchor's document; those that share its id are the anchor itself."""
        same = pc.fill_null(pc.index_in(ids, self.ids), -1).to_numpy(zero_copy_only=False)
        for code in np.unique(codes[codes >= 0]).tolist():
            places, every = np.flatnonzero(codes == code), np.flatnonzero(self.codes == code)
            own = [r[places] for r in rows]
            for at in range(0, len(every), _ANCHORS):
                anchors = every[at:at + _ANCHORS]
                scores = self._scores(anchors, own)
                able = (scores > self.best.floor[anchors, None]) & (
                    same[places] != self.id_codes[anchors, None])
                self._add(anchors, 0, scores, _leading(scores, able, POSITIVES), places, ids)

    def _negatives(self, rows: list[np.ndarray], codes: np.ndarray, ids: pa.Array) -> None:
        places = np.arange(len(codes))
        for at in range(0, len(self.anchors), _ANCHORS):
            anchors = np.arange(at, min(at + _ANCHORS, len(self.anchors)))
            scores = self._scores(anchors, rows)
            scores[codes == self.codes[anchors, None]] = _NONE
            for slot in range(self.slots):
                low = np.maximum(self.low[anchors, slot] - 1,
                                 self.best.floor[anchors * self.slots + slot])
                able = (scores > low[:, None]) & (scores <= self.high[anchors, slot, None])
                self._add(anchors, slot, scores, _leading(scores, able, NEGATIVES), places, ids)

    def found(self, out: T.StructType) -> Iterator[pa.RecordBatch]:
        if self.best.ids is not None:
            key, n = self.best.key, max(1, self.slots)
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.anchors[key // n]), pa.array((key % n).astype(np.int32)),
                 self.best.ids, pa.array(self.best.score)], names=out.names)


def _searched(anchors: DataFrame, chunks: DataFrame, blocks: int, width: int,
              primes: tuple[int, ...]) -> DataFrame:
    """anchor, slot, chunkId and score: per grid cell, the first candidates of its anchors."""
    key = chunks.schema["chunkId"].dataType
    partitions = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, partitions // blocks)
    none = F.lit(None)
    cells = (
        anchors.select(
            F.explode(F.transform(
                F.sequence(F.lit(0), F.lit(slots - 1)),
                lambda s: (F.pmod("anchor", F.lit(blocks)) * slots + s).cast("int"))).alias("cell"),
            F.lit(0).alias("kind"), "chunkId", "documentId", "embedding", "anchor", "positives")
        .unionByName(chunks.select(
            F.explode(F.transform(
                F.sequence(F.lit(0), F.lit(blocks - 1)),
                lambda b: (b * slots + F.pmod(F.xxhash64("chunkId", "embedding"), F.lit(slots))
                           ).cast("int"))).alias("cell"),
            F.lit(1).alias("kind"), "chunkId", "documentId", "embedding",
            none.cast("long").alias("anchor"), none.cast("array<long>").alias("positives"))))
    out = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("slot", T.IntegerType()),
                        T.StructField("chunkId", key), T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, block = None, [], None
        for batch in batches:
            place = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if cell != place[a] // 2:
                    if block:
                        yield from block.found(out)
                    cell, held, block = place[a] // 2, [], None
                if place[a] % 2 == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    block = _Block(pa.Table.from_batches(held), width, primes)
                    held = []
                if block:
                    block.meet(batch.slice(a, b - a))
        if block:
            yield from block.found(out)

    return (cells.repartitionById(blocks * slots, F.col("cell")).sortWithinPartitions("cell", "kind", "chunkId")
            .mapInArrow(run, out))


def mined(chunks: DataFrame, anchor: Column) -> DataFrame:
    """anchorId, positiveId, rank, negativeId, positiveScore and negativeScore (long).

    ``chunks``: embedded chunks (``chunkId`` and ``documentId`` of any ordered type,
    ``embedding``); other columns are ignored. ``anchor``: a condition on chunkId that
    names the anchors. A score is the inner product of the two vectors' whole components
    floor(SCALE * x); higher scores come first, ties by the smaller chunkId. The positives
    of an anchor are the first POSITIVES other chunks of its document. For each of them the
    first NEGATIVES chunks of other documents with LOWEST * positiveScore <= 100 *
    negativeScore <= HIGHEST * positiveScore are returned, ranked from 1.

    Chunks without a document or a vector, or with a component that is null or not finite,
    take no part. Shorter vectors end in zeros. Rows that share the anchor's chunkId (null
    counts as one id) are the anchor itself; every row that meets ``anchor`` is an anchor,
    and repeated rows are candidates each. Tables whose inner products might not fit a long
    raise ValueError. An empty table gives no rows.
    """
    rows = _taking_part(chunks.select("chunkId", "documentId", "embedding"))
    key = rows.schema["chunkId"].dataType
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    size, most, n = rows.agg(F.max(F.size("embedding")), F.max(largest),
                             F.count_if(anchor)).first()
    width = max(1, size or 0)
    bound = width * int(np.floor(SCALE * (most or 0.0)) + 1 if most != float("inf") else 0) ** 2
    primes = primes_for(bound)
    blocks = max(1, -(-n // BLOCK_ANCHORS), -(-n * width * 4 * len(primes) // BLOCK_BYTES))
    own = written(rows.filter(anchor).withColumn("anchor", F.monotonically_increasing_id()))
    positives = F.lit(None).cast("array<long>").alias("positives")
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc("chunkId"))
    first = (
        _searched(own.select("*", positives), rows, blocks, width, primes)
        .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= POSITIVES))
    met = written(
        first.groupBy("anchor").agg(F.sort_array(F.collect_list(
            F.struct("place", "chunkId", "score"))).alias("found"))
        .join(own, "anchor").select(
            "anchor", "chunkId", "documentId", "embedding", "found",
            F.transform("found", lambda f: f["score"]).alias("positives")))
    ranked = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("chunkId"))
    negatives = (
        _searched(met.drop("found"), rows, blocks, width, primes)
        .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= NEGATIVES))
    positive = F.get("found", F.col("slot"))
    return negatives.withColumnsRenamed({"chunkId": "negativeId", "score": "negativeScore"}).join(
        met.select("anchor", F.col("chunkId").alias("anchorId"), "found"), "anchor").select(
        "anchorId", positive["chunkId"].cast(key).alias("positiveId"), "rank", "negativeId",
        positive["score"].alias("positiveScore"), "negativeScore")
