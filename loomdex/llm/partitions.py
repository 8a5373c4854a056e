"""Helpers for work on sorted partitions, id filters of fixed size, and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.word_arrays import memory_returned
from loomdex.session import checkpointed

FILTER_BITS = 1 << 23       # an id filter has one mebibyte, whatever the table's size
_FILTER_HASHES = 3
_HASH_SHIFT = 16            # between the bits of a hash that are its places


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The groups of rows with equal leading ``keys`` columns, of batches sorted by them.

    Only one group and one batch are held at a time.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        change = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            here, before = batch.column(k).slice(1), batch.column(k).slice(0, batch.num_rows - 1)
            same = pc.or_(pc.fill_null(pc.equal(here, before), False),
                          pc.and_(pc.is_null(here), pc.is_null(before)))
            change[1:] |= ~same.to_numpy(zero_copy_only=False)
        first = [table.column(k)[0].as_py() for k in range(keys)]
        if held and [held[0].column(k)[0].as_py() for k in range(keys)] != first:
            yield pa.concat_tables(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            held.append(table.slice(a, b - a))
            yield pa.concat_tables(held) if len(held) > 1 else held[0]
            held = []
        held.append(table.slice(cuts[-2]))
    if held:
        yield pa.concat_tables(held)
    held.clear()
    memory_returned()


class IdFilter:
    """A Bloom filter of fixed size over the values of ``ids``' only column.

    It is broadcast to drop rows without a partner before a join shuffles their texts. It
    never drops a partner; with more ids than it was made for, it only drops less.
    """

    def __init__(self, ids: DataFrame, bits: int = FILTER_BITS, hashed: bool = False) -> None:
        """``hashed`` ids are 64-bit hashes: their own bits are their places, see ``test``."""
        self.bits, self.hashed = bits, hashed
        words = (
            ids.select(F.explode(F.array(*self._places(F.col(ids.columns[0])))).alias("place"))
            .groupBy(F.shiftright("place", 5).cast("int").alias("word"))
            .agg(F.bit_or(F.pow(F.lit(2.0), F.col("place") % 32).cast("long")).alias("bits"))
            .toArrow()
        )
        held = np.zeros(bits // 32, np.uint32)
        held[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
        self.shared = ids.sparkSession.sparkContext.broadcast(held)

    def _places(self, key: Column) -> list[Column]:
        if self.hashed:
            return [F.shiftrightunsigned(key, _HASH_SHIFT * i).bitwiseAND(F.lit(self.bits - 1).cast("long"))
                    for i in range(_FILTER_HASHES)]
        return [F.pmod(F.xxhash64(F.lit(i), key), F.lit(self.bits)) for i in range(_FILTER_HASHES)]

    def test(self) -> Callable[[np.ndarray], np.ndarray]:
        """For a function that makes ``hashed`` ids itself: which of them are probably met."""
        shared, bits = self.shared, self.bits

        def met(ids: np.ndarray) -> np.ndarray:
            found = np.ones(len(ids), bool)
            for i in range(_FILTER_HASHES):
                place = (ids.astype(np.uint64) >> np.uint64(_HASH_SHIFT * i)) & np.uint64(bits - 1)
                found &= (shared.value[place >> np.uint64(5)] >> (place & np.uint64(31)).astype(np.uint32)) & 1 == 1
            return found

        return met

    def keep(
        self, rows: DataFrame, column: str, met: bool = True,
        then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None,
        schema: str | None = None,
    ) -> DataFrame:
        """The rows whose ``column`` is probably met; or, if not ``met``, surely is not.

        ``then`` makes rows of ``schema`` of them in the same pass and the same worker.
        """
        shared, width = self.shared, len(rows.columns)

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = np.ones(batch.num_rows, bool)
                for i in range(width, batch.num_columns):
                    place = batch.column(i).to_numpy()
                    found &= (shared.value[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1
                yield pa.RecordBatch.from_arrays(
                    batch.columns[:width], names=batch.schema.names[:width],
                ).filter(pa.array(found == met))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from then(passing(batches)) if then else passing(batches)

        places = [p.alias(f"_place{i}") for i, p in enumerate(self._places(F.col(column)))]
        return rows.select("*", *places).mapInArrow(run, schema or rows.schema)


def components(edges: DataFrame) -> DataFrame:
    """id and component (smallest id reachable) of all ids in ``edges`` (a, b).

    Alternating large and small stars: every round points ids at smaller ids in their
    neighbourhood; the rounds grow with the logarithm of the longest chain. Each round's
    edges are written to the shared folder.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("low"))

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Larger (or smaller) neighbours of a node, and itself, get its smallest neighbour."""
        if large:
            both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = smallest(both).select("a", F.least("a", "low").alias("low"))
        met = both.join(low, "a")
        if large:
            moved = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            moved = met.select(F.col("b").alias("a"), F.col("low").alias("b"))
        own = low.select("a", F.col("low").alias("b"))
        return moved.union(own).filter(F.col("a") != F.col("b")).distinct()

    pairs = checkpointed(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct())
    before = None
    while True:
        pairs = checkpointed(star(star(pairs, True), False))
        state = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if state == before:
            return pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).union(
                pairs.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before = state
