"""Verdicts on source addresses by exact membership in Bloom filter cascades.

The first level of a cascade encodes the listed keys, the next the keys of the corpus
that pass it by mistake, the next the listed keys that pass that one, and so on until
none is left. As the levels are built over all keys of the corpus, a look-up of any of
them is exact, needs a few bits per listed key, and joins nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.word_arrays import mixed
from loomdex.session import checkpointed

MAX_LEVEL_BITS = 1 << 28    # a cascade is broadcast; rule lists that need more are refused
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of an address; both empty for null or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """What rules could fit: the host and its parents, with path starts of these lengths.

    Longest first; of keys of one length the one with the longer host.
    """
    labels = F.split(host, r"\.", -1)
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    every = F.flatten(F.transform(parents, lambda p: F.transform(
        starts, lambda n: F.struct(
            (-(F.length(p) + n)).alias("order"), (-F.length(p)).alias("parent"),
            F.concat(p, F.left(path, n)).alias("key")))))
    named = F.transform(F.array_sort(every), lambda x: x["key"])
    return F.when(host != "", named).otherwise(F.array().cast("array<string>"))


def _marks(key: Column) -> list[Column]:
    """128 bits that stand for a key."""
    return [F.xxhash64(key), F.xxhash64(F.lit(1), key)]


@dataclass
class Level:
    bits: np.ndarray
    size: int
    hashes: int
    number: int

    def parts(self) -> tuple:
        """Plain values: a broadcast of the class would need this package in the workers."""
        return self.bits, self.size, self.hashes, self.number

    def places(self, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
        salt = np.uint64(self.number * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        first, step = mixed(a.view(np.uint64) + salt), mixed(b.view(np.uint64) + salt) | np.uint64(1)
        for i in range(self.hashes):
            yield ((first + np.uint64(i) * step) % np.uint64(self.size)).astype(np.int64)

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.ones(len(a), bool)
        for place in self.places(a, b):
            found &= (self.bits[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1
        return found


def _members(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether keys are listed: an even level is the last that lets them through."""
    passed = np.zeros(len(a), np.int64)
    going = np.ones(len(a), bool)
    for level in levels:
        going &= level.has(a, b)
        passed += going
    return passed % 2 == 1


def _level(rows: DataFrame, count: int, others: int, number: int) -> Level:
    """A filter over ``rows`` (a, b). The first one lets about as many through as it holds."""
    rate = 0.5 if number else min(0.5, math.sqrt(0.5) * count / max(others, 1))
    size = max(64, math.ceil(count * math.log2(1 / rate) / math.log(2)))
    if size > MAX_LEVEL_BITS:
        raise ValueError(f"{count} listed keys need {size} bits; at most {MAX_LEVEL_BITS}")
    level = Level(np.zeros(-(-size // 32), np.uint32), size, max(1, round(math.log2(1 / rate))), number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.unique(np.concatenate(list(level.places(
                batch.column(0).to_numpy(), batch.column(1).to_numpy()))))
            yield pa.RecordBatch.from_arrays(
                [pa.array((place >> 5).astype(np.int32)),
                 pa.array(np.int64(1) << (place & 31))], names=["word", "bits"])

    words = rows.mapInArrow(run, "word int, bits long").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()
    level.bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return level


def _passing(rows: DataFrame, level: Level) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(level.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = Level(*shared.value)
        for batch in batches:
            found = level.has(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield batch.filter(pa.array(found))

    return rows.mapInArrow(run, rows.schema)


def cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """The levels that tell ``listed`` keys from all others in ``universe``.

    Both have the columns a and b, the marks of distinct keys. Keys that are in neither
    may be taken for either.
    """
    own = listed.distinct()
    others = universe.join(own, ["a", "b"], "left_anti")
    sides = [(own, own.count()), (others, others.count())]
    levels: list[Level] = []
    while sides[0][1]:
        levels.append(_level(sides[0][0], sides[0][1], sides[1][1], len(levels)))
        passed = checkpointed(_passing(sides[1][0], levels[-1]))
        sides = [(passed, passed.count()), sides[0]]
    return levels


def verdicts(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """documentId, host, path, rule and verdict of every document's sourceUrl.

    ``documents``: document records (``documentId``, ``sourceUrl``); ``rules``: ``rule``, a
    host followed by the start of a path, and ``verdict``, allow or block. Other columns are
    ignored. A rule fits its host and all subdomains where the path starts with the rule's;
    the longest wins, of equally long ones that with the longer host; a rule that is listed
    twice blocks if either row does. Without a fitting rule ``rule`` is null and the
    address, being on no list, is allowed. Null and unusable addresses have an empty host
    and path and fit no rule. Rows map to rows.
    """
    rows = documents.select("documentId", "sourceUrl")
    rules = rules.select("rule", "verdict").dropna(subset=["rule"]).groupBy("rule").agg(
        F.max("verdict").alias("verdict"))
    starts = F.greatest(F.length("rule") - F.length(F.substring_index("rule", "/", 1)), F.lit(0))
    lengths = sorted(r[0] for r in rules.select(starts).distinct().collect())
    if len(lengths) > 64:
        raise ValueError(f"rules with {len(lengths)} different path lengths; at most 64")
    host, path = host_and_path(F.col("sourceUrl"))
    parted = rows.select("documentId", host.alias("host"), path.alias("path"))
    parted = parted.withColumn("keys", keys(F.col("host"), F.col("path"), lengths))
    universe = checkpointed(
        parted.select(F.explode("keys").alias("key")).union(rules.select("rule")).distinct()
        .select(*[m.alias(n) for m, n in zip(_marks(F.col("key")), "ab")]))
    of_rule = [m.alias(n) for m, n in zip(_marks(F.col("rule")), "ab")]
    listed = cascade(rules.select(*of_rule), universe)
    blocked = cascade(rules.filter("verdict = 'block'").select(*of_rule), universe)
    shared = rows.sparkSession.sparkContext.broadcast(
        tuple([level.parts() for level in levels] for levels in (listed, blocked)))
    marks = [F.transform("keys", lambda k: _marks(k)[0]).alias("a"),
             F.transform("keys", lambda k: _marks(k)[1]).alias("b")]
    out = T.StructType([
        T.StructField("documentId", rows.schema["documentId"].dataType),
        *[T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, blocked = ([Level(*parts) for parts in levels] for levels in shared.value)
        for batch in batches:
            names, first, second = (batch.column(i) for i in (3, 4, 5))
            row = np.asarray(pc.list_parent_indices(names))
            a, b = first.flatten().to_numpy(), second.flatten().to_numpy()
            on = np.flatnonzero(_members(listed, a, b))
            row, place = np.unique(row[on], return_index=True)  # keys are longest first
            chosen = on[place]
            block = _members(blocked, a[chosen], b[chosen])
            rule = np.full(batch.num_rows, None, object)
            verdict = np.full(batch.num_rows, "allow", object)
            rule[row] = names.flatten().take(pa.array(chosen)).to_pylist()
            verdict[row[block]] = "block"
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=out.names)

    return parted.select("documentId", "host", "path", "keys", *marks).mapInArrow(run, out)
