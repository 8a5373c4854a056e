"""Token-id files: the ids of a corpus in order, each shard compressed by its pair grammar.

A store is a folder of two Parquet tables. ``shards`` has one row per shard: part and
shard (their order is the order of the ids), offset (ids of the part before the shard),
nIds, documentIds and nTokens of the documents in it, and content, the grammar's bytes
(see ``Grammar.to_bytes``). ``parts`` has firstId, the ids of all parts before, so any
place in the sequence leads to one shard. Ids are unsigned 32-bit numbers.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.pair_grammar import Grammar
from loomdex.llm.word_arrays import slices, worker_cached

END_ID = 0                  # closes every document
SHARD_IDS = 1 << 18         # a shard is closed when it holds so many ids
_SLICE_BYTES = 24 << 20     # of text that is cut at once
_LEARNED = 20_000           # new pieces that the library sees in one string
_REMEMBERED = 64 << 20      # bytes of pieces and their ids that a worker remembers
_OPENERS = ("\u0120", "\u010a")     # fixed values: how byte-level vocabularies write blank and line feed
_CUT = re.compile("[ \n]")
_OPEN, _SIGN = 1, 2
_KINDS = bytes(_OPEN if (c := chr(b)) in " \n" else _SIGN if c in string.punctuation and c != "'" else 0
               for b in range(256))
_ALNUM = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])


def _pieces(data: bytes) -> np.ndarray:
    """Where pieces begin in UTF-8: at blanks, line feeds, and signs behind a letter or digit.

    Letters are those of ASCII and U+00C0 to U+023F, whose first byte is C3 to C8.
    """
    raw = np.frombuffer(data, np.uint8)
    kinds = np.frombuffer(data.translate(_KINDS), np.uint8)
    places = np.flatnonzero(kinds > 0)
    opens = kinds[places] == _OPEN
    signs = places[~opens]
    before, lead = raw[signs - 1], raw[signs - 2]
    letter = (lead >= 0xC3) & (lead <= 0xC8) & (
        (lead != 0xC3) | (before != 0x97) & (before != 0xB7))    # no times, no division sign
    opens[~opens] = _ALNUM[before] | letter
    return places[opens]


def _distinct(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of every piece among the distinct ones, and these.

    Most pieces are short: up to seven bytes and their count are told apart as one number.
    """
    sizes = np.diff(starts, append=len(data))
    short = sizes < 8
    n = sizes[short].astype("<u8")
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))[starts[short]]
    coded = pa.array(eight & ((np.uint64(1) << 8 * n) - np.uint64(1)) | n << np.uint64(56)).dictionary_encode()
    raw = np.ascontiguousarray(coded.dictionary.to_numpy()).view(np.uint8).reshape(-1, 8)
    offsets = np.concatenate([[0], np.cumsum(raw[:, 7], dtype=np.int64)])
    texts = pa.Array.from_buffers(pa.large_string(), len(raw), [
        None, pa.py_buffer(offsets), pa.py_buffer(raw[np.arange(8) < raw[:, 7:]].tobytes())])
    every = pa.Array.from_buffers(pa.large_string(), len(starts), [
        None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
    rest = every.filter(pa.array(~short)).dictionary_encode()
    places = np.empty(len(starts), np.int64)
    places[short] = coded.indices.to_numpy()
    places[~short] = len(texts) + rest.indices.to_numpy().astype(np.int64)
    return places, pa.concat_arrays([texts, rest.dictionary])


class PieceEncoder:
    """Ids of whole texts by the published library, which sees each frequent piece once.

    Where the tokenizer cuts as byte-level vocabularies do, a single blank or line feed
    between two visible characters always opens a new piece of text, and of its ids only
    the first is one whose token begins with that character. An ASCII sign behind a letter
    or digit opens one too, but for the apostrophe. Texts are cut there; pieces met before
    get the ids they had, new ones are encoded in one string. Any other definition, and any
    text that holds a special token or a longer run of white space (but for one empty
    line), is encoded whole.
    """

    def __init__(self, definition: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        made = json.loads(definition)
        cut, model = made.get("pre_tokenizer") or {}, made["model"]
        self.cuts = (
            cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
            and not cut.get("add_prefix_space", True) and not made.get("normalizer")
            and model["type"] == "BPE" and not model.get("dropout"))
        self.special = [t["content"] for t in made.get("added_tokens", ())]
        names = self.library.get_vocab()
        self.opens = np.zeros(max(names.values(), default=0) + 1, bool)
        self.opens[[i for name, i in names.items() if name[:1] in _OPENERS]] = True
        # One empty line is two pieces, a single line feed at the end is one.
        self.line_feed = pa.array(["\n"], pa.large_string()), pa.array(
            [i.tobytes() for i in self._whole(["\n"])], pa.large_binary())
        self.known, self.ids = self.line_feed

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4")
                for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learned(self, new: list[str]) -> pa.Array:
        """The ids of pieces; one that begins with a sign stands behind a line feed here."""
        made, sizes = [np.zeros(0, "<u4")], [np.zeros(1, np.int64)]
        for some in (new[i:i + _LEARNED] for i in range(0, len(new), _LEARNED)):
            sign = np.fromiter((p[0] not in " \n" for p in some), bool, len(some))
            ids = self._whole(["".join([p if p[0] in " \n" else "\n" + p for p in some] + [" x"])])[0]
            ends = np.flatnonzero(self.opens[ids])
            if len(ends) != len(some) + 1:
                raise ValueError("the definition joins words over white space")
            made.append(np.delete(ids[:ends[-1]], ends[:-1][sign]))
            sizes.append(np.diff(ends) - sign)
        offsets = 4 * np.cumsum(np.concatenate(sizes))
        return pa.Array.from_buffers(pa.large_binary(), len(new), [
            None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(made))])

    def _is_whole(self, text: str) -> bool:
        return (not self.cuts or any(s in text for s in self.special) or "\n\n\n" in text
                or "\n\n " in text or text.endswith("\n\n"))

    def _remember(self, pieces: pa.Array, ids: pa.Array) -> None:
        """Add pieces; beyond the bound the worker starts afresh."""
        size = sum(a.nbytes for a in (self.known, self.ids, pieces, ids))
        known, old = (self.known, self.ids) if size <= _REMEMBERED else self.line_feed
        if size <= _REMEMBERED or pieces.nbytes + ids.nbytes <= _REMEMBERED:
            known, old = pa.concat_arrays([known, pieces]), pa.concat_arrays([old, ids])
        self.known, self.ids = known, old

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        openings, rests = list(texts), [b""] * len(texts)
        for i, text in enumerate(texts):
            first = None if self._is_whole(text) else _CUT.search(text)
            if first and not text[:first.start()][-1:].isspace():
                openings[i], rests[i] = text[:first.start()], text[first.start():].encode()
        data = b"".join(rests)
        starts = _pieces(data)
        places, pieces = _distinct(data, starts)
        # The pieces of text i are those from firsts[i] up to firsts[i + 1].
        firsts = np.searchsorted(starts, np.cumsum([0, *map(len, rests)]))
        met = pc.index_in(pieces, value_set=self.known)
        unknown = np.flatnonzero(met.is_null().to_numpy(zero_copy_only=False))
        new = pieces.take(pa.array(unknown)).to_numpy(zero_copy_only=False).tolist()
        odd = np.fromiter((p[-1].isspace() or p[1:2].isspace() for p in new), bool, len(new))
        strange = np.zeros(len(pieces), bool)
        strange[unknown[odd]] = True
        number = np.zeros(len(pieces), np.int64)    # an odd piece has any ids, its text is encoded whole
        number[~strange] = pc.fill_null(met, 0).to_numpy()[~strange]
        learned = unknown[~odd]
        number[learned] = len(self.known) + np.arange(len(learned))
        ids = self._learned([p for p, o in zip(new, odd.tolist()) if not o])
        every = pa.concat_arrays([self.ids, ids]).take(pa.array(number))
        self._remember(pieces.take(pa.array(learned)), ids)
        for i in set((np.searchsorted(firsts, np.flatnonzero(strange[places]), "right") - 1).tolist()):
            openings[i], rests[i] = texts[i], b""
        made = every.take(pa.array(places))
        ends = np.frombuffer(made.buffers()[1], np.int64, len(made) + 1)[firsts].tolist()
        body = made.buffers()[2].to_pybytes() if len(made) else b""
        return [head.tobytes() + (body[a:b] if rest else b"")
                for head, rest, a, b in zip(self._whole(openings), rests, ends, ends[1:])]


def _definition(vocabulary: str) -> str:
    with open(vocabulary, encoding="utf-8") as file:
        return file.read()


def write(documents: DataFrame, vocabulary: str, path: str, end_id: int = END_ID,
          shard_ids: int = SHARD_IDS) -> None:
    """Encode the whole texts and write the ids in ascending order of documentId.

    ``documents``: document records (``documentId`` of any ordered type, ``text``); other
    columns are ignored. ``vocabulary``: a tokenizer definition that the driver can read,
    used without truncation, padding and added special tokens. ``path``: a new folder that
    all executors share. Null and empty texts have ``end_id`` alone. Null documentIds come
    first; rows with one documentId stand in the order of their texts' hashes, and equal
    rows are written each. An empty table gives an empty store.

    The rows are cut into ranges of (documentId, hash of the text, place in the input), so
    a documentId that fills a third of the table is spread over tasks too.
    """
    spark = documents.sparkSession
    definition = spark.sparkContext.broadcast(_definition(vocabulary))
    key = documents.schema["documentId"].dataType
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["documentId", "_hash", "_place"]
    rows = (
        documents.select("documentId", "text", F.xxhash64("text").alias("_hash"),
                         F.monotonically_increasing_id().alias("_place"))
        .repartitionByRange(partitions, *order).sortWithinPartitions(*order)
        .select("documentId", "text", F.spark_partition_id().alias("part")))
    out = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("shard", T.LongType()),
        T.StructField("offset", T.LongType()), T.StructField("nIds", T.LongType()),
        T.StructField("documentIds", T.ArrayType(key)),
        T.StructField("nTokens", T.ArrayType(T.LongType())),
        T.StructField("content", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cached(("pieces", hash(definition.value)), lambda: PieceEncoder(definition.value))
        end = np.array([end_id], "<u4").tobytes()
        held: list[tuple[Any, bytes]] = []
        part = shard = offset = n = 0

        def closed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(h[1] for h in held), "<u4")
            numbers = pa.concat_arrays([h[0] for h in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int64()),
                 pa.array([offset], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(numbers)], pa.int32()), numbers),
                 pa.array([[len(h[1]) // 4 for h in held]], pa.list_(pa.int64())),
                 pa.array([Grammar.of(ids).to_bytes()], pa.binary())], names=out.names)

        for piece, texts in slices(batches, 1, _SLICE_BYTES):
            part = piece.column(2)[0].as_py()
            for i, ids in enumerate(encoder.encode([t or "" for t in texts])):
                held.append((piece.column(0).slice(i, 1), ids + end))
                n += len(held[-1][1]) // 4
                if n >= shard_ids:
                    yield closed()
                    held, shard, offset, n = [], shard + 1, offset + n, 0
        if held:
            yield closed()

    rows.mapInArrow(run, out).write.option("compression", "zstd").parquet(f"{path}/shards")
    # One sum per part: as many rows as there are partitions, whatever the corpus holds.
    sums = spark.read.parquet(f"{path}/shards").groupBy("part").agg(F.sum("nIds")).collect()
    first, total = [], 0
    for part, ids in sorted(map(tuple, sums)):
        first.append((part, total))
        total += ids
    spark.createDataFrame(first, "part int, firstId long").coalesce(1).write.parquet(f"{path}/parts")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.parquet(f"{path}/parts")
    return spark.read.parquet(f"{path}/shards").join(F.broadcast(parts), "part").withColumn(
        "start", F.col("firstId") + F.col("offset"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """documentId, start (ids of all documents before), nTokens and tokenIds of a store.

    tokenIds are little-endian unsigned 32-bit, the closing id included. One row per
    document that was written; a shard is one row and is decoded in one task.
    """
    shards = _shards(spark, path).select("start", "documentIds", "nTokens", "content")
    key = shards.schema["documentIds"].dataType.elementType
    out = T.StructType([
        T.StructField("documentId", key), T.StructField("start", T.LongType()),
        T.StructField("nTokens", T.LongType()), T.StructField("tokenIds", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sizes = batch.column(2)[row].values.to_numpy()
                ids = Grammar.from_bytes(batch.column(3)[row].as_py()).ids()
                ends = np.cumsum(sizes)
                cut = [ids[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1)[row].values, pa.array(batch.column(0)[row].as_py() + ends - sizes),
                     pa.array(sizes), pa.array(cut, pa.binary())], names=out.names)

    return shards.mapInArrow(run, out)


def read_range(spark: SparkSession, path: str, start: int, n: int) -> DataFrame:
    """start and tokenIds: the ids from place ``start`` on, ``n`` of them, by shard.

    Only shards that hold some of them are opened, and there only the symbols that cover
    the range are expanded. Places beyond the end have no ids.
    """
    wanted = _shards(spark, path).filter(
        (F.col("start") < start + n) & (F.col("start") + F.col("nIds") > start)).select("start", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = batch.column(0).to_pylist()
            made = [Grammar.from_bytes(content.as_py()).ids(max(0, start - first), start + n - first)
                    for first, content in zip(firsts, batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([max(first, start) for first in firsts], pa.int64()),
                 pa.array([ids.tobytes() for ids in made], pa.binary())], names=["start", "tokenIds"])

    return wanted.mapInArrow(run, "start long, tokenIds binary")
