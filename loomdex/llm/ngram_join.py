"""Classes of documents that share most of their five-word shingles.

Documents with equal shingle sets are one representative. Shingles have one global
order: those in very many documents last, else by hash. Two sets of similarity 0.75 share
a shingle within the first quarter of either, so representatives meet in the groups of
these shingles. Within a group a pair whose sizes, or whose shingles behind the shared one,
leave too little room cannot link by that shingle; members without a partner drop out.
Two similar sets of about one size share many shingles of these quarters, so members of
too few groups drop out too: accidental members would keep groups apart that are the same.
What is left of a group is searched with a signature tree: hierarchical nodes hold the
OR of their members' token bitmaps and their size range, and a dual traversal drops node
pairs whose largest possible overlap is too small. Remaining pairs are verified on the
exact sets. A first search links each member to its likeliest partner only; the second
looks only at groups that had other possible pairs, and skips node pairs that are in one
class already, so that a group of near copies costs about as many verifications as it
has members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomdex.llm.partitions import IdFilter, components, sorted_groups
from loomdex.llm.word_arrays import SHINGLE_WORDS, Words, memory_returned, mixed, slices
from loomdex.session import checkpointed

PERCENT = 75
HOT_SHARE = 0.0004          # shingles of a larger share of the documents come last
COUNTED_SHINGLES = 1_500_000    # that a task counts together
BLOCK_MEMBERS = 1000        # larger groups are searched in pairs of blocks of this size
FILTERED_MEMBERS = 4000     # members of larger groups all go on to the tree
SMALL_GROUP = 8             # groups up to this size are looked at together
MAX_BITS = 1 << 16          # of a bitmap; longer sets only get a weaker bound
_NEVER = 1 << 30            # more shingles than any set has
_NODE = 8                   # children of a tree node
_FRONTIER_WORDS = 1 << 20   # of the bitmaps of node pairs that are looked at together


def _needed(a, b):
    """Smallest overlap of sets of these sizes that is similar enough."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def _prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


# --- signatures -----------------------------------------------------------------
def _bitmap(shingles: np.ndarray) -> bytes:
    width = 64
    while width < min(4 * len(shingles), MAX_BITS):
        width *= 2
    bits = np.zeros(width, np.uint8)
    bits[(shingles >> np.uint64(20)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bitmap: bytes, words: int) -> np.ndarray:
    """The bitmap at another width: halves are combined, or copies are put side by side.

    Copies only add bits, so an overlap bound taken from them holds as well.
    """
    bits = np.frombuffer(bitmap, np.uint64)
    if len(bits) > words:
        return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)
    return np.tile(bits, words // len(bits))


class SignatureTree:
    """Levels of nodes over the members of a group, leaves (single members) first."""

    def __init__(
        self, sizes: np.ndarray, room: np.ndarray, bitmaps: list[bytes], classes: np.ndarray,
    ) -> None:
        """``room``: most shingles a member can share beyond those before the group's own."""
        words = int(np.median([len(b) // 8 for b in bitmaps]))
        words = 1 << (words - 1).bit_length()
        self.step = max(64, _FRONTIER_WORDS // words)
        bits = np.stack([_folded(b, words) for b in bitmaps])
        ones = np.array([int(np.bitwise_count(np.frombuffer(b, np.uint64)).sum()) for b in bitmaps])
        narrow = np.bitwise_count(bits).sum(1, dtype=np.int64)
        # Tokens beyond one per bit; a widened bitmap has no fewer tokens per own bit.
        slack = sizes - np.minimum(narrow, ones)
        self.order = np.lexsort((bits[:, 0], classes, sizes))
        o = self.order
        self.levels = [(bits[o], sizes[o], sizes[o], room[o], slack[o], classes[o], classes[o])]
        while len(self.levels[-1][0]) > 1:
            bits, low, high, room, slack, first, last = self.levels[-1]
            cuts = np.arange(0, len(bits), _NODE)
            self.levels.append((
                np.bitwise_or.reduceat(bits, cuts), np.minimum.reduceat(low, cuts),
                np.maximum.reduceat(high, cuts), np.maximum.reduceat(room, cuts),
                np.maximum.reduceat(slack, cuts),
                np.minimum.reduceat(first, cuts), np.maximum.reduceat(last, cuts)))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(member, member, largest possible overlap) of pairs that may be similar."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > self.step:
                for at in range(0, len(a), self.step):
                    stack.append((level, a[at:at + self.step], b[at:at + self.step]))
                continue
            bits, low, high, room, slack, first, last = self.levels[level]
            most = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64)
            most = np.minimum(most + np.minimum(slack[a], slack[b]), np.minimum(room[a], room[b]))
            one = (first[a] == last[a]) & (first[b] == last[b]) & (first[a] == first[b])
            keep = (most >= _needed(low[a], low[b])) & ~one
            keep &= (100 * high[a] >= PERCENT * low[b]) & (100 * high[b] >= PERCENT * low[a])
            if level == 0:
                keep &= a != b
                yield self.order[a[keep]], self.order[b[keep]], most[keep]
                continue
            a, b = a[keep], b[keep]
            below = len(self.levels[level - 1][0])
            step = np.arange(_NODE)
            left = (a[:, None, None] * _NODE + step[None, :, None] + 0 * step).reshape(-1)
            right = (b[:, None, None] * _NODE + step[None, None, :] + 0 * step[:, None]).reshape(-1)
            inside = (left <= right) & (right < below) & (left < below)
            if inside.any():
                stack.append((level - 1, left[inside], right[inside]))


# --- sketches --------------------------------------------------------------------
def _sketch(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set."""
    if not len(shingles):
        return 0, 0
    a = mixed(shingles).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mixed(shingles * np.uint64(0x9FB21C651E98DF25) + np.uint64(11)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _ordered(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The set as positive numbers in the global order: hot shingles behind all others."""
    numbers = shingles >> np.uint64(2)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
        numbers = numbers | ((hot[at] == shingles).astype(np.uint64) << np.uint64(62))
    return np.sort(numbers)


def _shingled(batches: Iterator[pa.RecordBatch]):
    """Per slice: the batch, its number of texts, and their shingle sets."""
    for piece, texts in slices(batches, 1):
        words = Words(texts, lower=True)
        windows = words.windows(SHINGLE_WORDS)
        yield piece, [words.shingles(i, windows) for i in range(len(texts))]


def _names_and_hot(documents: DataFrame, key: str) -> tuple[DataFrame, np.ndarray]:
    """documentId, n, name1, name2 of every document; and the shingles of many documents.

    Those are found in parts of the table and summed. The sum must reach HOT_SHARE of all
    documents, so there are (mean set size / HOT_SHARE) at most; what only the documents of
    one part share is not among them. They only decide how fast the groups are searched:
    any order of the shingles gives the same links.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = size = 0
        for piece, sets in _shingled(batches):
            held += sets
            rows += len(sets)
            size += sum(map(len, sets))
            sketches = [_sketch(s) for s in sets]
            yield made(piece.column(0), [len(s) for s in sets], *zip(*sketches), False)
            if size >= COUNTED_SHINGLES:
                yield often(held, rows)
                held, rows, size = [], 0, 0
        yield often(held, rows)

    def often(held: list[np.ndarray], rows: int) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
        many = n >= max(3, HOT_SHARE * rows)
        shingles = values[many].astype(np.int64)
        return made(pa.nulls(len(shingles), kind), n[many], shingles, np.zeros_like(shingles), True)

    def made(ids, n, first, second, hot) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [ids, *[pa.array(c, pa.int64()) for c in (n, first, second)],
             pa.array([hot] * len(ids), pa.bool_())], names=["documentId", "n", "name1", "name2", "hot"])

    kind = to_arrow_type(documents.schema["documentId"].dataType)
    every = checkpointed(documents.mapInArrow(
        run, f"documentId {key}, n long, name1 long, name2 long, hot boolean"))
    least = HOT_SHARE * every.filter("not hot").count()
    hot = every.filter("hot").groupBy("name1").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= F.lit(least)).select("name1").toArrow()
    return every.filter("not hot").drop("hot"), np.sort(hot["name1"].to_numpy().astype(np.uint64))


def _sketches(documents: DataFrame, key: str, hot: np.ndarray) -> DataFrame:
    """documentId, n, name1, name2, prefix and bitmap of the documents with shingles."""
    shared = documents.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for piece, sets in _shingled(batches):
            there = [i for i, s in enumerate(sets) if len(s)]
            sets = [sets[i] for i in there]
            sketches = [_sketch(s) for s in sets]
            prefixes = [_ordered(s, hot)[:_prefix_length(len(s))].tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(there, pa.int64())),
                 pa.array([len(s) for s in sets], pa.int64()),
                 *[pa.array([k[i] for k in sketches], pa.int64()) for i in (0, 1)],
                 pa.array(prefixes, pa.binary()), pa.array([_bitmap(s) for s in sets], pa.binary())],
                names=["documentId", "n", "name1", "name2", "prefix", "bitmap"])

    return documents.mapInArrow(
        run, f"documentId {key}, n long, name1 long, name2 long, prefix binary, bitmap binary")


# --- groups, pairs, links ---------------------------------------------------------
def _entries(representatives: DataFrame, key: str) -> DataFrame:
    """shingle, id, n, room: one row per shingle of a prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                yield from entries(batch.slice(at, 500))

    def entries(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        prefixes = batch.column(2).to_pylist()
        lengths = np.array([len(p) // 8 for p in prefixes], np.int64)
        shingles = np.frombuffer(b"".join(prefixes), np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        n = batch.column(1).to_numpy()[row]
        ids = batch.column(0).take(pa.array(row))
        for at in range(0, len(shingles), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shingles[part]), ids.slice(at, 100_000),
                 pa.array(n[part].astype(np.int32)), pa.array((n - place)[part].astype(np.int32))],
                names=["shingle", "id", "n", "room"])

    return representatives.select("id", "n", "prefix").mapInArrow(
        run, f"shingle long, id {key}, n int, room int")


def _with_partner(n: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Which members of a group have another one that sizes and room leave possible."""
    out = np.zeros(len(n), bool)
    for at in range(0, len(n), 256):
        part = slice(at, at + 256)
        a, b = n[part, None], n[None, :]
        fits = np.minimum(room[part, None], room[None, :]) >= _needed(a, b)
        fits[np.arange(fits.shape[0]), np.arange(at, at + fits.shape[0])] = False
        out[part] = fits.any(1)
    return out


def _small_with_partner(n: np.ndarray, room: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The same for all groups of one size that start at these rows: a row per group."""
    at = starts[:, None] + np.arange(size)
    n, room = n[at], room[at]
    fits = np.minimum(room[:, :, None], room[:, None, :]) >= _needed(n[:, :, None], n[:, None, :])
    return (fits & ~np.eye(size, dtype=bool)).any(2)


def _least_shared(
    n: np.ndarray, room: np.ndarray, others: np.ndarray, others_room: np.ndarray, same: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Of members (second last axis) against others (last): is one near in size; and the fewest
    shingles that the prefixes of member and a possible partner share.

    Of the prefix that ends first all but n - needed shingles are in the other set, and
    so in its prefix.
    """
    needed = _needed(n, others)
    near = (np.minimum(n, others) >= needed) & ~same
    least = np.where(near & (np.minimum(room, others_room) >= needed),
                     needed + -PERCENT * np.maximum(n, others) // 100 + 1, _NEVER)
    return near.any(-1), least.min(-1)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members with another one near in size; ``shingle`` is null where room leaves none possible.

    ``least`` is how many such groups a member has at least if it links by this one.
    """
    for table in _whole_groups(batches):
        if not table.num_rows:
            continue
        n, room = (table[c].to_numpy().astype(np.int64) for c in ("n", "room"))
        shingle = table["shingle"].to_numpy()
        starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
        sizes = np.diff(np.append(starts, len(n)))
        near, least = np.ones(len(n), bool), np.ones(len(n), np.int64)
        for size in range(2, SMALL_GROUP + 1):
            at = starts[sizes == size][:, None] + np.arange(size)
            near[at], least[at] = _least_shared(
                n[at][:, :, None], room[at][:, :, None], n[at][:, None, :], room[at][:, None, :],
                np.eye(size, dtype=bool))
        large = (sizes > SMALL_GROUP) & (sizes <= FILTERED_MEMBERS)
        for start, size in zip(starts[large].tolist(), sizes[large].tolist()):
            end = start + size
            for at in range(start, end, 256):
                part = slice(at, min(at + 256, end))
                same = np.arange(part.start, part.stop)[:, None] == np.arange(start, end)
                near[part], least[part] = _least_shared(
                    n[part, None], room[part, None], n[None, start:end], room[None, start:end], same)
        far = least == _NEVER
        out = pa.Table.from_arrays(
            [pa.array(shingle, mask=far), table["id"],
             *(pa.array(np.where(far, 0, v).astype(np.int32)) for v in (n, room, least))],
            names=["shingle", "id", "n", "room", "least"])
        yield from out.filter(pa.array(near)).to_batches()


def _id_hashes(ids: pa.ChunkedArray) -> np.ndarray:
    if pa.types.is_integer(ids.type):
        return ids.to_numpy().astype(np.int64).view(np.uint64)
    each = (hashlib.blake2b(repr(i).encode(), digest_size=8).digest() for i in ids.to_pylist())
    return np.frombuffer(b"".join(each), np.uint64)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end where a shingle ends, without the shingles that only one row has.

    Only the rows of a batch and of a group that goes beyond it are held at a time.
    """
    def repeated(table: pa.Table) -> pa.Table:
        shingle = table["shingle"].to_numpy()
        same = shingle[1:] == shingle[:-1]
        return table.filter(pa.array(np.append(same, False) | np.append(False, same)))

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        shingle = batch.column(0).to_numpy()
        cut = int(np.searchsorted(shingle, shingle[-1]))
        if cut or held and held[0]["shingle"][0].as_py() != int(shingle[-1]):
            yield repeated(pa.concat_tables([*held, table.slice(0, cut)]))
            held = []
        held.append(table.slice(cut))
    if held:
        yield repeated(pa.concat_tables(held))
    held.clear()
    memory_returned()


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members that may have a partner; how many, and two values that stand for who they are."""
    for table in _whole_groups(batches):
        if not table.num_rows:
            continue
        n, room = (table[c].to_numpy().astype(np.int64) for c in ("n", "room"))
        keep = np.ones(len(n), bool)
        shingle = table["shingle"].to_numpy()
        starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
        sizes = np.diff(np.append(starts, len(n)))
        for size in range(2, SMALL_GROUP + 1):
            of_size = starts[sizes == size]
            keep[of_size[:, None] + np.arange(size)] = _small_with_partner(n, room, of_size, size)
        large = (sizes > SMALL_GROUP) & (sizes <= FILTERED_MEMBERS)
        for start, size in zip(starts[large].tolist(), sizes[large].tolist()):
            part = slice(start, start + size)
            keep[part] = _with_partner(n[part], room[part])
        table, shingle = table.filter(pa.array(keep)), shingle[keep]
        if not len(shingle):
            continue
        starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
        sizes = np.diff(np.append(starts, len(shingle)))
        ids = _id_hashes(table["id"])
        who = np.bitwise_xor.reduceat(mixed(ids), starts)
        also = np.add.reduceat(mixed(ids * np.uint64(0x9FB21C651E98DF25) + np.uint64(11)), starts)
        for name, values in (("members", sizes), ("who", who.view(np.int64)), ("also", also.view(np.int64))):
            table = table.append_column(name, pa.array(np.repeat(values, sizes)))
        yield from table.to_batches()


def _groups(documents: DataFrame, key: str, hot: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """shingle, id, n, room, members: the groups to search; and id, bitmap.

    Of groups with the same members only that of the first shingle is kept: where it is
    not the first shingle that two members share, another group has both of them.
    """
    representatives = checkpointed(_sketches(documents, key, hot).groupBy("name1", "name2").agg(
        F.min("documentId").alias("id"), F.first("n").alias("n"),
        F.first("prefix").alias("prefix"), F.first("bitmap").alias("bitmap")))
    # Every entry is shuffled once; most have no other of their shingle and end there.
    possible = _entries(representatives, key).repartition("shingle").sortWithinPartitions(
        "shingle").mapInArrow(_possible, f"shingle long, id {key}, n int, room int, least int")
    # a window holds the prefix of one set
    met = F.count(F.lit(1)).over(Window.partitionBy("id"))
    likely = possible.withColumn("met", met).filter(
        F.col("shingle").isNotNull() & (F.col("met") >= F.col("least"))).select("shingle", "id", "n", "room")
    partnered = likely.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(
        _partnered, f"shingle long, id {key}, n int, room int, members long, who long, also long")
    chosen = partnered.groupBy("who", "also", "members").agg(F.min("shingle").alias("shingle"))
    light = partnered.drop("who", "also").join(chosen.select("shingle"), "shingle", "left_semi")
    return checkpointed(light), representatives.select("id", "bitmap")


def _candidates(members: DataFrame, bitmaps: DataFrame, key: str, spanning: bool) -> DataFrame:
    """Pairs (a, b) of ids whose bitmaps leave room for a link; ``class`` differs.

    ``spanning``: the best partner of each member only; ``shingle`` is set where the group
    has other pairs. Large groups are cut into blocks; a spanning search looks within
    blocks, a full one at all pairs of blocks.
    """
    blocks = F.ceil(F.col("members") / F.lit(BLOCK_MEMBERS)).cast("int")
    rows = members.join(bitmaps, "id").withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    if spanning:
        rows = rows.withColumn("pair", F.col("block").cast("long"))
    else:
        other = F.sequence(F.lit(0), F.col("blocks") - 1)
        rows = rows.withColumn("pair", F.explode(F.transform(other, lambda j: (
            F.least(j, F.col("block")).cast("long") * F.col("blocks") + F.greatest(j, F.col("block"))))))
    rows = rows.select("shingle", "pair", "id", "n", "room", "bitmap", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 2):
            if group.num_rows < 2:
                continue
            classes = group["class"].to_numpy()
            if (classes == classes[0]).all():
                continue
            sizes, room = (group[c].to_numpy().astype(np.int64) for c in ("n", "room"))
            tree = SignatureTree(sizes, room, group["bitmap"].to_pylist(), classes)
            best: dict[int, tuple[float, int]] = {}
            left, right, possible = [], [], 0
            for a, b, most in tree.pairs():
                possible += len(a)
                if spanning:
                    share = most / (sizes[a] + sizes[b])
                    for x, y, s in zip(a.tolist(), b.tolist(), share.tolist()):
                        best[x] = max(best.get(x, (0.0, -1)), (s, y))
                else:
                    left.append(a)
                    right.append(b)
            if spanning:
                taken = sorted({(min(x, y), max(x, y)) for x, (_, y) in best.items()})
                left, right = (np.array([p[i] for p in taken], np.int64)[None] for i in (0, 1))
                possible -= len(taken)
            ids, shingle = group["id"].combine_chunks(), group["shingle"][0].as_py()
            for a, b in zip(left, right):
                if len(a):
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(a)), ids.take(pa.array(b)),
                         pa.array([shingle if possible else None] * len(a), pa.int64())],
                        names=["a", "b", "shingle"])

    found = rows.repartition("shingle", "pair").sortWithinPartitions("shingle", "pair").mapInArrow(
        run, f"a {key}, b {key}, shingle long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shingle")


def _room_left(left: np.ndarray, right: np.ndarray) -> int:
    """Shared values, where a value met several times counts as often."""
    a, b = (np.sort(v).astype(np.int64) for v in (left, right))
    a, b = (v + ((np.arange(len(v)) - np.searchsorted(v, v)) << 16) for v in (a, b))
    return len(np.intersect1d(a, b, assume_unique=True))


def _verified(documents: DataFrame, pairs: DataFrame, key: str, exact: bool) -> DataFrame:
    """The pairs whose sets are similar enough; by 16 bits of each shingle, or exactly.

    Sixteen bits can only make sets more similar, and are a quarter of what is shuffled.
    """
    pairs = checkpointed(pairs.select("a", "b").distinct())
    kind = np.uint64 if exact else np.uint16

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, found in _shingled(batches):
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array([s.astype(kind).tobytes() for s in found], pa.binary())],
                names=["id", "set"])

    met = IdFilter(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    known = met.keep(documents, "documentId", then=sets, schema=f"id {key}, set binary")
    rows = pairs.join(known.select(F.col("id").alias("a"), F.col("set").alias("left")), "a").join(
        known.select(F.col("id").alias("b"), F.col("set").alias("right")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), kind) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True)) if exact else _room_left(x, y)
                keep.append(100 * shared >= PERCENT * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.select("a", "b", "left", "right").mapInArrow(run, f"a {key}, b {key}")


def _links(documents: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    return _verified(documents, _verified(documents, pairs, key, False), key, True)


def linked(documents: DataFrame) -> DataFrame:
    """documentId, nShingles and componentId of every document.

    ``documents``: document records (``documentId`` of any ordered type, ``text``); other
    columns are ignored. Words are runs without ASCII white space, A-Z lower-cased; a set
    has the distinct five-word shingles, with fewer words the whole sequence. Documents
    link when 100 x shared >= 75 x united; componentId is the smallest documentId
    reachable. Null, empty and wordless texts have no shingles and link with nothing.
    Rows that share a documentId are one document and share its class. A null documentId
    names no document: such rows get their nShingles, link with nothing, and have a null
    componentId.
    """
    documents = documents.select("documentId", "text")
    key = documents.schema["documentId"].dataType.simpleString()
    named, hot = _names_and_hot(documents, key)
    documents = documents.filter(F.col("documentId").isNotNull())
    members, bitmaps = _groups(documents, key, hot)
    alone = members.withColumn("class", F.xxhash64("id"))
    found = checkpointed(_candidates(alone, bitmaps, key, True))
    first = checkpointed(_links(documents, found, key))
    classes = components(first)
    # Groups whose possible pairs are all among the found ones are done.
    unfinished = found.select("shingle").dropna().distinct().withColumn("more", F.lit(True))
    members = members.join(unfinished, "shingle", "left").filter(
        F.col("more") | (F.col("members") > BLOCK_MEMBERS)).drop("more")
    classed = members.join(classes, "id", "left").withColumn(
        "class", F.xxhash64(F.coalesce("component", "id"))).drop("component")
    mixed_groups = classed.groupBy("shingle").agg(
        F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high")
    classed = classed.join(mixed_groups.select("shingle"), "shingle", "left_semi")
    second = _links(documents, _candidates(classed, bitmaps, key, False), key)
    final = components(first.union(second))
    holders = named.filter("n > 0 and documentId is not null").groupBy("name1", "name2").agg(F.min("documentId").alias("id"))
    holders = holders.join(final, "id", "left").select(
        F.col("name1").alias("_1"), F.col("name2").alias("_2"),
        F.coalesce("component", "id").alias("component"))
    return named.join(
        holders, (F.col("n") > 0) & F.col("documentId").isNotNull() & (F.col("name1") == F.col("_1")) & (F.col("name2") == F.col("_2")),
        "left",
    ).select("documentId", F.col("n").alias("nShingles"),
             F.coalesce("component", "documentId").alias("componentId"))


def representatives(documents: DataFrame) -> DataFrame:
    """The document rows, with all their columns, that ``linked`` names as their class.

    Only rows whose documentId may belong to a dropped copy are shuffled.
    """
    classes = linked(documents)
    dropped = checkpointed(
        classes.filter(F.col("documentId") != F.col("componentId")).select("documentId").distinct())
    found = IdFilter(dropped)
    return found.keep(documents, "documentId", met=False).unionByName(
        found.keep(documents, "documentId").join(dropped, "documentId", "left_anti").select(
            documents.columns))
