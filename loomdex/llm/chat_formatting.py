"""Minimum-cost repair of the roles of a conversation, and its rendering.

A legal conversation has an optional system turn, then user and assistant turns in
alternation, the user first. Every source turn moves an automaton over the last role by a
4 x 4 table of costs; the cheapest sequence of merges, relabels and empty insertions is a
shortest path, found by dynamic programming. Tables multiply (as minimum and sum), so
that a long conversation is cut into ranges of turns which are solved apart: first the
tables of the ranges, level by level, then the roles at their borders, then the turns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.partitions import sorted_groups
from loomdex.session import checkpointed

ROLES = ("", "system", "user", "assistant")     # the automaton's states; "" is the start
FOLLOWING = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
MERGE, INSERT, RELABEL, NAME = 1, 2, 3, 1       # costs; NAME: give an unknown role a name
RANGE_TURNS = 256           # turns, or ranges, that one step looks at together
OPEN, CLOSE = "<|im_start|>{role}\n", "<|im_end|>\n"
_FAR = 1 << 40


def _moves() -> dict[int, dict[tuple[int, int], tuple[int, tuple[int, ...], bool]]]:
    """Per source role (0: unknown): (state, next state) -> (cost, inserted roles, merged).

    Of equally cheap moves the one with fewer insertions is taken, then the merge.
    """
    out: dict = {}
    for role in range(4):
        best: dict = {}

        def offer(a, b, cost, inserted, merged):
            move = (cost, inserted, merged)
            if (a, b) not in best or (cost, len(inserted), not merged, inserted) < (
                    best[a, b][0], len(best[a, b][1]), not best[a, b][2], best[a, b][1]):
                best[a, b] = move

        for a in range(4):
            paths = [((), a)]
            for path, last in paths:
                if len(path) < 2:
                    paths += [((*path, n), n) for n in FOLLOWING[last]]
            for path, last in paths:
                for b in (1, 2, 3):
                    own = 0 if b == role else NAME if role == 0 else RELABEL
                    if b in FOLLOWING[last]:
                        offer(a, b, own + INSERT * len(path), path, False)
                    if b == last and last and not path:
                        offer(a, b, own + MERGE, path, True)
        out[role] = best
    return out


MOVES = _moves()
TABLES = np.full((4, 4, 4), _FAR, np.int64)
for _role, _best in MOVES.items():
    for (_a, _b), _move in _best.items():
        TABLES[_role, _a, _b] = _move[0]


def _product(tables: np.ndarray) -> np.ndarray:
    """The table of a sequence of tables, by halves."""
    while len(tables) > 1:
        if len(tables) % 2:
            same = np.full((1, 4, 4), _FAR, np.int64)
            same[0, range(4), range(4)] = 0
            tables = np.concatenate([tables, same])
        tables = np.minimum((tables[::2, :, :, None] + tables[1::2, None, :, :]).min(2), _FAR)
    return tables[0]


def _path(tables: np.ndarray, start: int, end: int) -> list[int]:
    """The states before, between and after the tables of a cheapest way; small ones first."""
    ahead = np.full((len(tables) + 1, 4), _FAR, np.int64)
    ahead[-1, end] = 0
    for i in range(len(tables) - 1, -1, -1):
        ahead[i] = np.minimum((tables[i] + ahead[i + 1]).min(1), _FAR)
    states = [start]
    for i in range(len(tables)):
        states.append(int(np.argmin(tables[i, states[-1]] + ahead[i + 1])))
    return states


def _role(name: str | None) -> int:
    name = (name or "").strip().lower()
    return ROLES.index(name) if name in ROLES else 0


def _sorted_ranges(rows: DataFrame, *order: str | Column) -> DataFrame:
    return rows.repartition("id", "range").sortWithinPartitions("id", "range", *order)


def _turn_order() -> list[str | Column]:
    return [F.col("turn").asc_nulls_last(), "role", "text"]


def _range_tables(turns: DataFrame, kind: str) -> DataFrame:
    """id, range, costs: the table of every range of turns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 2):
            roles = [_role(r) for r in group["role"].to_pylist()]
            yield _one(group, _product(TABLES[roles]))

    return _sorted_ranges(turns, *_turn_order()).select("id", "range", "role").mapInArrow(
        run, f"id {kind}, range long, costs array<long>")


def _one(group: pa.Table, table: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [group["id"].combine_chunks().slice(0, 1), group["range"].combine_chunks().slice(0, 1),
         pa.array([table.reshape(-1).tolist()], pa.list_(pa.int64()))],
        names=["id", "range", "costs"])


def _of(group: pa.Table) -> np.ndarray:
    return np.array(group["costs"].to_pylist(), np.int64).reshape(-1, 4, 4)


def _borders(tables: DataFrame, kind: str) -> DataFrame:
    """id, range, start, end, final: the states at the borders of every range of turns."""
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 2):
            yield _one(group, _product(_of(group)))

    names = ["id", "range", "start", "end", "final"]
    out = f"id {kind}, range long, start int, end int, final boolean"

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 2):
            states = _path(_of(group), group["start"][0].as_py(), group["end"][0].as_py())
            final = np.zeros(group.num_rows, bool)
            final[-1] = group["final"][0].as_py()
            yield pa.RecordBatch.from_arrays(
                [group["id"].combine_chunks(), group["below"].combine_chunks(),
                 pa.array(states[:-1], pa.int32()), pa.array(states[1:], pa.int32()),
                 pa.array(final)], names=names)

    above = F.floor(F.col("range") / F.lit(RANGE_TURNS)).cast("long")
    levels = [checkpointed(tables)]
    while (levels[-1].agg(F.max("range")).first()[0] or 0) > 0:
        children = levels[-1].select("id", above.alias("range"), F.col("range").alias("below"), "costs")
        levels.append(checkpointed(_sorted_ranges(children, "below").select(
            "id", "range", "costs").mapInArrow(joined, f"id {kind}, range long, costs array<long>")))
    at_user, at_assistant = F.get("costs", F.lit(2)), F.get("costs", F.lit(3))
    borders = levels.pop().select(
        "id", "range", F.lit(0).alias("start"),
        F.when(at_user <= at_assistant, 2).otherwise(3).alias("end"), F.lit(True).alias("final"))
    while levels:
        parents = borders.select(F.col("id").alias("_id"), F.col("range").alias("_range"),
                                 "start", "end", "final")
        children = levels.pop().select(
            "id", above.alias("range"), F.col("range").alias("below"), "costs")
        met = children.join(parents, F.col("id").eqNullSafe(F.col("_id")) & (F.col("range") == F.col("_range")))
        borders = _sorted_ranges(met, "below").select(
            "id", "range", "below", "costs", "start", "end", "final").mapInArrow(parted, out)
    return borders


def _text(text: str | None) -> str:
    return (text or "").replace("<|im_", "<| im_")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in sorted_groups(batches, 2):
        roles = [_role(r) for r in group["role"].to_pylist()]
        states = _path(TABLES[roles], group["start"][0].as_py(), group["end"][0].as_py())
        actions, named, costs, pieces = [], [], [], []
        for role, text, a, b in zip(roles, group["text"].to_pylist(), states, states[1:]):
            cost, inserted, merged = MOVES[role][a, b]
            action = "+".join(["relabel"] * (b != role) + ["merge"] * merged) or "keep"
            actions.append("insert " * bool(inserted) + action)
            named.append(ROLES[b])
            costs.append(cost)
            empty = "".join(OPEN.format(role=ROLES[r]) + CLOSE for r in inserted)
            head = "\n" if merged else CLOSE * (a != 0) + empty + OPEN.format(role=ROLES[b])
            pieces.append(head + _text(text))
        if group["final"][0].as_py():
            pieces[-1] += CLOSE
        yield pa.RecordBatch.from_arrays(
            [group["id"].combine_chunks(), group["turn"].combine_chunks(),
             group["role"].combine_chunks(), pa.array(actions), pa.array(named),
             pa.array(costs, pa.int64()), pa.array(pieces, pa.string())],
            names=["id", "turn", "role", "action", "repairedRole", "cost", "rendered"])


def repaired(turns: DataFrame) -> DataFrame:
    """id, turn, role, action, repairedRole, cost and rendered, one row per source turn.

    ``turns``: ``id`` of the conversation, ``turn`` (its order), ``role``, ``text``; other
    columns are ignored. The library's own records have one question and one answer each,
    so this operator is general. ``rendered`` holds what the turn adds to the text of the
    conversation: joined in the order of the rows (turn, null last; then role and text)
    the pieces are the repaired conversation, one block per legal turn. ``action`` is keep,
    relabel, merge or relabel+merge, behind ``insert `` where empty turns come before it.
    A conversation may end after a user's turn. Roles are compared without case and outer
    blanks; null and unknown ones are named at a low cost. Null texts are empty; markers
    of the format inside texts are broken by a blank. Repeated rows are turns of their own;
    rows without an id are one conversation.
    """
    turns = turns.select("id", F.col("turn").cast("long").alias("turn"), "role", "text")
    kind = turns.schema["id"].dataType.simpleString()
    low, high = turns.agg(
        F.coalesce(F.min("turn"), F.lit(0)), F.coalesce(F.max("turn"), F.lit(0))).first()
    place = F.coalesce(F.col("turn") - F.lit(low), F.lit(high - low + 1))
    turns = turns.withColumn("range", F.floor(place / F.lit(RANGE_TURNS)).cast("long"))
    borders = _borders(_range_tables(turns, kind), kind).select(
        F.col("id").alias("_id"), F.col("range").alias("_range"), "start", "end", "final")
    rows = turns.join(borders, F.col("id").eqNullSafe(F.col("_id")) & (F.col("range") == F.col("_range")))
    return _sorted_ranges(rows, *_turn_order()).select(
        "id", "range", "start", "end", "final", "turn", "role", "text",
    ).mapInArrow(_rendered, f"id {kind}, turn long, role string, action string, "
                            "repairedRole string, cost long, rendered string")
