"""Splitting one text into overlapping pieces, as a native Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.functions.text import let, list_append, list_items, list_start, trimmed


def check_chunk_config(size: int, overlap: int) -> None:
    """Reject impossible settings before any job starts."""
    if isinstance(size, bool) or not isinstance(size, int) or size <= 0:
        raise ValueError(f"chunk size must be a positive integer, got {size!r}")
    if isinstance(overlap, bool) or not isinstance(overlap, int) or overlap < 0:
        raise ValueError(f"overlap must be an integer >= 0, got {overlap!r}")
    if overlap >= size:
        raise ValueError(f"overlap ({overlap}) must be smaller than chunk size ({size})")


def carried_tail(text: Column, overlap: int) -> Column:
    """The end of a piece that is repeated at the start of the next one.

    It begins at a line start when the tail has a line break inside it.
    """
    if overlap == 0:
        return F.lit("")

    def from_line_start(tail: Column) -> Column:
        line_break = F.instr(tail, "\n")
        inside = (line_break >= 2) & (line_break < overlap)
        return F.when(inside, F.substr(tail, line_break + 1)).otherwise(tail)

    tail = F.substring(text, -overlap, overlap)
    return F.when(F.length(text) <= overlap, "").otherwise(let(tail, from_line_start))


def _joined(head: Column, line: Column) -> Column:
    return F.when(head == "", line).otherwise(F.concat(head, F.lit("\n"), line))


def chunk_texts(text: Column, size: int, overlap: int) -> Column:
    """``array<string>`` of the pieces of a text, packed greedily line by line.

    Whole lines are packed up to ``size`` characters; a line longer than that is
    cut every ``size`` characters. Each piece after a cut starts with the carried
    tail of the one before, so a piece may exceed ``size`` by ``overlap`` + 1.
    """
    check_chunk_config(size, overlap)
    none = F.array().cast("array<string>")

    def pieces(line: Column) -> Column:
        # one linear regex pass; substring() at growing offsets would be quadratic
        cut = F.regexp_extract_all(line, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
        return F.transform(cut, trimmed)

    def add_line(acc: Column, line: Column) -> Column:
        current = acc["current"]
        pending = F.when(trimmed(current) != "", F.array(trimmed(current))).otherwise(none)
        long_line = F.length(line) > size
        joint = F.when(current == "", 0).otherwise(1)
        overflow = (F.length(current) + joint + F.length(line) > size) & (trimmed(current) != "")
        emitted = (
            F.when(long_line, F.concat(pending, pieces(line)))
            .when(overflow, pending)
            .otherwise(none)
        )
        following = (
            F.when(long_line, carried_tail(line, overlap))
            .when(overflow, let(carried_tail(current, overlap), lambda head: _joined(head, line)))
            .otherwise(_joined(current, line))
        )
        return F.struct(*list_append(acc, emitted), following.alias("current"))

    def finish(acc: Column) -> Column:
        rest = trimmed(acc["current"])
        return F.concat(list_items(acc), F.when(rest != "", F.array(rest)).otherwise(none))

    start = F.struct(*list_start(), F.lit("").alias("current"))
    return F.aggregate(F.split(text, "\n", -1), start, add_line, finish)
