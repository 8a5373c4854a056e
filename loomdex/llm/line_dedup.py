"""Removal of repeated runs of lines by winnowing. DataFrame functions only.

Every window of RUN_LINES consecutive lines selects the line with the smallest hash, so
equal windows select equal lines and a run of that length that occurs twice is sure to
share a fingerprint. Fingerprints met at one place only are dropped. The positions of the
others are joined and extended both ways by the windows that selected them: a window
whose lines also start earlier is a later copy, and such windows together cover the
later repeated runs, which are deleted. A repeated line whose neighbours are not repeated
with it is no run and stays, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import let

RUN_LINES = 2
_BLANKS = " \t\v\f\r"       # a line of these alone is blank


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _row() -> Column:
    return F.xxhash64("documentId", "text")


def _has_words(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANKS)) != ""


def _windows(run_lines: int) -> Column:
    """Per window of ``hashes``: start, two hashes of its lines, fingerprint and its place."""

    def window(start: Column) -> Column:
        def made(part: Column) -> Column:
            return F.struct(
                start.alias("start"), F.array_min(part).alias("fingerprint"),
                (start + F.array_position(part, F.array_min(part)) - 1).alias("place"),
                F.xxhash64(part).alias("content"),
                F.xxhash64(F.lit(run_lines), F.reverse(part)).alias("check"),
            )

        return let(F.slice("hashes", start + 1, run_lines), made)

    last = F.size("hashes") - F.lit(run_lines)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), window))


def repeated_windows(documents: DataFrame, run_lines: int = RUN_LINES) -> DataFrame:
    """row and start (counted in lines with words) of every window to delete.

    row is the hash of documentId and text. A window goes if the same ``run_lines`` lines
    also start earlier: under a smaller documentId, or further up under the same one, be it
    in another row. Lines are compared without blanks at their ends; blank lines are not
    counted. Windows at the same place of rows that share a documentId do not delete each
    other. A null documentId is smaller than any.

    Every step is a sum, minimum or equality, so that a line or passage that fills a third
    of the table combines before the shuffle or is split by the skewed join.
    """
    hashes = F.transform(F.filter(_lines(), _has_words),
                         lambda line: F.xxhash64(F.btrim(line, F.lit(_BLANKS)).cast("binary")))
    windows = (
        documents.select("documentId", _row().alias("row"), hashes.alias("hashes"))
        .select("documentId", "row", F.inline(_windows(run_lines)))
    )
    place = F.struct("documentId", "place")
    shared = (
        windows.groupBy("fingerprint").agg(F.min(place).alias("low"), F.max(place).alias("high"))
        .filter(~F.col("low").eqNullSafe(F.col("high"))).select("fingerprint")
    )
    candidates = windows.join(shared, "fingerprint", "left_semi")
    start = F.struct("documentId", "start")
    first = (
        candidates.groupBy("content", "check").agg(F.min(start).alias("first"), F.max(start).alias("last"))
        .filter(~F.col("first").eqNullSafe(F.col("last"))).select("content", "check", "first")
    )
    return (
        candidates.join(first, ["content", "check"])
        .filter(~F.col("first").eqNullSafe(start)).select("row", "start").distinct()
    )


def deduplicated(documents: DataFrame, run_lines: int = RUN_LINES) -> DataFrame:
    """The documents without later copies of runs of ``run_lines`` lines or more.

    ``documents``: document records (``documentId`` of any ordered type, ``text``). All
    columns and rows are returned, ``text`` without the deleted lines, with nLines and
    nRemovedLines (long; lines with words) behind them; columns of these names are
    replaced. Texts that lose nothing stay as they are, null and empty ones too. An exact
    copy of a document of several lines loses all of them.
    """
    starts = repeated_windows(documents.select("documentId", "text"), run_lines).groupBy("row").agg(
        F.collect_list("start").alias("starts"))
    # The columns of the input travel in one struct, so that no name of theirs can clash.
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != "text"]).alias("input"), "text",
        _row().alias("row")).join(starts, "row", "left")
    removed = F.array_distinct(F.flatten(F.transform(
        F.coalesce("starts", F.array().cast("array<int>")),
        lambda s: F.sequence(s, s + run_lines - 1))))

    def without(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        worded = F.filter(every, lambda i: _has_words(F.get(lines, i)))
        gone = let(worded, lambda places: F.transform(removed, lambda k: F.get(places, k)))
        kept = F.transform(F.array_except(every, gone), lambda i: F.get(lines, i))
        return F.struct(
            F.size(worded).cast("long").alias("nLines"), F.array_join(kept, "\n").alias("text"))

    made = rows.withColumn("made", let(_lines(), without))
    others = [c for c in documents.columns if c not in ("nLines", "nRemovedLines")]
    return made.select(
        *[F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.col("made.text"))
          .alias("text") if c == "text" else F.col("input").getField(c).alias(c) for c in others],
        F.col("made.nLines").alias("nLines"), F.size(removed).cast("long").alias("nRemovedLines"))
