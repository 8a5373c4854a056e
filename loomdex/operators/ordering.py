"""Numbers in a total order without a single-task sort.

Rows are cut into ranges of their order, each range is sorted by itself and written once
with the place of every row in it. The rows per range, one number per partition, are summed
up, and a row's number is the sum of the ranges before plus its place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.session import written

_RANGE, _PLACE, _TIE = "__range", "__place", "__tie"


def _placed(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The rows with range and place in it, and (range, rows before it), ascending."""
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A key that very many rows share is cut between ranges too.
    by = [*order, _TIE]
    placed = written(
        rows.withColumn(_TIE, F.xxhash64(*rows.columns))
        .repartitionByRange(partitions, *by).sortWithinPartitions(*by)
        .withColumn("__id", F.monotonically_increasing_id())
        .withColumn(_RANGE, F.shiftright("__id", 33).cast("int"))
        .withColumn(_PLACE, F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", _TIE))
    before, total = [], 0
    for part, n in sorted(map(tuple, placed.groupBy(_RANGE).count().collect())):
        before.append((part, total))
        total += n
    return placed, before


def _with_number(placed: DataFrame, before: list[tuple[int, int]], name: str) -> DataFrame:
    offsets = placed.sparkSession.createDataFrame(before, f"{_RANGE} int, __before long")
    columns = [c for c in placed.columns if c not in (_RANGE, _PLACE)]
    return placed.join(F.broadcast(offsets), _RANGE).select(
        *columns, (F.col("__before") + F.col(_PLACE)).alias(name))


def numbered(rows: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """The rows with their place, from 0, in the ascending order of ``order`` (nulls first).

    Ties are in the order of a hash of the whole row. Equal rows have numbers of their own.
    """
    return _with_number(*_placed(rows, order), name)


def first_in_order(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows, spread over as many tasks as they fill ranges.

    Ranges beyond the last one needed are not read again.
    """
    placed, before = _placed(rows, order)
    needed = [b for b in before if b[1] < n]
    kept = placed.filter(F.col(_RANGE) <= (needed[-1][0] if needed else -1))
    return _with_number(kept, needed, "__number").filter(F.col("__number") < n).drop("__number")
