"""Small Column helpers shared by all operators. No UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex import fixed_values as fv


def trimmed(text: Column) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.btrim(text, F.lit(fv.WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(trimmed(text) == "", F.lit(True))


def round_half_up(value: Column, digits: int = 2) -> Column:
    """Round half up on the binary value, the same in every engine."""
    scale = 10**digits
    return F.floor(value * scale + 0.5) / F.lit(float(scale))


def rate(numerator: Column, denominator: Column) -> Column:
    """Rounded share, null when there is nothing to divide by."""
    return F.when(denominator > 0, round_half_up(numerator / denominator))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once so that ``body`` may use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keywords(text: Column) -> Column:
    """Distinct lower-case words of five letters or more, minus filler words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(fv.KEYWORD), F.lit(1))
    return F.array_except(words, F.array(*[F.lit(w) for w in fv.STOP_WORDS]))


# --- growing a list inside aggregate() -----------------------------------------
# Appending to an array copies it, so a plain append is quadratic in the number
# of items. Items are collected in a short tail that is moved as a whole to the
# list of full blocks, which keeps the copying small for very long documents.
_BLOCK_ITEMS = 64


def list_start() -> list[Column]:
    """The two accumulator fields of an empty growing list."""
    return [
        F.array().cast("array<array<string>>").alias("blocks"),
        F.array().cast("array<string>").alias("tail"),
    ]


def list_append(acc: Column, items: Column) -> list[Column]:
    """The two accumulator fields after appending an array of items."""
    full = F.size(acc["tail"]) >= _BLOCK_ITEMS
    return [
        F.when(full, F.concat(acc["blocks"], F.array(acc["tail"])))
        .otherwise(acc["blocks"]).alias("blocks"),
        F.when(full, items).otherwise(F.concat(acc["tail"], items)).alias("tail"),
    ]


def list_items(acc: Column) -> Column:
    return F.concat(F.flatten(acc["blocks"]), acc["tail"])
