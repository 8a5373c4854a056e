"""Which documents contain which passages, as an equi-join on keys of words.

A passage may begin and end inside a word of the document, but its inner words, all but the
first and the last one, stand in the document as they are. Its key is a hash of inner words:

* 11 inner words or more: the smallest hash of four consecutive words within the first 11.
  Documents select the smallest of every eight neighbouring hashes, so they have the same one;
* 2 inner words or more: the first two. Documents have a key per two neighbouring words;
* fewer: the first characters, three at most, of the longest word;
* white space only: the first character.

Documents make keys of a kind only if a passage has it. Who meets is compared in full, so the
result is exact; a key that very many passages share costs a comparison for each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import let
from loomdex.session import written

SPACE = " \t\n\x0b\x0c\r"
RUN, CHOICE = 4, 8          # words in a hash, neighbouring hashes of which one is kept
SHORT_RUN = 2
LONG_KIND, SHORT_KIND, BLANK_KIND = 5, 4, 0     # kinds 1 to 3: so many characters


def words_of(text: Column) -> Column:
    return F.split(text, f"[{SPACE}]+", -1)


def _over_runs(values: Column, n: int, combine: Callable[[Column, Column], Column]) -> Column:
    """``combine`` over every n neighbouring values, n a power of two; none where there are fewer.

    Each pass over the array doubles the length of the runs, so no run is cut out by itself.
    """
    def doubled(runs: Column, length: int) -> Column:
        return let(runs, lambda r: F.zip_with(
            r, F.slice(r, length + 1, F.size(r)), lambda left, right: combine(left, right)))

    length = 1
    while length < n:
        values, length = doubled(values, length), 2 * length
    return let(values, lambda v: F.slice(v, 1, F.greatest(F.size(v) - (n - 1), F.lit(0))))


def _hashed_runs(words: Column, n: int) -> Column:
    return _over_runs(F.transform(words, lambda w: F.xxhash64(w)), n, F.xxhash64)


def _chosen(hashes: Column) -> Column:
    return _over_runs(hashes, CHOICE, F.least)


def _document_keys(text: Column, kind: int) -> Column:
    if kind == LONG_KIND:
        return F.array_distinct(_chosen(_hashed_runs(words_of(text), RUN)))
    if kind == SHORT_KIND:
        return F.array_distinct(_hashed_runs(words_of(text), SHORT_RUN))
    if kind == BLANK_KIND:
        signs = F.array(*[F.lit(s) for s in SPACE])
        return F.transform(F.filter(signs, lambda s: F.contains(text, s)), lambda s: F.xxhash64(s))
    # a look-ahead passes over the text once, however long its words are
    grams = F.regexp_extract_all(text, F.lit(f"(?=([^{SPACE}]{{{kind}}}))"), F.lit(1))
    return F.transform(F.array_distinct(grams), lambda g: F.xxhash64(g))


def _passage_keys(passages: DataFrame, text: str) -> DataFrame:
    """The passages with ``__kind`` and ``__key``; null and empty ones drop out."""
    rows = passages.filter(F.col(text) != "").withColumn("__words", words_of(F.col(text)))
    inner = F.slice("__words", 2, F.greatest(F.size("__words") - 2, F.lit(0)))
    longest = F.array_max(F.transform("__words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    rows = rows.withColumns({"__inner": inner, "__longest": longest["w"]})
    kind = (
        F.when(F.size("__inner") >= RUN + CHOICE - 1, LONG_KIND)
        .when(F.size("__inner") >= SHORT_RUN, SHORT_KIND)
        .otherwise(F.least(F.length("__longest"), F.lit(3))))
    key = (
        F.when(F.col("__kind") == LONG_KIND, F.get(_chosen(_hashed_runs(F.col("__inner"), RUN)), F.lit(0)))
        .when(F.col("__kind") == SHORT_KIND, F.get(_hashed_runs(F.col("__inner"), SHORT_RUN), F.lit(0)))
        .when(F.col("__kind") == BLANK_KIND, F.xxhash64(F.left(F.col(text), F.lit(1))))
        .otherwise(F.xxhash64(F.substring("__longest", F.lit(1), F.col("__kind")))))
    return rows.withColumn("__kind", kind).withColumn("__key", key).drop("__words", "__inner", "__longest")


def containing_documents(documents: DataFrame, passages: DataFrame, *,
                         document_id: str = "documentId", text: str = "text",
                         passage_id: str = "id", passage: str = "question",
                         payload: Sequence[str] = ()) -> DataFrame:
    """passage id, document id and ``payload`` columns of the document, for every pair in
    which the document's text contains the passage.

    The two id columns have different names, and document ids are unique. Null texts contain
    nothing; null and empty passages are in no document. Repeated passages each have rows.
    """
    keyed = written(_passage_keys(passages.select(passage_id, passage), passage))
    kinds = sorted(row[0] for row in keyed.select("__kind").distinct().collect())   # six at most

    def of_kind(kind: int) -> Column:
        return F.transform(_document_keys(F.col(text), kind), lambda key: F.struct(
            F.lit(kind).alias("__kind"), key.alias("__key")))

    arrays = [of_kind(kind) for kind in kinds]
    if not arrays:
        return documents.join(passages.select(passage_id), F.lit(False)).select(
            passage_id, document_id, *payload)
    keys = documents.filter(F.col(text).isNotNull()).select(document_id, F.inline(F.concat(*arrays)))
    # ids only; written, so that a small table of candidates is known to be small and texts
    # are not shuffled for it
    met = written(keys.join(keyed.drop(passage), ["__kind", "__key"]).select(document_id, passage_id))
    # written too: the size of a join is taken for the product of both, and texts would move to it
    asked = written(met.join(
        keyed.select(passage_id, passage).withColumnRenamed(passage, "__passage"), passage_id))
    return (
        documents.select(document_id, F.col(text).alias("__text"), *payload).join(asked, document_id)
        .filter(F.contains(F.col("__text"), F.col("__passage")))
        .select(passage_id, document_id, *payload))
