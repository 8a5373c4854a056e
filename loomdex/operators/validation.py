"""Checks on vector tables before and after loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex import fixed_values as fv
from loomdex.functions.text import is_blank


def has_no_vector(vector: Column) -> Column:
    return F.coalesce(F.size(vector) == 0, F.lit(True))


def key_counts(rows: DataFrame, key: str = "chunkId") -> DataFrame:
    """Rows per key. Partial counts come first, so a hot key is one row per task."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(rows: DataFrame, key: str = "chunkId") -> DataFrame:
    return key_counts(rows, key).filter(F.col("n") > 1)


def duplicate_groups(rows: DataFrame, key: str = "chunkId") -> DataFrame:
    """How many keys occur more than once."""
    return duplicate_keys(rows, key).agg(F.count(F.lit(1)).alias("duplicates"))


def duplicate_ids(rows: DataFrame, key: str = "chunkId") -> DataFrame:
    """Rows, distinct keys and the rows beyond the first of each key."""
    return key_counts(rows, key).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.count(key).alias("unique_ids"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_rows"),
    )


def dimensions(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Every vector length that occurs, with its number of rows."""
    return rows.filter(~has_no_vector(F.col(vector))).groupBy(
        F.size(vector).alias("dimension")
    ).agg(F.count(F.lit(1)).alias("n"))


def dimension_check(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: number of distinct lengths, smallest, largest, consistent or not."""
    size = F.when(~has_no_vector(F.col(vector)), F.size(vector))
    return rows.agg(
        F.count_distinct(size).alias("dimensions"),
        F.min(size).alias("min_dim"), F.max(size).alias("max_dim"),
        (F.count_distinct(size) == 1).alias("consistent"),
    )


def input_errors(records: DataFrame, key: str = "chunkId", vector: str = "embedding",
                 text: str = "text") -> DataFrame:
    """One row per broken rule and key: missing id, duplicate id, no vector, blank text.

    A record without an id is reported for that alone. A duplicated key is
    reported once for each row beyond its first, as ``n``. Everything is counted
    per key in one aggregation, so a key with very many copies is one row per
    task after partial counting and is never gathered.
    """
    known = ~F.coalesce(F.col(key) == "", F.lit(True)) if _is_string(records, key) \
        else F.col(key).isNotNull()
    per_key = records.select(
        F.when(known, F.col(key).cast("string")).alias("id"),
        has_no_vector(F.col(vector)).cast("int").alias("no_vector"),
        is_blank(F.col(text)).cast("int").alias("blank"),
    ).groupBy("id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("no_vector").alias("no_vector"), F.sum("blank").alias("blank"),
    )
    has_id = F.col("id").isNotNull()
    errors = F.array(
        F.struct(F.lit("missing id").alias("rule"), F.when(~has_id, F.col("rows")).alias("n")),
        F.struct(F.lit("duplicate id").alias("rule"), F.when(has_id, F.col("rows") - 1).alias("n")),
        F.struct(F.lit("missing vector").alias("rule"),
                 F.when(has_id, F.col("no_vector")).alias("n")),
        F.struct(F.lit("blank text").alias("rule"), F.when(has_id, F.col("blank")).alias("n")),
    )
    return per_key.select("id", F.inline(errors)).filter(F.col("n") > 0)


def _is_string(rows: DataFrame, column: str) -> bool:
    return rows.schema[column].dataType.typeName() == "string"


def store_check(stored: DataFrame, key: str = "chunkId", vector: str = "embedding") -> DataFrame:
    """After loading: rows, rows without vector, distinct and duplicated ids, dimensions.

    One shuffle on the key; the rest are partial aggregates.
    """
    size = F.when(~has_no_vector(F.col(vector)), F.size(vector))
    per_key = stored.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(has_no_vector(F.col(vector))).alias("missing"),
        F.min(size).alias("lo"), F.max(size).alias("hi"),
    )
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_vectors"),
        F.count(F.lit(1)).alias("unique_ids"),
        F.count_if(F.col("n") > 1).alias("duplicates"),
        F.min("lo").alias("min_dim"), F.max("hi").alias("max_dim"),
    )


def store_verdict(stored: DataFrame, dimension: int = fv.EMBEDDING_DIMENSION,
                  expected: int | None = None, key: str = "chunkId",
                  vector: str = "embedding") -> DataFrame:
    """The check list after loading and whether all of it holds."""
    seen = store_check(stored, key, vector)
    enough = F.col("total") == expected if expected is not None else F.col("total") > 0
    fits = (F.col("min_dim") == dimension) & (F.col("max_dim") == dimension)
    checks = seen.select(
        enough.alias("count_ok"),
        (F.col("missing_vectors") == 0).alias("no_missing"),
        (F.col("unique_ids") == F.col("total")).alias("no_duplicates"),
        F.coalesce(fits, F.lit(False)).alias("dimension_ok"),
    )
    return checks.withColumn(
        "passed",
        F.col("count_ok") & F.col("no_missing") & F.col("no_duplicates") & F.col("dimension_ok"),
    )


def sample_record(stored: DataFrame, key: str = "chunkId",
                  vector: str = "embedding") -> DataFrame:
    """One stored row that has a vector (the smallest key), with the first value of
    the vector and its length instead of the vector."""
    rest = [c for c in stored.columns if c not in (key, vector)]
    shown = F.struct(
        F.col(key), *rest, F.slice(F.col(vector), 1, 1).alias("first_values"),
        F.size(vector).alias("dimension"),
    )
    with_vector = stored.filter(~has_no_vector(F.col(vector)))
    return with_vector.agg(F.min_by(shown, F.col(key)).alias("r")).filter(
        F.col("r").isNotNull()
    ).select("r.*")


def chunk_table_check(chunks: DataFrame, size: int, overlap: int) -> DataFrame:
    """Ids, blank texts and the recorded configuration of every row, with the verdict."""
    per_key = chunks.groupBy("chunkId").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(is_blank(F.col("text"))).alias("blank"),
        F.count_if(
            ~(F.col("chunkSize").eqNullSafe(size) & F.col("overlap").eqNullSafe(overlap))
        ).alias("off"),
    )
    totals = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"),
        F.count(F.lit(1)).alias("unique_ids"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_ids"),
        F.coalesce(F.sum("blank"), F.lit(0)).alias("empty_text"),
        F.coalesce(F.sum("off"), F.lit(0)).alias("wrong_config"),
    )
    return totals.withColumn(
        "ok",
        (F.col("duplicate_ids") == 0) & (F.col("empty_text") == 0) & (F.col("wrong_config") == 0),
    )


def vector_table_check(embedded: DataFrame, expected: int | None = None, key: str = "chunkId",
                       vector: str = "embedding") -> DataFrame:
    """Count, dimension, duplicates, missing vectors, consistency; complete or not."""
    seen = store_check(embedded, key, vector)
    consistent = F.coalesce(F.col("min_dim") == F.col("max_dim"), F.lit(False))
    checked = seen.select(
        F.col("total").alias("n_rows"),
        F.when(consistent, F.col("min_dim")).alias("dimension"),
        (F.col("total") - F.col("unique_ids")).alias("duplicate_ids"),
        "missing_vectors",
        consistent.alias("consistent"),
    )
    if expected is None:
        return checked
    return checked.withColumn("complete", is_complete(F.lit(expected)))


def is_complete(expected: Column) -> Column:
    """Over a :func:`vector_table_check` row: nothing left to embed."""
    return (
        (F.col("n_rows") == expected) & (F.col("duplicate_ids") == 0)
        & (F.col("missing_vectors") == 0) & F.col("consistent")
    )
