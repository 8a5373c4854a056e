"""The stored vector table: versions, keyed upsert, experiment replacement, counters.

A table is a folder of three Parquet tables:

* ``data/version=V/experiment=E/shard=S`` holds rows. Files are never changed once written;
* ``manifests/version=V`` lists the shards of version V: experiment, shard, the version that
  wrote its rows, and how many they are;
* ``commits`` has one row per version. Its file is moved into place as a whole, and only then
  does the version exist.

A reader opens the last committed version and keeps it: later writes make files of their own.
A job that dies before the commit leaves the version before it as it was, and the next write
takes the same number and overwrites what was left. One writer at a time may use a table.

The shard comes from the unique key, so no shard grows with a popular document. A version
writes only the shards with changed rows. Use one number of shards for all writes to a table,
such that a shard holds a few gigabytes. Before writing, rows are rebalanced by shard:
adaptive execution then splits a large shard over several tasks and files, and merges small
ones. Every row is stored with a digest of its content, so that an upsert finds changed rows
from keys and digests and shuffles no texts or vectors for it.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.operators.ordering import first_in_order
from loomdex.operators.validation import duplicate_keys
from loomdex.session import written

SHARDS = 1024


def one_per_key(rows: DataFrame, key: str = "chunkId", order: str | None = None) -> DataFrame:
    """The last row of each key by ``order``; without an order, the greatest row."""
    fields = F.struct(*[c for c in rows.columns if c != key])
    last = F.max(fields) if order is None else F.max_by(fields, F.col(order))
    return rows.groupBy(key).agg(last.alias("__row")).select(key, "__row.*").select(*rows.columns)


def upserted(existing: DataFrame, updates: DataFrame, key: str = "chunkId",
             order: str | None = None) -> DataFrame:
    """Replace rows by key and add the new ones. Doing it twice changes nothing more.

    A key that a batch has several times is written once, see :func:`one_per_key`.
    """
    updates = one_per_key(updates, key, order)
    kept = existing.join(updates.select(key), key, "left_anti")
    return kept.select(*existing.columns).unionByName(updates.select(*existing.columns))


def upsert_counts(existing: DataFrame, updates: DataFrame, key: str = "chunkId",
                  order: str | None = None) -> DataFrame:
    """Inserted, matched, and replaced rows; replaced are those whose content changed.

    Keys count once, as in :func:`upserted`.
    """
    updates = one_per_key(updates, key, order)
    fields = [c for c in existing.columns if c != key]
    old = existing.select(key, F.struct(*fields).alias("old"))
    new = updates.select(key, F.struct(*fields).alias("new"))
    both = new.join(old, key, "left")
    return both.agg(
        F.count_if(F.col("old").isNull()).alias("inserted"),
        F.count_if(F.col("old").isNotNull()).alias("matched"),
        F.count_if(F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("new")))
        .alias("replaced"),
    )


def with_shard(rows: DataFrame, key: str = "chunkId", shards: int = SHARDS) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int"))


def write_table(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Overwrite a whole Parquet table."""
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def first_rows(chunks: DataFrame, n: int) -> DataFrame:
    """The first n chunks, in document order. They stay spread over tasks, however large n is."""
    if n <= 0:
        raise ValueError(f"n must be positive, got {n}")
    order = ["documentId", "chunkIndex"]
    return first_in_order(chunks, order, n).orderBy(*order)


def swapped(stored: DataFrame, records: DataFrame, experiment: str) -> DataFrame:
    """The stored rows after an experiment was cleared and loaded anew."""
    loaded = records.withColumn("experiment", F.lit(experiment)).select(*stored.columns)
    return stored.filter(~F.col("experiment").eqNullSafe(experiment)).unionByName(loaded)


def swap_counts(stored: DataFrame, records: DataFrame, experiment: str) -> DataFrame:
    """Per experiment: rows before, deleted, inserted and after the replacement."""
    after = swapped(stored, records, experiment)
    sides = stored.select("experiment", F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(
        after.select("experiment", F.lit(0).alias("old"), F.lit(1).alias("new")))
    own = F.col("experiment") == experiment
    return sides.groupBy("experiment").agg(
        F.sum("old").alias("count_before"), F.sum("new").alias("count_after"),
    ).select(
        "experiment", "count_before", F.when(own, F.col("count_before")).otherwise(0).alias("deleted"),
        F.when(own, F.col("count_after")).otherwise(0).alias("inserted"), "count_after",
    )


# --- versions -------------------------------------------------------------------
DIGEST = "__digest"
_MANIFEST = T.StructType([
    T.StructField("experiment", T.StringType()), T.StructField("shard", T.IntegerType()),
    T.StructField("data_version", T.LongType()), T.StructField("n", T.LongType()),
])
_COMMIT = T.StructType([T.StructField("version", T.LongType())])
_PLACE = T.StructType([T.StructField("version", T.LongType()), *_MANIFEST.fields[:2]])


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as failure:
        if failure.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def store_version(spark: SparkSession, path: str) -> int:
    """The last committed version; 0 before the first load."""
    return _read_or_empty(spark, f"{path}/commits", _COMMIT).agg(F.max("version")).first()[0] or 0


def store_manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """experiment, shard, data_version and number of rows of every shard of a version."""
    number = store_version(spark, path) if version is None else version
    if number == 0:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/version={number}")


def superseded_shards(spark: SparkSession, path: str, keep_from: int) -> DataFrame:
    """version, experiment and shard of stored files that no version from ``keep_from`` on
    uses. They may be deleted once nobody reads an older version."""
    used = None
    for number in range(keep_from, store_version(spark, path) + 1):
        part = store_manifest(spark, path, number)
        used = part if used is None else used.unionByName(part)
    if used is None:
        raise ValueError(f"version {keep_from} does not exist")
    used = used.select(F.col("data_version").alias("version"), "experiment", "shard").distinct()
    older = _read_or_empty(spark, f"{path}/data", _PLACE).filter(F.col("version") < keep_from).distinct()
    return older.join(used, ["version", "experiment", "shard"], "left_anti")


def _stored_rows(spark: SparkSession, path: str, columns: list[T.StructField],
                 shards: list) -> DataFrame:
    """The rows of the given manifest entries, which are at most shards x experiments."""
    schema = T.StructType(columns + _PLACE.fields)
    if not shards:
        return spark.createDataFrame([], schema).drop("version")
    base = f"{path}/data"
    folders = [f"{base}/version={s.data_version}/experiment={folder_name(s.experiment)}/shard={s.shard}"
               for s in shards]
    return spark.read.schema(schema).option("basePath", base).parquet(*folders).drop("version")


def folder_name(name: str) -> str:
    """The name of an experiment, if it can be that of a folder as it stands."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", name or ""):
        raise ValueError(f"experiment names have letters, digits and _ . - only: {name!r}")
    return name


def _own_fields(schema: T.StructType) -> list[T.StructField]:
    return [f for f in schema.fields if f.name not in ("experiment", "shard", "version", DIGEST)]


def read_store(spark: SparkSession, path: str, schema: T.StructType,
               version: int | None = None) -> DataFrame:
    """A version of the stored table, by default the last, with its experiment and shard
    columns; an empty table before the first load."""
    return _stored_rows(spark, path, _own_fields(schema), store_manifest(spark, path, version).collect())


def with_digest(rows: DataFrame, key: str = "chunkId") -> DataFrame:
    """Adds a digest of all columns but the key. Names, nulls and places in lists count."""
    content = F.struct(*[c for c in sorted(rows.columns) if c != key])
    return rows.withColumn(DIGEST, F.sha2(F.to_json(content, {"ignoreNullFields": "false"}), 256))


def _commit(spark: SparkSession, path: str, version: int, rows: DataFrame, experiment: str,
            kept: list) -> int:
    """Write rows (with shard and digest) as a version next to kept shards; the rows written."""
    target = f"{path}/data/version={version}/experiment={folder_name(experiment)}"
    rows.hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(target)
    places = [
        (experiment, r.shard, version, r.n)
        for r in _read_or_empty(spark, target, T.StructType([_MANIFEST["shard"]]))
        .groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()]
    entries = [tuple(s) for s in kept] + places
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/manifests/version={version}")
    spark.createDataFrame([(version,)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return sum(p[3] for p in places)


def replace_experiment(spark: SparkSession, path: str, records: DataFrame, experiment: str,
                       key: str = "chunkId", shards: int = SHARDS) -> dict[str, int]:
    """Clear one experiment and load it anew; other experiments stay as they are.

    Returns the experiment's rows ``before``, ``deleted``, ``inserted`` and ``after``, from
    the manifests. Until the load is committed, readers see the experiment as it was.
    """
    version = store_version(spark, path)
    entries = store_manifest(spark, path, version).collect()
    before = sum(s.n for s in entries if s.experiment == experiment)
    others = [s for s in entries if s.experiment != experiment]
    after = _commit(spark, path, version + 1, with_shard(with_digest(records, key), key, shards),
                    experiment, others)
    return {"before": before, "deleted": before, "inserted": after, "after": after}


def upsert_table(spark: SparkSession, path: str, updates: DataFrame, experiment: str,
                 key: str = "chunkId", shards: int = SHARDS,
                 removed: DataFrame | None = None) -> dict[str, int]:
    """Upsert a batch into the stored table, and remove the keys of ``removed`` if given.

    Returns how many rows were ``inserted``, ``matched`` (their key was stored), ``replaced``
    (and their content differs) and ``deleted``. A key in both tables is an update. Stored
    keys and digests tell which rows change; only the shards of these are read and written,
    and a batch that changes nothing makes no version. ``updates`` is read several times:
    pass a stored table.
    """
    if duplicate_keys(updates, key).limit(1).count():
        raise ValueError(f"the batch has duplicate values of {key}")
    version = store_version(spark, path)
    entries = store_manifest(spark, path, version).collect()
    own = [s for s in entries if s.experiment == experiment]
    fields = _own_fields(updates.schema)
    batch = with_shard(with_digest(updates.select(*[f.name for f in fields]), key), key, shards)
    digest = T.StructField(DIGEST, T.StringType())
    stored = _stored_rows(spark, path, [updates.schema[key], digest], own)
    known = stored.select(key, F.col(DIGEST).alias("__old"))
    changes = batch.select(key, "shard", DIGEST).join(known, key, "left").select(
        key, "shard",
        F.when(F.col("__old").isNull(), "inserted").when(F.col("__old") != F.col(DIGEST), "replaced")
        .otherwise("matched").alias("change"))
    if removed is not None:
        gone = stored.select(key, "shard").join(removed.select(key).distinct(), key, "left_semi")
        changes = changes.unionByName(
            gone.join(batch.select(key), key, "left_anti").withColumn("change", F.lit("deleted")))
    changes = written(changes)
    n = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
    counts = {"inserted": n.get("inserted", 0), "matched": n.get("matched", 0) + n.get("replaced", 0),
              "replaced": n.get("replaced", 0), "deleted": n.get("deleted", 0)}
    effective = changes.filter(F.col("change") != "matched")
    # at most ``shards`` numbers
    touched = {r.shard for r in effective.select("shard").distinct().collect()}
    if not touched:
        return counts
    old = _stored_rows(spark, path, [*fields, digest], [s for s in own if s.shard in touched])
    new = batch.join(effective.filter(F.col("change") != "deleted").select(key), key, "left_semi")
    columns = [*[f.name for f in fields], DIGEST, "shard"]
    merged = old.join(effective.select(key), key, "left_anti").select(*columns).unionByName(
        new.select(*columns))
    kept = [s for s in entries if s.experiment != experiment or s.shard not in touched]
    _commit(spark, path, version + 1, merged, experiment, kept)
    return counts
