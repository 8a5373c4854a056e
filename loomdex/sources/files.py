"""Typed reads of the input files and the plain sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex import schemas


def read_json_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file (or folder of files) holding one pretty-printed JSON array each.

    A file that is no JSON of this schema is an error when it is read;
    ``rejected_json_files`` lists such files without failing.
    """
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def rejected_json_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """file and reason, once per file of a JSON table that cannot be read or only in part."""
    damaged = "__damaged"
    full = T.StructType(schema.fields + [T.StructField(damaged, T.StringType())])
    rows = (
        spark.read.schema(full).option("multiLine", True)
        .option("columnNameOfCorruptRecord", damaged).json(path)
        .select(F.col("_metadata.file_name").alias("file"), schema.fieldNames()[0], damaged))
    first = F.col(schema.fieldNames()[0])
    read = first.isNotNull()
    # Spark refuses a plan that needs the damaged text alone.
    some = F.col(damaged).isNotNull() & F.coalesce(first.cast("string"), F.col(damaged)).isNotNull()
    return rows.filter(some).groupBy("file").agg(
        F.when(F.max(read), "readable in part").otherwise("not readable").alias("reason"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_json_table(spark, path, schemas.MANIFEST)


def raw_documents(texts: DataFrame, *more: Column) -> DataFrame:
    """id and text from a whole-text read, and ``more``; the id is the base name of the file."""
    name = F.col("_metadata.file_name")
    return texts.select(
        F.regexp_replace(name, r"\.txt$", "").alias("id"), F.col("value").alias("text"), *more
    )


def read_raw_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*.txt`` below a folder, one row per file."""
    return raw_documents(
        spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    )


def read_experiment_config(spark: SparkSession, path: str) -> DataFrame:
    """One row per experiment with the settings all experiments share."""
    config = read_json_table(spark, path, schemas.EXPERIMENT_CONFIG)
    return config.select(F.explode("experiments").alias("e"), "sharedConfig").select(
        "e.*", "sharedConfig.*"
    )


def write_json_table(rows: DataFrame, path: str) -> None:
    """JSON lines, for exchange at the edges; tables between jobs are Parquet."""
    rows.write.mode("overwrite").json(path)
