"""Local sessions for tests and benchmarks, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app_name: str = "loomdex") -> SparkSession:
    """A session for one machine. On a cluster, use the session you are given."""
    partitions = str(cores) if str(cores).isdigit() else "8"
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOOMDEX_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share, in ``spark.checkpoint.dir``.

    Where that is unset, a local master gets one in the warehouse folder, as in tests.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cut"
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def written(rows: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once and read from there.

    A reader takes the columns it needs, and a lost executor costs the reading tasks only.
    """
    path = f"{shared_folder(rows.sparkSession)}/table-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def checkpointed(rows: DataFrame) -> DataFrame:
    """Cut the lineage of a table that several jobs read.

    It takes less memory of an executor than ``written``, but computes the rows twice, for
    the count and for the files; where that is much work, ``written`` is the better choice.
    """
    shared_folder(rows.sparkSession)
    return rows.checkpoint()
