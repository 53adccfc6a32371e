"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LEFT: dict[str, SparkSession] = {}


def fresh_name() -> str:
    return uuid.uuid4().hex


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary one only in a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="voicetally-")
    return f"{named.rstrip('/')}/{name}-{fresh_name()}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet and read again, and the table's path. What is behind it runs once, however often it is read, and a
    lost executor costs only the step that runs. Tables that nobody discards go when the driver ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    _LEFT[path] = spark
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables whose last reader is done, in whatever store they are."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _LEFT.pop(path, None)


@atexit.register
def _clear() -> None:
    for path, spark in list(_LEFT.items()):
        if spark.sparkContext._jsc is not None:
            discard(spark, path)
