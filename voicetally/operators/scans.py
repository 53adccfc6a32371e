"""Scans over an order that are split into ranges: rows are dealt to tasks by range, tasks scan their ranges, and the ranges' edges,
one small row each, are combined. So a scan without a grouping key is spread like one with many groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

PART = "_part"


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[str], parts: int | None = None) -> tuple[DataFrame, str]:
    """df with the number of its range in PART, stored (a range is sampled, so it must not be dealt twice), and the table's path.
    Ranges follow by and then order; rows of one value of both are in one range."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *by, *order).withColumn(PART, F.spark_partition_id()), "ranges")
