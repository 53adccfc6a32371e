"""Connected components of an edge table by alternating large-star and small-star steps.

A node with very many edges is spread: its least neighbour is combined before the shuffle and stored, so the join with it has an
exchange on both sides, whose large partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import discard, stored


def _large(e: DataFrame) -> tuple[DataFrame, str]:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least, path = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), path


def _small(e: DataFrame) -> tuple[DataFrame, str]:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least, path = stored(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    return down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))), path


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v; long): the component is its least node.

    Rounds are logarithmic in practice; each is written to the shared folder, so lineage stays short, and the one before deleted.
    """
    spark = edges.sparkSession
    e, at = stored(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        large, one = _large(e)
        star, two = stored(large, "large-stars")
        small, three = _small(star)
        now_e, now_at = stored(small.distinct(), "stars")
        for path in (at, one, two, three):
            discard(spark, path)
        e, at = now_e, now_at
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
