"""Guest turns counted over a stream of segment files.

Turns are parsed per segment without state. Names are resolved against a fixed table (name, canonical_id); resolved_counts.py
resolves them by what has come so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.turns import parse_turns
from ..plans.pipeline import provenance
from ..sources.segments import RAW, coerce, internal
from ..sources.tables import scratch


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in RAW])
    s = spark.readStream.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', maxFilesPerTrigger=files_per_trigger).csv(path)
    return coerce(s.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(internal(c)) for c in RAW]))


def count_turns(segments: DataFrame, names: DataFrame) -> DataFrame:
    """Running counts by year, mode and person of named guests; for complete or update mode."""
    t = parse_turns(provenance(segments, strict=False)).where("staff_flag = 'guest' and year is not null")
    known = names.select(F.col("name").alias("_n"), "canonical_id")
    t = t.withColumn("_n", X.normalize_name("name_norm")).join(known, "_n", "left").withColumn("canonical_id", F.coalesce("canonical_id", "_n"))
    return t.where(X.is_named("canonical_id")).groupBy("year", F.col("source_mode").alias("mode"), "canonical_id").agg(F.count("*").alias("n"))


def run_available(counts: DataFrame) -> DataFrame:
    """All files that are there, counted; each batch writes the whole counts under its number to the shared folder, in place of
    the batch before if it is run again, and the last one is read."""
    spark = counts.sparkSession
    path = scratch(spark, "running-counts")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    keep(spark.createDataFrame([], counts.schema), -1)
    q = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", scratch(spark, "running-counts-log")).trigger(availableNow=True).start()
    q.awaitTermination()
    kept = spark.read.parquet(path)
    last = kept.agg(F.max("batch")).first()[0]
    return kept.where(F.col("batch") == F.lit(last)).select(*counts.columns)
