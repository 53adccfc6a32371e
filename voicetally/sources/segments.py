"""Transcript segments: CSV scan, typed coercion, checks, quarantine, manifest, lexicon scans and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = ("url", "channel.name", "program.name", "uid", "duration", "year", "month", "date", "time", "timezone", "path", "wordcount", "subhead", "text")
RANGES = {"year": (1999, 2026), "month": (1, 12), "date": (1, 31)}


def internal(name: str) -> str:
    return name.replace(".", "_")


def read_csv(spark: SparkSession, paths: str | Sequence[str], partitions: int | None = None, file: str | None = None) -> DataFrame:
    """All columns as strings, dots in names as underscores, empty fields as ''. No paths give no rows.

    Texts hold line ends (multiLine), so a file is one task, compressed or not; rows are dealt out again where partitions is
    given. file: a column that gets the path of a row's file in place of what it holds.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in RAW])
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        return spark.createDataFrame([], schema).toDF(*map(internal, RAW))
    df = spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"', enforceSchema=True).csv(paths)
    value = lambda c: F.col("_metadata.file_path") if internal(c) == file else F.coalesce(F.col(f"`{c}`"), F.lit(""))
    df = df.select(*[value(c).alias(internal(c)) for c in RAW])
    return df.repartition(partitions) if partitions else df


def ranged(c: Column, lo: int, hi: int) -> Column:
    n = F.trim(c).try_cast("int")
    return F.when(n.between(lo, hi), n)


def coerce(df: DataFrame) -> DataFrame:
    """Typed segments: numbers out of range or unreadable become null."""
    numbers = {k: ranged(F.col(k), *v) for k, v in RANGES.items()}
    return df.withColumns(numbers | {"wordcount": F.trim("wordcount").try_cast("bigint")})


def violations(df: DataFrame) -> Column:
    """Names of the broken checks of a coerced row; an empty array if none."""
    checks = {"url_missing": F.col("url").isNull(), "wordcount_negative": F.col("wordcount") < 0}
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all checks, the others with the names of what they break)."""
    d = df.withColumn("violations", violations(df))
    return d.where(F.size("violations") == 0).drop("violations"), d.where(F.size("violations") > 0)


def validate(df: DataFrame) -> DataFrame:
    """Coerced rows; reading a row that breaks a check raises an error."""
    d = coerce(df)
    bad = F.array_join(violations(d), ",")
    return d.withColumn("url", F.when(bad != "", F.raise_error(F.concat(F.lit("schema violation: "), bad)).cast("string")).otherwise(F.col("url")))


def manifest(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Name, size and SHA-256 of each file under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    m = spark.read.json(path, multiLine=True, schema="doi string, version string, files array<struct<filename:string,file_id:long,size:long,sha256:string>>")
    return m.select("doi", "version", F.explode("files").alias("f")).select("doi", "version", "f.*")


def read_lexicon(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV lexicon with `#` comments and a header; trimmed, lower-cased keys first, in file order as `ord`."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).options(header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path).coalesce(1)
    return df.withColumn(columns[0], F.lower(columns[0])).where(F.col(columns[0]) != "").withColumn("ord", F.monotonically_increasing_id())


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> '' and not startswith(word, '#')")


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """One sorted CSV; for yearly tables, which are small."""
    df.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").csv(path, header=True)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="year int, measure string, variant string, hhi double, hhi_normalized double, top10_share double, top25_share double, entropy_norm double, n_distinct double, n_events double")
