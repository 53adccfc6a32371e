"""Turn counts kept up to date over a changing set of segment files.

A state folder holds the manifest of the files that are counted (path, size, SHA-256) and each file's counts. An update compares
manifests, parses only files that are new or changed, leaves out the counts of files that changed or went, and writes the result
as the next version; a version counts once both its tables are complete, so an update that fails leaves the last one in force.
Names are resolved over the merged counts, since a new file may make a name of an old one ambiguous.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.turns import parse_turns
from ..sources import segments as G
from ..sources.tables import discard
from . import pipeline as P

MANIFEST = "file string, size long, sha256 string"


class Update(NamedTuple):
    """Numbers of files that an update found, and the version that it left in force."""

    new: int
    changed: int
    removed: int
    kept: int
    version: int


def _complete(spark: SparkSession, state: str) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(state)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return []
    found = [p.getPath() for p in fs.listStatus(where)]
    path = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName()[1:]) for p in found if all(fs.exists(path(p, f"{t}/_SUCCESS")) for t in ("counts", "files")))


def current(spark: SparkSession, state: str) -> int | None:
    """The last complete version."""
    return max(_complete(spark, state), default=None)


def files_now(spark: SparkSession, paths: str) -> DataFrame:
    """MANIFEST of the files that a path or glob names; bytes are hashed, not parsed."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def count_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """Counted turns of segment files, by file."""
    s = G.coerce(G.read_csv(spark, files, file="path"))
    p = P.provenance(s, strict=False)  # the file's path comes along as the segment's
    return P.counted(parse_turns(p, keep=("year", "air_date", "path")), ["path"]).withColumnRenamed("path", "file")


def update(spark: SparkSession, state: str, paths: str, keep_versions: int = 2) -> Update:
    """Bring the state folder up to the files that `paths` names now."""
    last = current(spark, state)
    now = files_now(spark, paths)
    if last is None:
        old, counts = spark.createDataFrame([], MANIFEST), None
    else:
        old, counts = spark.read.parquet(f"{state}/v{last}/files"), spark.read.parquet(f"{state}/v{last}/counts")
    both = now.alias("n").join(old.alias("o"), "file", "full").select("file", F.col("n.sha256").alias("now"), F.col("o.sha256").alias("was"), F.col("n.size").alias("size"))
    what = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "changed").otherwise("kept")
    version = 0 if last is None else last + 1
    at = f"{state}/v{version}"
    discard(spark, at)  # what an update that failed has left
    both.withColumn("what", what).write.parquet(f"{at}/diff")
    diff = spark.read.parquet(f"{at}/diff")
    n = {r["what"]: r["count"] for r in diff.groupBy("what").count().collect()}
    parse = [r["file"] for r in diff.where("what in ('new', 'changed')").select("file").collect()]
    merged = count_files(spark, parse)
    if counts is not None:
        merged = merged.unionByName(counts.join(diff.where("what = 'kept'").select("file"), "file", "left_semi"))
    merged.write.parquet(f"{at}/counts")
    diff.where("what <> 'removed'").select("file", "size", F.col("now").alias("sha256")).write.parquet(f"{at}/files")
    discard(spark, f"{at}/diff", *[f"{state}/v{v}" for v in _complete(spark, state) if v <= version - keep_versions])
    return Update(*[n.get(k, 0) for k in ("new", "changed", "removed", "kept")], version)


def turns(spark: SparkSession, state: str, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """The merged counts of the version in force, resolved, as count_turns() gives them."""
    counts = spark.read.parquet(f"{state}/v{current(spark, state)}/counts")
    keys = [c for c in counts.columns if c not in ("file", "n")]
    return P.resolved_counts(counts.groupBy(*keys).agg(F.sum("n").alias("n")), (), aliases)
