"""Entity resolution of name mentions within a scope."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import ALIASES
from ..functions.text import normalize_name, surname

SALTS = 16


def alias_table(spark: SparkSession, aliases: Mapping[str, str] | DataFrame | None = None) -> DataFrame:
    """(alias, person) of a map or a table (surface, person): written forms normalized as mentions are. Of the people of one form
    the first by name counts."""
    if not isinstance(aliases, DataFrame):
        aliases = spark.createDataFrame(list((ALIASES if aliases is None else aliases).items()), "surface string, person string")
    rows = aliases.select(normalize_name("surface").alias("alias"), F.lower(F.trim("person")).alias("person")).where("alias <> '' and person <> ''")
    return rows.groupBy("alias").agg(F.min("person").alias("person"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(surface, person) of a CSV with a header; lines that begin with # are notes."""
    return spark.read.csv(path, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, schema="surface string, person string")


def resolve_mentions(df: DataFrame, name: str, scope: Sequence[str] = (), aliases: Mapping[str, str] | DataFrame | None = None, out: str = "canonical_id") -> DataFrame:
    """df with a column `out`: the person of an alias; a full name itself; a bare surname's only full name in the scope, or
    `ambiguous:<surname>` for several, or itself for none; '' for an empty name.

    aliases: a map or a table of any size; Spark broadcasts it only if it is small. Full names that an alias stands for are no
    candidates. Distinct full names are combined before the shuffle, and a surname's
    candidates reduce to a count and one name, so a frequent surname is a single small row. The other side is dealt out by a
    salt as well, so neither a frequent bare surname nor the names that look for none meet in one task.
    """
    scope = list(scope)
    table = alias_table(df.sparkSession, aliases)
    d = df.withColumn("_n", normalize_name(name)).join(table.withColumnRenamed("alias", "_n").withColumnRenamed("person", "_alias"), "_n", "left")
    d = d.withColumns({"_full": F.col("_n").contains(" "), "_sn": surname("_n")})
    full = d.where("_full and _alias is null").select(*scope, "_sn", "_n").distinct()
    one = full.groupBy(*scope, "_sn").agg(F.count("*").alias("_many"), F.min("_n").alias("_only")).withColumnRenamed("_sn", "_key")
    one = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    row = F.monotonically_increasing_id()
    bare = ~F.col("_full") & F.col("_alias").isNull()
    # a name that looks for no candidate gets a key that none has
    keyed = d.withColumns({"_key": F.when(bare, F.col("_n")).otherwise(F.concat(F.lit("\u0000"), row % 8191)), "_salt": (row % SALTS).cast("int")})
    joined = keyed.join(one, [*scope, "_key", "_salt"], "left")
    who = F.when(F.col("_n") == "", "").when(F.col("_alias").isNotNull(), F.col("_alias")).when(F.col("_many") == 1, F.col("_only")).when(F.col("_many") > 1, F.concat(F.lit("ambiguous:"), F.col("_n"))).otherwise(F.col("_n"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], who.alias(out))
