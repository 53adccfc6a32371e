"""Shares of turns by person, office, party and mode, from one small aggregate per (year, mode, person, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import EXECUTIVE
from ..sources.tables import discard, stored
from .scans import PART, ranged

KEYS = ("year", "mode", "canonical_id", "is_president", "office", "party")


def turn_aggregate(turns: DataFrame) -> DataFrame:
    """Guest turns (rows, or counts in a column n) by KEYS, each once under its own mode and once under `all` (grouping sets, one pass)."""
    n = F.col("n") if "n" in turns.columns else F.lit(1)
    t = turns.where("staff_flag = 'guest' and year is not null and canonical_id is not null and canonical_id <> '' and not startswith(canonical_id, 'ambiguous:')")
    t = t.select("year", F.col("source_mode").alias("mode"), "canonical_id", F.coalesce("is_president", F.lit(False)).alias("is_president"), F.coalesce("office", F.lit("")).alias("office"), F.coalesce(F.nullif("party", F.lit("")), F.lit("none")).alias("party"), n.cast("long").alias("n"))
    rest = [F.col(c) for c in KEYS if c != "mode"]
    own = t.groupBy(*KEYS).agg(F.sum("n").alias("n"))
    both = own.groupingSets([[F.col("mode"), *rest], rest], F.col("mode"), *rest).agg(F.sum("n").alias("n"), F.grouping("mode").alias("_all"))
    return both.select("year", F.when(F.col("_all") == 1, "all").otherwise(F.col("mode")).alias("mode"), *KEYS[2:], "n")


def flag_share(agg: DataFrame, flag: str, by: Sequence[str] = ("mode", "year"), n: str = "n") -> DataFrame:
    total = F.sum(n)
    hit = F.sum(F.when(F.col(flag), F.col(n)).otherwise(0))
    return agg.groupBy(*by).agg(hit.alias("n_flagged"), total.alias("n_total"), (hit / total).alias("share"))


def president_share(agg: DataFrame) -> DataFrame:
    """The sitting president's share, and who that is most often in the year."""
    s = agg.groupBy("mode", "year").agg(F.sum(F.when(F.col("is_president"), F.col("n")).otherwise(0)).alias("n_president_turns"), F.sum("n").alias("n_guest_turns"))
    who = agg.where("is_president").groupBy("mode", "year", "canonical_id").agg(F.sum("n").alias("c")).groupBy("mode", "year").agg(F.max(F.struct("c", "canonical_id"))["canonical_id"].alias("president_id"))
    return s.join(who, ["mode", "year"], "left").withColumn("president_share", F.col("n_president_turns") / F.col("n_guest_turns"))


def office_share(agg: DataFrame, offices: Sequence[str]) -> DataFrame:
    """Wide shares by office, with coverage and the executive offices together; null where a year has none of an office."""
    total = F.sum("n")
    wide = [(F.sum(F.when(F.col("office") == o, F.col("n"))) / total).alias(f"{o}_share") for o in sorted(set(offices))]
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)) / total
    return agg.groupBy("mode", "year").agg(total.alias("n_guest_turns"), (1 - part(F.col("office") == "")).alias("office_coverage"), part(F.col("office").isin(*EXECUTIVE)).alias("executive_share"), *wide)


def party_share(agg: DataFrame) -> DataFrame:
    total = F.sum("n")
    part = lambda p: F.coalesce(F.sum(F.when(F.col("party") == p, F.col("n"))), F.lit(0)) / total
    return agg.groupBy("mode", "year").agg(total.alias("n_guest_turns"), *[part(p).alias(f"{p}_share") for p in "RDI"], (1 - part("none")).alias("party_coverage"))


def top_sources(counts: DataFrame, by: Sequence[str], entity: str, k: int = 15) -> DataFrame:
    """The k largest entities per group of (by..., entity, c), with rank and share; equal counts go by the entity."""
    total = counts.groupBy(*by).agg(F.sum("c").alias("_s"))
    w = Window.partitionBy(*by).orderBy(F.col("c").desc(), entity)
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.join(total, list(by)).select(*by, "rank", entity, F.col("c").alias("n_turns"), (F.col("c") / F.col("_s")).alias("share"))


def coverage(segments: DataFrame, year: str = "year") -> DataFrame:
    return segments.where(F.col(year).isNotNull()).groupBy(F.col(year).alias("year")).agg(F.count("*").alias("n_segments"))


def rank_bands(series: DataFrame) -> DataFrame:
    """Top ten, the next fifteen, and the rest; the three sum to 1."""
    return series.select("*", F.col("top10_share").alias("band_top10"), (F.col("top25_share") - F.col("top10_share")).alias("band_next15"), (1 - F.col("top25_share")).alias("band_rest"))


def effective_voices(hhi: Column) -> Column:
    return 1 / hhi


def mode_share(series: DataFrame, part: str = "clip", other: str = "live") -> DataFrame:
    """Share of one mode's events among two, per year; years that lack either are left out."""
    n = lambda m: F.max(F.when(F.col("mode") == m, F.col("n_events")))
    w = series.where(F.col("mode").isin(part, other)).groupBy("year").agg(n(part).alias("a"), n(other).alias("b"))
    return w.where("a is not null and b is not null").select("year", F.col("a").alias(f"n_{part}"), F.col("b").alias(f"n_{other}"), (F.col("a") / (F.col("a") + F.col("b"))).alias(f"{part}_share"))


def islands(df: DataFrame, order: str, value: str, by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Runs of consecutive rows (order, a whole number that comes once per group, rising by 1) with one value: first, last, rows.
    Null values break runs and give none.

    Rows are dealt to tasks by ranges of (by, order); each range finds its own runs, and runs that touch across edges are put
    together. Only a range's first and last run can touch others, so what is put together is two rows per group and range.
    """
    d, path = ranged(df.where(F.col(value).isNotNull()).select(*by, order, value), by, [order], parts)
    w = Window.partitionBy(PART, *by).orderBy(order)
    new = F.coalesce((F.lag(value).over(w) != F.col(value)) | (F.lag(order).over(w) != F.col(order) - 1), F.lit(True))
    d = d.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    own = d.groupBy(PART, *by, "_run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    ends = Window.partitionBy(PART, *by)
    own = own.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(ends)))
    runs, _ = stored(own.select(*by, value, "first", "last", "n", "_edge"), "runs")
    discard(df.sparkSession, path)
    across = Window.partitionBy(*by).orderBy("first")
    edge = runs.where("_edge")
    new = F.coalesce((F.lag(value).over(across) != F.col(value)) | (F.lag("last").over(across) != F.col("first") - 1), F.lit(True))
    merged = edge.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(across)).groupBy(*by, "_run", value).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    cols = [*by, value, "first", "last", "n"]
    return runs.where("not _edge").select(*cols).unionByName(merged.select(*cols))


def face_validity(cited: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """Per year of `expected` (year, expected) with cited people: whether the expected one is among the k most cited."""
    n = cited.where("entity_type = 'PERSON' and year is not null").groupBy("year", "canonical_id").agg(F.count("*").alias("c"))
    top = n.withColumn("rank", F.row_number().over(Window.partitionBy("year").orderBy(F.col("c").desc(), "canonical_id"))).where(F.col("rank") <= k)
    names = top.groupBy("year").agg(F.array_sort(F.collect_list("canonical_id")).alias("top"))
    return names.join(expected, "year").select("year", "expected", F.array_contains("top", F.col("expected")).alias("ok"), F.array_join("top", ",").alias("top"))
