"""Concentration of grouped markets: HHI and its companions per group, from events or weighted rows.

One shuffle counts (group, entity) with map-side combining; a second ranks the distinct entities. Only the largest 25
entities need ranking, so the window stops there (Spark's group limit), and everything else is plain sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("hhi", "hhi_normalized", "top10_share", "top25_share", "entropy_norm", "n_distinct", "n_events")


def market_counts(events: DataFrame, by: Sequence[str], entity: str, weight: Column | None = None) -> DataFrame:
    """One row per group and entity with its count c; rows without an entity do not count."""
    c = F.count("*") if weight is None else F.sum(weight)
    return events.where(F.col(entity).isNotNull()).groupBy(*by, entity).agg(c.alias("c"))


def concentration_of_counts(counts: DataFrame, by: Sequence[str], entity: str) -> DataFrame:
    """METRICS per group of counts (by..., entity, c). Zeros do not count; negative counts raise an error."""
    c = F.when(F.col("c") < 0, F.raise_error(F.lit("counts must be non-negative")).cast("bigint")).otherwise(F.col("c"))
    pos = counts.withColumn("c", c).where("c <> 0")
    x = F.col("c").cast("double")
    total = pos.groupBy(*by).agg(F.sum("c").alias("s"), F.sum(x * x).alias("s2"), F.sum(x * F.ln(x)).alias("sl"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("c").desc(), entity))
    top = pos.withColumn("r", rank).where("r <= 25").groupBy(*by).agg(F.sum(F.when(F.col("r") <= 10, F.col("c")).otherwise(0)).alias("t10"), F.sum("c").alias("t25"))
    both = total.join(top, list(by)) if by else total.crossJoin(top)
    s, n = F.col("s").cast("double"), F.col("n").cast("double")
    h = F.col("s2") / (s * s)
    return both.select(
        *by,
        h.alias("hhi"),
        F.when(F.col("n") == 1, 1.0).otherwise((h - 1 / n) / F.nullif(1 - 1 / n, F.lit(0.0))).alias("hhi_normalized"),
        (F.col("t10") / s).alias("top10_share"),
        (F.col("t25") / s).alias("top25_share"),
        F.when(F.col("n") == 1, 0.0).otherwise((F.ln(s) - F.col("sl") / s) / F.nullif(F.ln(n), F.lit(0.0))).alias("entropy_norm"),
        n.alias("n_distinct"),
        s.alias("n_events"),
    )


def concentration(events: DataFrame, by: Sequence[str], entity: str, weight: Column | None = None) -> DataFrame:
    return concentration_of_counts(market_counts(events, by, entity, weight), by, entity)


def annual(events: DataFrame, measure: str, variant: str, year: str = "year", entity: str = "canonical_id", weight: Column | None = None) -> DataFrame:
    """The yearly series with its labels; an empty input keeps its columns."""
    s = concentration(events.where(F.col(year).isNotNull()), [year], entity, weight)
    return s.select(F.col(year).alias("year"), F.lit(measure).alias("measure"), F.lit(variant).alias("variant"), *METRICS)
