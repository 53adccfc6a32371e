"""Concentration measures of one market given as an array of counts. Zeros do not count; negative counts raise an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _counted(counts: Column) -> Column:
    """The counts above 0, as doubles."""
    checked = F.transform(counts.cast("array<double>"), lambda x: F.when(x < 0, F.raise_error(F.lit("counts must be non-negative")).cast("double")).otherwise(x))
    return F.filter(checked, lambda x: x != 0)


def _sum(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))


def hhi(counts: Column) -> Column:
    a = _counted(counts)
    total = _sum(a)
    return F.when(F.size(a) == 0, NAN).otherwise(_sum(a, lambda x: x * x) / F.nullif(total * total, F.lit(0.0)))


def normalized_hhi(counts: Column) -> Column:
    n = F.size(_counted(counts)).cast("double")
    return F.when(n == 0, NAN).when(n == 1, 1.0).otherwise((hhi(counts) - 1 / F.nullif(n, F.lit(0.0))) / F.nullif(1 - 1 / F.nullif(n, F.lit(0.0)), F.lit(0.0)))


def top_k_share(counts: Column, k: int) -> Column:
    a = F.sort_array(_counted(counts), asc=False)
    return F.when(F.size(a) == 0, 0.0).otherwise(_sum(F.slice(a, 1, k)) / F.nullif(_sum(a), F.lit(0.0)))


def normalized_entropy(counts: Column) -> Column:
    a = _counted(counts)
    n, total = F.size(a), F.nullif(_sum(a), F.lit(0.0))
    logs = F.ln(total) - _sum(a, lambda x: x * F.ln(x)) / total
    return F.when(n == 0, NAN).when(n == 1, 0.0).otherwise(logs / F.nullif(F.ln(n.cast("double")), F.lit(0.0)))


def n_distinct(counts: Column) -> Column:
    return F.size(_counted(counts))


def concentration_metrics(counts: Column) -> Column:
    return F.struct(
        hhi(counts).alias("hhi"), normalized_hhi(counts).alias("hhi_normalized"), top_k_share(counts, 10).alias("top10_share"), top_k_share(counts, 25).alias("top25_share"),
        normalized_entropy(counts).alias("entropy_norm"), n_distinct(counts).cast("double").alias("n_distinct"), _sum(_counted(counts)).alias("n_events"),
    )
