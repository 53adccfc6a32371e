"""Per-stratum samples that depend on the rows alone, not on their partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tasks whose rows are merged by one task of the second level.
FAN_IN = 64


def least_of_each(t: pa.Table, strata: Sequence[str], order: Sequence[str], k: int) -> pa.Table:
    """The first k rows of each stratum by order. Applied to parts and then to what they gave, it gives the same as to all rows."""
    t = t.sort_by([(c, "ascending") for c in (*strata, *order)])
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in strata:
        v = t.column(c).dictionary_encode().combine_chunks() if t.num_rows else None
        if v is not None:
            v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
            code = v.indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
    at = np.arange(t.num_rows)
    return t.filter(pa.array(at - np.maximum.accumulate(np.where(new, at, 0)) < k))


def bottom_k(df: DataFrame, strata: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first k rows of each stratum by order, which must not leave ties. One pass over the rows: a task keeps its own first k
    of each stratum and sends only those; a second level merges what groups of tasks have sent, and the last one ranks the rest.
    So a stratum of any size reaches one task as few rows, and rows are never sorted as a whole."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            now = least_of_each(pa.Table.from_batches([b]), strata, order, k)
            held = now if held is None else least_of_each(pa.concat_tables([held, now]), strata, order, k)
        if held is not None:
            yield from held.combine_chunks().to_batches()

    own = df.mapInArrow(keep, df.schema)
    merged = own.repartition(F.pmod(F.spark_partition_id(), F.lit(FAN_IN)), *strata).mapInArrow(keep, df.schema)
    w = Window.partitionBy(*strata).orderBy(*order)
    names = {c.lower() for c in df.columns}
    rank = next(f"_rank{i}" for i in range(len(names) + 1) if f"_rank{i}" not in names)
    return merged.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k).drop(rank)


def stratified_sample(df: DataFrame, strata: Sequence[str], per_stratum: int, key: str, seed: int = 0) -> DataFrame:
    """At most per_stratum rows of each stratum, by the MD5 of seed and key; strata with a null in them are left out."""
    names = {c.lower() for c in df.columns}
    digest = next(f"_digest{i}" for i in range(len(names) + 1) if f"_digest{i}" not in names)
    whole = df.dropna(subset=list(strata)).withColumn(digest, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    return bottom_k(whole, strata, [digest, key], per_stratum).drop(digest)


def yearly_sample(df: DataFrame, quota: int = 500, key: str = "url", year: str = "year", seed: int = 20250611) -> DataFrame:
    return stratified_sample(df, [year], quota, key, seed)
