"""Lookups in tables of any size: the interval that a point lies in, and the latest row at or before a point.

Both work on the distinct points of each key, which are combined before they are shuffled and scanned with the table's rows by
ranges; what they find is joined back by equality. No side is broadcast by a hint, and no join is a nested loop.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import discard, stored
from .scans import PART, ranged

MIN, MAX = -(2**63), 2**63 - 1


def axis(df: DataFrame, c: str) -> Column:
    """A date, timestamp or whole number as a long: days, microseconds, or itself."""
    kind = dict(df.dtypes)[c]
    if kind == "date":
        return F.unix_date(c).cast("long")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(c).cast("timestamp"))
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(c).cast("long")
    raise TypeError(f"{c} is {kind}: a date, timestamp or whole number is needed")


def _points(df: DataFrame, point: str, by: Sequence[str]) -> DataFrame:
    """The distinct keys and points, as _k0, _k1, ... and _p."""
    return df.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], axis(df, point).alias("_p")).where("_p is not null").distinct()


def _back(df: DataFrame, found: DataFrame, point: str, by: Sequence[str], out: Sequence[str]) -> DataFrame:
    """df with what was found for its keys and points (a struct _v), as the columns out; null where nothing was."""
    same = axis(df, point) == F.col("_p")
    for i, b in enumerate(by):
        same &= df[b] == F.col(f"_k{i}")
    return df.join(found, same, "left").select(*[df[c] for c in df.columns], *[F.col(f"_v.{c}").alias(c) for c in out])


def interval_lookup(df: DataFrame, point: str, table: DataFrame, lo: str, hi: str, values: Sequence[str], by: Sequence[str] = (), order: str | None = None, rows: int = 200_000) -> DataFrame:
    """df with the `values` of the table's row whose interval [lo, hi) holds the point and whose `by` columns equal the row's.

    A null hi has no end; a null lo, or an interval with nothing in it, holds no point. Of several intervals the one with the
    smallest `order` counts (by default the smallest lo, then hi, nulls last, then values). Rows whose point or key is null, or
    in no interval, get nulls, and every row of df comes back once.

    Points and intervals are dealt to ranges of the keys and points, of about `rows` rows each. An interval stands in the range
    where it begins and in the one where it ends; of those that go over all of a range only the smallest gets there. So no interval
    meets each of its points, and the work grows with points and intervals, not with how many intervals hold a point.
    """
    spark, keys = df.sparkSession, [f"_k{i}" for i in range(len(by))]
    known = " and ".join(["true", *(f"{k} is not null" for k in keys)])
    end = F.coalesce(axis(table, hi), F.lit(2**62))
    t = table.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], axis(table, lo).alias("_lo"), end.alias("_hi"), F.struct(*([F.col(order).alias("_o")] if order else []), axis(table, lo).alias("_l"), end.alias("_h"), *values).alias("_v"))
    # where a key stands in the order of the ranges does not matter, so keys of any type are dealt by a hash
    place = F.xxhash64(*keys) if keys else F.lit(0).cast("long")
    # places in the order, of 8 bytes that do not compress, are made again rather than stored
    t, spans = stored(t.where(f"{known} and _lo < _hi"), "spans")
    p, points = stored(_points(df, point, by).where(known), "points")
    t, p = t.withColumn("_at", place), p.withColumn("_at", place)
    cuts = _cuts(p.select("_at", "_p").unionByName(t.select("_at", F.col("_lo").alias("_p"))).unionByName(t.select("_at", (F.col("_hi") - 1).alias("_p"))), rows)
    parted = t.mapInArrow(_parted(cuts), _schema(t, PART, "_a", "_b", "_many")).groupBy(PART, "_many", *keys, "_a", "_b").agg(F.min("_v").alias("_v"))
    parted = parted.withColumn(PART, F.explode(F.sequence(F.col(PART), F.col(PART) + F.col("_many") - 1))).select(PART, *keys, "_a", "_b", "_v")
    dealt = p.mapInArrow(_dealt(cuts), _schema(p, PART)).select(PART, *keys, F.col("_p").alias("_a"))
    both = parted.unionByName(dealt, allowMissingColumns=True).repartition(PART).sortWithinPartitions(PART, F.col("_v").isNull(), "_v")
    found = both.mapInArrow(_smallest(keys), _schema(both.select(*keys, F.col("_a").alias("_p"), "_v")))
    done, _ = stored(found.withColumn("_v", F.struct(*[F.col(f"_v.{c}").alias(c) for c in values])), "intervals")
    discard(spark, spans, points)
    return _back(df, done, point, by, values)


def _schema(df: DataFrame, *longs: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(c, T.LongType()) for c in longs)])


def _cuts(places: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ranges of about so many rows begin, from those rows whose hash falls into a share that leaves some 100,000."""
    n = places.count()
    share = max(1, n // 100_000)
    seen = places.where(F.pmod(F.xxhash64("_at", "_p"), F.lit(share)) == 0) if n > rows else places.limit(0)
    at = seen.select("_at", "_p").sort("_at", "_p").toPandas()
    cut = at.iloc[np.linspace(0, len(at), n // rows + 1)[1:-1].astype(int)].drop_duplicates() if len(at) else at
    return cut["_at"].to_numpy(np.int64), cut["_p"].to_numpy(np.int64)


def _below(at: np.ndarray, p: np.ndarray, of_at: np.ndarray, of_p: np.ndarray, same: bool) -> np.ndarray:
    """For each place of the second pair how many of the first lie before it (or, with same, at it)."""
    n = len(at)
    own = np.arange(n + len(of_at)) < n
    order = np.lexsort((own != same, np.concatenate([p, of_p]), np.concatenate([at, of_at])))
    out = np.empty(n + len(of_at), np.int64)
    out[order] = np.cumsum(own[order])
    return out[n:]


def _column(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _dealt(cuts: tuple[np.ndarray, np.ndarray]):
    """Points with the number of their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = _below(*cuts, _column(b, "_at"), _column(b, "_p"), True)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], [*b.schema.names, PART])

    return run


def _parted(cuts: tuple[np.ndarray, np.ndarray]):
    """Intervals as what they are in ranges: where they begin, where they end, and the ranges between, as two runs of 2**k of them
    (_many) that overlap. Beyond their ends _a and _b are open, so that intervals alike in a range are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, lo, hi = (_column(b, c) for c in ("_at", "_lo", "_hi"))
            first, last = _below(*cuts, at, lo, True), _below(*cuts, at, hi - 1, True)
            one, far = np.flatnonzero(first == last), np.flatnonzero(first < last)
            full = np.flatnonzero(last - first > 1)
            many = 1 << np.frexp((last - first - 1)[full])[1].astype(np.int64) - 1
            row = np.concatenate([one, far, far, full, full])
            part = np.concatenate([first[one], first[far], last[far], first[full] + 1, last[full] - many])
            open_, shut = np.full(2 * len(full), MIN), np.full(2 * len(full), MAX)
            a = np.concatenate([lo[one], lo[far], np.full(len(far), MIN), open_])
            z = np.concatenate([hi[one], np.full(len(far), MAX), hi[far], shut])
            runs = np.concatenate([np.ones(len(one) + 2 * len(far), np.int64), many, many])
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(row)).columns, *map(pa.array, (part, a, z, runs))], [*b.schema.names, PART, "_a", "_b", "_many"])

    return run


def _smallest(keys: Sequence[str]):
    """For the points of each range the first interval that holds them; intervals come in order, before the points."""

    def of_range(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows - rows["_v"].null_count
        spans, points = rows.slice(0, n), rows.slice(n)
        group = np.zeros(rows.num_rows, np.int64)
        for k in keys:
            code = rows[k].combine_chunks().dictionary_encode().indices.to_numpy()
            group = np.unique(group * (int(code.max()) + 1) + code, return_inverse=True)[1]
        a, z, p = spans["_a"].to_numpy(), spans["_b"].to_numpy(), points["_a"].to_numpy()
        order = np.lexsort((p, group[n:]))
        g, p = group[n:][order], p[order]
        # intervals as runs of points; a run is two runs of 2**k that overlap, and from the longest on each hands down to its halves
        i, j = _below(g, p, group[:n], a, False), _below(g, p, group[:n], z, False)
        own = np.flatnonzero(i < j)
        size = np.frexp((j - i)[own])[1] - 1
        best = np.full(len(p), n)
        for k in range(int(size.max(initial=0)), -1, -1):
            now, w = best, own[size == k]
            best = now.copy()
            if (half := 1 << k) < len(p):
                best[half:] = np.minimum(best[half:], now[:-half])
            for start in (i[w], j[w] - (1 << k)):
                np.minimum.at(best, start, w)
        hit = np.flatnonzero(best < n)
        out = points.take(pa.array(order[hit])).select([*keys, "_a"]).rename_columns([*keys, "_p"])
        yield from out.append_column("_v", spans["_v"].take(pa.array(best[hit]))).combine_chunks().to_batches(max_chunksize=10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            part = _column(b, PART)
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
            for start, stop in zip(edges, edges[1:]):
                if kept and part[start] != now:
                    yield from of_range(pa.Table.from_batches(kept))
                    kept = []
                kept.append(b.slice(start, stop - start))
                now = part[start]
        if kept:
            yield from of_range(pa.Table.from_batches(kept))

    return run


def asof_lookup(df: DataFrame, point: str, table: DataFrame, at: str, values: Sequence[str], by: Sequence[str] = (), within: int | None = None, parts: int | None = None) -> DataFrame:
    """df with the `values` of the table's latest row at or before the point, of the same `by` columns.

    within: how far back a row may lie at most, in days for dates, microseconds for timestamps. Of rows at one place the one with
    the largest values counts. Rows whose point or key is null, or that have no such row, get nulls; every row comes back once.

    Points and table rows are scanned together by ranges of their order; what a range ends with is carried into later ones.
    """
    spark, keys = df.sparkSession, [f"_k{i}" for i in range(len(by))]
    rows = table.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], axis(table, at).alias("_p"), F.struct(axis(table, at).alias("_at"), *values).alias("_v")).where("_p is not null")
    rows = rows.groupBy(*keys, "_p").agg(F.max("_v").alias("_v"))
    both, path = ranged(rows.withColumn("_is", F.lit(0)).unionByName(_points(df, point, by).withColumn("_is", F.lit(1)), allowMissingColumns=True), keys, ["_p"], parts)
    upto = Window.partitionBy(PART, *keys).orderBy("_p", "_is").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("_own", F.last("_v", ignorenulls=True).over(upto)).where("_is = 1").select(PART, *keys, "_p", "_own")
    # a row for each range and key that has points or table rows; those of one key are as many as there are ranges at most
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(PART, *keys).agg(F.max(F.when(F.col("_is") == 0, F.col("_v"))).alias("_end"))
    carried = ends.select(PART, *keys, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    found = own.join(carried, [PART, *keys]).withColumn("_v", F.coalesce("_own", "_carry")).where("_v is not null")
    if within is not None:
        found = found.where(F.col("_p") - F.col("_v._at") <= within)
    done, _ = stored(found.select(*keys, "_p", "_v"), "asof")
    discard(spark, path)
    return _back(df, done, point, by, values)

