"""Product quantisation of integer vectors, its codebooks learned by Yinyang Lloyd rounds.

Components become integers, floor(4096 * x), so that distances, sums and means are exact and do not depend on partitions. A
part's codebook entries are clustered into a few groups once. A row carries, per part, its entry and one lower bound per group
on the distance to the group's other entries. When a round has moved the entries, a bound sinks by its group's largest drift; a
group is scanned only if its bound no longer lies above the distance to the row's own entry. Bounds only skip work: they are
rounded down, and what is scanned is compared by exact integer distances, ties by the lower index.

A round is one pass over a table of rows with their integers and bounds, written to the shared folder; the table before it is
deleted. Tasks add up integer sums per entry, and the driver gets the codebooks' size of them, whatever the number of rows.

Rows whose vector is null or holds a null or non-finite component are dropped. Rows with no id are coded but do not seed the
codebooks (unless no row has an id); of repeated ids the vector least by its bytes seeds. With fewer than 16 ids there are fewer
entries. The dimension is that of the longest vector and is rounded up to a multiple of the parts; missing components are 0. So
empty vectors have the code of zeros. An empty table gives no rows. A vector too large for distances in 64 bits is an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import binary_rows, cell_values, discard, stored

SCALE, PARTS, ENTRIES, ROUNDS, GROUPS = 4096, 8, 16, 6, 4
#: Labels up to this number are joined by broadcast (16 bytes each).
MAX_BROADCAST = 1_000_000
SALTS = 16
HEX = np.array([f"{i:02x}".encode() for i in range(256)], "S2")


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the vector of the rows that are kept."""
    v = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.where(F.col("v").isNotNull() & ~bad)


def packed(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Kept rows with their integers as bytes (x, 4 each) and how many there are (n)."""
    kept = usable(vectors)
    types = dict(kept.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(2)
            n = pc.list_value_length(col).to_numpy(zero_copy_only=False)
            whole = np.floor(scale * col.flatten().to_numpy(zero_copy_only=False))
            if len(whole) and np.abs(whole).max() >= 2**31:
                raise ValueError("a component is too large for exact distances")
            x = binary_rows(whole.astype("<i4"), np.concatenate([[0], np.cumsum(n)]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x, pa.array(n, pa.int32())], ["vec_id", "label", "x", "n"])

    return kept.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, x binary, n int")


def seeds(rows: DataFrame, entries: int = ENTRIES) -> list[bytes]:
    """The integers of the rows with the smallest ids. Tasks keep their own smallest ids, so few rows are compared."""

    def least(batches):
        best = None
        for b in batches:
            ids = b.column(0).drop_null()
            ids = pc.unique(ids if best is None else pa.concat_arrays([best, ids]))
            best = ids.take(pc.sort_indices(ids)[:entries])
        if best is not None:
            yield pa.RecordBatch.from_arrays([best], ["vec_id"])

    ids = [r[0] for r in rows.select("vec_id").mapInArrow(least, f"vec_id {dict(rows.dtypes)['vec_id']}").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return [bytes(r["x"]) for r in rows.orderBy("x").limit(entries).collect()]
    found = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect()
    return [bytes(r["x"]) for r in found]


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers as one matrix, shorter rows filled up with zeros."""
    data, at = cell_values(col, "<i4")
    n = np.diff(at)
    if (n == dim).all():
        return data.reshape(len(n), dim).astype(np.float64)
    out = np.zeros((len(n), dim))
    out[np.arange(dim) < n[:, None]] = data
    return out


def squares(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a to rows of c. Doubles hold whole numbers below 2**53 exactly, so the product form is
    exact while every term stays below; else 64-bit integers."""
    most = max(np.abs(a).max(initial=0), np.abs(c).max(initial=0))
    room = max(1, a.shape[1]) * 4 * float(most) ** 2
    if room < 2.0**52:
        return (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    if room >= 2.0**62:
        raise ValueError("a vector is too large for exact distances")
    out = np.empty((len(a), len(c)), np.int64)
    for k, entry in enumerate(c.astype(np.int64)):
        out[:, k] = ((a.astype(np.int64) - entry) ** 2).sum(1)
    return out


def own_squares(a: np.ndarray, c: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a to their entries."""
    d = a - c[code]
    if max(1, a.shape[1]) * float(np.abs(d).max(initial=0)) ** 2 < 2.0**52:
        return (d * d).sum(1)
    d = d.astype(np.int64)
    return (d * d).sum(1)


def down(x: np.ndarray) -> np.ndarray:
    """Lower bounds in two bytes: never above x."""
    h = np.minimum(np.maximum(x, 0), 65504).astype(np.float16)
    return np.where(h.astype(np.float64) > x, np.nextafter(h, np.float16(0)), h)


def grouped(entries: np.ndarray, groups: int) -> np.ndarray:
    """Entries clustered into groups by a few Lloyd rounds of their own; any grouping is right, a tight one skips more."""
    k = len(entries)
    g = min(groups, k)
    if not g:
        return np.zeros(0, int)
    centers = entries[np.linspace(0, k - 1, g).astype(int)].astype(float)
    of = np.zeros(k, int)
    for _ in range(5):
        of = ((entries[:, None].astype(float) - centers) ** 2).sum(2).argmin(1)
        centers = np.array([entries[of == i].mean(0) if (of == i).any() else centers[i] for i in range(g)])
    return of


class Codebooks:
    """Entries by part, their groups, and how far each group has moved at most in the last update."""

    def __init__(self, entries: np.ndarray, groups: int):
        self.entries = entries  # (parts, k, width) whole numbers
        self.of = np.array([grouped(e, groups) for e in entries])
        self.groups = min(groups, entries.shape[1])
        self.drift = np.zeros((len(entries), self.groups))

    def move(self, sums: np.ndarray, counts: np.ndarray) -> None:
        """Entries become the floor of their means; unused ones stay."""
        new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], self.entries)
        far = np.sqrt(((new - self.entries).astype(float) ** 2).sum(2)) * (1 + 1e-9)
        for j, of in enumerate(self.of):
            self.drift[j] = [far[j][of == g].max(initial=0) for g in range(self.groups)]
        self.entries = new

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def assign(a: np.ndarray, c: np.ndarray, of: np.ndarray, groups: int, code: np.ndarray | None, low: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of rows of one part: (entry, exact squared distance, new bounds by group, distances computed by scans).

    code and low: the entries of the last round and bounds that have sunk by the drift; None scans all.
    """
    n = len(a)
    members = [np.flatnonzero(of == g) for g in range(groups)]
    if code is None:
        code, low = np.zeros(n, np.int64), np.full((n, groups), -1.0)
    own = own_squares(a, c, code)
    low = low.copy()
    scan = low <= np.sqrt(own.astype(float))[:, None] * (1 + 1e-9)
    best, at, seen, done = own.copy(), code.copy(), {}, 0
    for g, m in enumerate(members):
        rows = np.flatnonzero(scan[:, g])
        if not len(rows) or not len(m):
            continue
        d = squares(a[rows], c[m])
        done += d.size
        first = d.argmin(1)
        least, entry = d[np.arange(len(rows)), first], m[first]
        nearer = (least < best[rows]) | ((least == best[rows]) & (entry < at[rows]))
        best[rows[nearer]], at[rows[nearer]] = least[nearer], entry[nearer]
        seen[g] = rows, d
    place = np.zeros(len(c), int)
    for m in members:
        place[m] = np.arange(len(m))
    for g, (rows, d) in seen.items():  # the bound is on the entries of the group besides the row's own
        d = d.astype(float)
        here = of[at[rows]] == g
        d[np.flatnonzero(here), place[at[rows[here]]]] = np.inf
        low[rows, g] = np.sqrt(d.min(1)) * (1 - 1e-9)
    moved = np.flatnonzero((at != code) & ~scan[np.arange(n), of[code]])
    low[moved, of[code[moved]]] = np.minimum(low[moved, of[code[moved]]], np.sqrt(own[moved].astype(float)) * (1 - 1e-9))
    return at, best, low, done


def _round(rows: DataFrame, books: Codebooks, dim: int, last: bool) -> DataFrame:
    """All rows assigned anew: with their bounds and the sums of each batch, or at last with code and error."""
    types, parts, width = dict(rows.dtypes), len(books.entries), dim // max(1, len(books.entries))
    entries, of, groups, drift, k, first = books.entries.astype(float), books.of, books.groups, books.drift, books.entries.shape[1], "s" not in rows.columns
    cell = np.dtype([("code", "u1"), ("low", "<f2", (groups,))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(2), dim)
            n, scanned = len(x), 0
            state = np.zeros((n, parts), cell)
            old = None if first else cell_values(b.column(3), cell)[0].reshape(n, parts)
            error, sums = np.zeros(n, np.int64), np.zeros((parts, k, width + 1), np.int64)
            for j in range(parts):
                a = x[:, j * width : (j + 1) * width]
                low = None if old is None else old["low"][:, j].astype(float) - drift[j]
                code, d, low, done = assign(a, entries[j], of[j], groups, None if old is None else old["code"][:, j].astype(np.int64), low)
                state["code"][:, j], error, scanned = code, error + d.astype(np.int64), scanned + done
                if not last:
                    state["low"][:, j] = down(low)
                    for entry in np.unique(code):
                        own = code == entry
                        sums[j, entry, :width], sums[j, entry, width] = a[own].sum(0), own.sum()
            if last:
                codes = HEX[state["code"]].view(f"S{2 * parts}").ravel()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes.astype(str), pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])
            else:
                u = np.concatenate([[n * parts * k, scanned], sums.ravel()]).astype("<i8").tobytes()
                bounds = binary_rows(state.ravel(), np.arange(n + 1) * parts)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), bounds, pa.array([None] * (n - 1) + [u], pa.binary())], ["vec_id", "label", "x", "s", "u"])

    out = f"vec_id {types['vec_id']}, label {types['label']}, " + ("code string, error long" if last else "x binary, s binary, u binary")
    return rows.select("vec_id", "label", "x", *([] if first else ["s"])).mapInArrow(run, out)


def summed(state: DataFrame, size: int) -> np.ndarray:
    """The batches' sums of a round, added up: `size` numbers, whatever the number of rows."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for u in b.column(0).to_pylist():
                total += np.frombuffer(u, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

    parts = state.where("u is not null").select("u").mapInArrow(run, "i long, v long")
    out = np.zeros(size, np.int64)
    for i, v in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[i] = v
    return out


def encode(vectors: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, groups: int = GROUPS, work: list[tuple[int, int]] | None = None) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept row, and the final entries (parts, entries, width).

    work: gets per round the distances that plain Lloyd rounds compute, and those that scans computed here.
    """
    spark = vectors.sparkSession
    rows, at = stored(packed(vectors), "vectors")
    longest = rows.agg(F.max("n")).first()[0] or 0
    dim = -(-longest // parts) * parts
    first = [np.frombuffer(x, "<i4") for x in seeds(rows, entries)]
    start = np.array([np.pad(x, (0, dim - len(x))) for x in first], np.int64).reshape(len(first), parts, dim // parts).swapaxes(0, 1)
    books = Codebooks(start, groups)
    shape = (parts, len(first), dim // parts + 1)
    for _ in range(rounds if len(first) else 0):
        state, path = stored(_round(rows, books, dim, False), "vector-bounds")
        u = summed(state, int(np.prod(shape)) + 2)
        if work is not None:
            work.append((int(u[0]), int(u[1])))
        sums = u[2:].reshape(shape)
        books.move(sums[:, :, :-1], sums[:, :, -1])
        discard(spark, at)
        rows, at = state, path
    coded, _ = stored(_round(rows, books, dim, True), "vector-codes")
    discard(spark, at)
    return coded, books.entries


def quantize(vectors: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """encode(), with the errors summed over equal labels (nulls together) and the digest of the codebooks."""
    coded, books = encode(vectors)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    per = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_of")
    per, _ = stored(per, "label-errors")
    same = F.col("label").eqNullSafe(F.col("_of"))
    if per.count() <= max_broadcast:
        joined = coded.join(F.broadcast(per), same)
    else:  # both sides are dealt by a salt too, so that a label with very many rows is spread
        salted = per.withColumn("_to", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = coded.withColumn("_from", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))).join(salted, same & (F.col("_from") == F.col("_to")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Plain Lloyd rounds for DuckDB, a CTE for each step."""
    far = "list_sum(list_transform(range(1, len(p.c) + 1), lambda i: (p.c[i] - b.c[i]) * (p.c[i] - b.c[i])))::BIGINT"
    out = [
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT id, vec_id, label, j, v[j * len(v) // {PARTS} + 1:(j + 1) * len(v) // {PARTS}] AS c FROM k, range({PARTS}) AS r(j))",
        f"b0 AS MATERIALIZED (SELECT j, e, c FROM (SELECT j, c, dense_rank() OVER (ORDER BY vec_id) - 1 AS e FROM p) WHERE e < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        out.append(f"a{r} AS MATERIALIZED (SELECT id, j, any_value(p.c) AS c, min(struct_pack(d := {far}, e := b.e)) AS n FROM p JOIN b{r} AS b USING (j) GROUP BY 1, 2)")
        if r < ROUNDS:
            out.append(
                f"b{r + 1} AS MATERIALIZED (SELECT b.j, b.e, coalesce(list_transform(s, lambda x: ((x - ((x % m) + m) % m) // m)::BIGINT), b.c) AS c FROM b{r} AS b LEFT JOIN "
                f"(SELECT j, e, list(x ORDER BY i) AS s, any_value(m) AS m FROM (SELECT j, n.e AS e, i, sum(c[i])::BIGINT AS x, count(*)::BIGINT AS m FROM a{r}, unnest(range(1, len(c) + 1)) AS u(i) GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (j, e))"
            )
    return (
        "WITH "
        + ",\n".join(out)
        + f""",
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, e)) AS h FROM b{ROUNDS}),
f AS (SELECT id, string_agg(printf('%02x', n.e::INT), '' ORDER BY j) AS code, sum(n.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM f JOIN k USING (id), h"""
    )


SQL = _sql()
