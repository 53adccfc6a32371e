"""Shared-folder materialisation, Bloom summaries and Arrow batch helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import mix

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a private temporary one only in a local session where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="voicetally-")
    return _OWN["dir"]


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut and survives lost executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As materialize(), and the table's path, for discard() once its last reader is done."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that stored() wrote, in whatever store the shared folder is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def as_hash(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def give_back() -> None:
    """At the end of a task or group: workers are used again, and what Arrow and the C library hold back is of no use to the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(f, *args):
    """f(*args), and then what was held for it is given back."""
    out = f(*args)
    give_back()
    return out


def text_chunks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 2_000_000, max_rows: int = 60_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about max_bytes of text and at most max_rows rows each; null text becomes the empty string.

    Whole rows stay together, so one very long text makes one large slice.
    """
    for b in batches:
        i = b.schema.get_field_index(text)
        col = b.column(i).cast(pa.large_string()).fill_null("")
        b = b.set_column(i, text, col)
        off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset :] if len(col) else np.zeros(1, np.int64)
        lo = 0
        while lo < b.num_rows:
            hi = min(max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1), lo + max_rows)
            yield b.slice(lo, hi - lo)
            lo = hi
    give_back()


def binary_rows(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Each values[bounds[i]:bounds[i+1]] as one binary cell."""
    v = np.ascontiguousarray(values)
    off = (bounds.astype(np.int64) * v.itemsize)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(off), pa.py_buffer(v)]).cast(pa.binary())


def cell_values(col: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Reverse of binary_rows: all values in order, and the bounds of each row."""
    col = col.cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, dtype), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset :]
    size = np.dtype(dtype).itemsize
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
    return np.frombuffer(data.tobytes(), dtype=dtype), (off - off[0]) // size


def runs_to_index(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+len."""
    lens = lens.astype(np.int64)
    if not lens.sum():
        return np.zeros(0, np.int64)
    at = np.cumsum(lens) - lens
    return np.arange(int(lens.sum())) - np.repeat(at - starts, lens)


BLOOM_SLICES = 64


def bloom_bits(df: DataFrame, key: str, log2_bits: int = 27) -> np.ndarray:
    """A Bloom filter (two probes) of the long column key, as a bit array of fixed size. Keys are mixed first: they may be least
    hashes of windows, which are far from even.

    Bits are split into 64 slices by hash; keys go to tasks by their slice, so the driver gets 2**log2_bits / 8 bytes
    whatever the number of keys. It only thins out candidates: an exact join always follows.
    """
    per = (1 << log2_bits) // BLOOM_SLICES

    def mixed(batches):
        for b in batches:
            h = mix(as_hash(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array(as_long(h)), pa.array(_probes(h, per)[0])], ["h", "slice"])

    def fill(batches):
        slices: dict[int, np.ndarray] = {}
        for b in batches:
            s, p, q = _probes(as_hash(b.column(0)), per)
            for k in np.unique(s):
                bits = slices.setdefault(int(k), np.zeros(per // 8, np.uint8))
                own = s == k
                for x in (p[own], q[own]):
                    np.bitwise_or.at(bits, x >> 3, (1 << (x & 7)).astype(np.uint8))
        for k, bits in slices.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["slice", "bits"])

    hashed = df.select(key).mapInArrow(mixed, "h long, slice long").repartition(BLOOM_SLICES, "slice")
    out = np.zeros((1 << log2_bits) // 8, np.uint8)
    for r in hashed.mapInArrow(fill, "slice int, bits binary").collect():
        lo = r["slice"] * per // 8
        out[lo : lo + per // 8] |= np.frombuffer(r["bits"], np.uint8)
    return out


def _probes(h: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s = (h >> np.uint64(58)).astype(np.int64)
    p = (h & np.uint64(per - 1)).astype(np.int64)
    q = ((h >> np.uint64(29)) & np.uint64(per - 1)).astype(np.int64)
    return s, p, q


def bloom_has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    per = len(bits) * 8 // BLOOM_SLICES
    s, p, q = _probes(mix(h), per)
    base = s * (per // 8)
    hit = (bits[base + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1
    at = np.flatnonzero(hit)
    out = np.zeros(len(h), bool)
    out[at] = ((bits[base[at] + (q[at] >> 3)] >> (q[at] & 7).astype(np.uint8)) & 1).astype(bool)
    return out


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    i = next(i for i in range(len(taken) + 1) if not any(f"{x}{i}".lower() in taken for x in stems))
    return [f"{x}{i}" for x in stems]


def filter_rows(docs: DataFrame, keep) -> DataFrame:
    """docs with the rows for which keep(texts) is true, in one pass and with all its columns, whatever their names.

    keep: a function made on the worker per partition: from an Arrow column of texts without nulls to a boolean array.
    """
    at = docs.columns.index("text")

    def run(batches):
        mask = keep()
        for b in batches:
            texts = pa.RecordBatch.from_arrays([b.column(at)], ["text"])
            flags = [mask(t.column(0)) for t in text_chunks(iter([texts]), "text")]
            yield b.filter(pa.array(np.concatenate(flags))) if flags else b

    return docs.mapInArrow(run, docs.schema)


def drop_keys(docs: DataFrame, gone: DataFrame, key: str, max_broadcast: int = 2_000_000) -> DataFrame:
    """docs without the rows whose key is in gone: by broadcast up to max_broadcast keys, else by a shuffled hash join."""
    side = F.broadcast(gone) if gone.count() <= max_broadcast else gone.hint("shuffle_hash")
    return docs.join(side, key, "left_anti")
