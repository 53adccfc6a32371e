"""Token-id output: shards of raw ids with a minimal perfect hash index for constant-time keyed access.

A shard is two files. `<name>.ids` holds the ids as little-endian unsigned integers (2 bytes while the vocabulary fits),
documents in ascending doc_id order, each with the end id last. `<name>.mph` maps a document key to its slot by a minimal
perfect hash (cascaded collision-free bit arrays, rank = slot) and stores for each slot a 32-bit fingerprint, the start in
the payload and the length. A manifest (Parquet, written by Spark, so only of successful task attempts) names the shards.

The key is doc_id and, where rows repeat an id, their number in text order; a null id is a key of its own and comes first.
Null text is written as the end id alone.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import fresh_dir, give_back, runs_to_index, shuffle_parts, text_chunks
from ._words import mix

END_ID = 2
MANIFEST = "shard string, first_id long, last_id long, n_docs long, n_tokens long, width int"
LOCATED = "doc_id long, occurrence int, shard string, shard_start long, n_tokens long, ids_crc32 long"

#: Byte-level BPE splits texts by a public pattern before merging, so pieces can be encoded once each. This is that pattern
#: with the letters and numbers up to U+024F written out; texts with other characters are encoded whole.
_L, _N = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
UNUSUAL = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ‐-‧€]")
SPACED = re.compile(rf" [{_L}]+")


class _Known(dict):
    """Piece -> number; a new piece gets the next one and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """tokenizers' byte-level BPE with its results kept per piece. Of more than `keep` pieces the half that is used most stays."""

    def __init__(self, path: str, keep: int = 200_000):
        from tokenizers import Tokenizer

        self.lib, self.keep = Tokenizer.from_file(path), keep
        spec = json.loads(self.lib.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre = spec["pre_tokenizer"] or {}
        self.by_piece = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True)
        self.forget()

    def forget(self):
        """Leave only the library's tokenizer."""
        self.known = _Known()
        self.flat, self.begin, self.size = np.zeros(1 << 20, np.uint32), np.zeros(1 << 19, np.int64), np.zeros(1 << 19, np.int32)
        self.uses = np.zeros(0, np.int64)
        self.used = self.done = 0

    def _shrink(self):
        """Leave the pieces that are used most; their uses count half from now on, so that what was frequent once goes in the end."""
        stay = np.sort(np.argpartition(-self.uses, self.keep // 2)[: self.keep // 2])
        pieces, begin, size, uses = list(self.known), self.begin[stay], self.size[stay], self.uses[stay] // 2
        flat = self.flat[runs_to_index(begin, size)]
        self.forget()
        self.known.update((pieces[i], n) for n, i in enumerate(stay.tolist()))
        self.done, self.used, self.uses = len(stay), len(flat), uses
        self.flat = np.concatenate([flat, np.zeros(1 << 20, np.uint32)])
        self.begin, self.size = (np.concatenate([x, np.zeros(len(stay) + 1, x.dtype)]) for x in (np.cumsum(size) - size, size))

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and lengths of pieces that begin with a space, in one call: the library splits their joint text back."""
        e = self.lib.encode("".join(pieces), add_special_tokens=False)
        words = np.array(e.word_ids, np.int64)
        lens = np.bincount(words, minlength=len(pieces))
        return (np.array(e.ids, np.uint32), lens) if len(lens) == len(pieces) and lens.all() else None

    def _learn(self, pieces: list[str]) -> None:
        """Encode the new pieces, numbered from self.done on."""
        n = len(pieces)
        while self.done + n > len(self.size):
            self.begin, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size))
        spaced = np.array([SPACED.fullmatch(p) is not None for p in pieces], bool)
        for own in (np.flatnonzero(spaced), np.flatnonzero(~spaced)):
            part = [pieces[i] for i in own]
            got = self._together(part) if len(part) and spaced[own[0]] else None
            if got is None:
                rows = [e.ids for e in self.lib.encode_batch(part, add_special_tokens=False)]
                got = np.array([x for r in rows for x in r], np.uint32), np.array([len(r) for r in rows], np.int64)
            ids, lens = got
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(ids)] = ids
            self.begin[self.done + own], self.size[self.done + own] = self.used + np.cumsum(lens) - lens, lens
            self.used += len(ids)
        self.done += n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, bounds by text)."""
        if len(self.known) > self.keep:
            self._shrink()
        whole = [i for i, t in enumerate(texts) if not self.by_piece or any(x in t for x in self.special) or (not t.isascii() and UNUSUAL.search(t)) or (t.isascii() and not t.isprintable() and UNUSUAL.search(t))]
        apart = {i: e.ids for i, e in zip(whole, self.lib.encode_batch([texts[i] for i in whole], add_special_tokens=False))}
        split = PIECES.findall
        pieces = [[] if i in apart else split(t) for i, t in enumerate(texts)]
        flat = [p for row in pieces for p in row]
        index = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        if self.known.new:
            new, self.known.new = self.known.new, []
            self._learn(new)
        self.uses = np.bincount(index, minlength=self.done) + np.pad(self.uses, (0, self.done - len(self.uses)))
        lens = self.size[index]
        ids = self.flat[runs_to_index(self.begin[index], lens)]
        per_piece = np.concatenate([[0], np.cumsum(lens)])
        bounds = per_piece[np.concatenate([[0], np.cumsum([len(r) for r in pieces])])]
        if not apart:
            return ids, bounds
        rows = [np.array(apart[i], np.uint32) if i in apart else ids[bounds[i] : bounds[i + 1]] for i in range(len(texts))]
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])


@lru_cache(maxsize=2)
def _encoder(path: str, keep: int) -> Encoder:
    return Encoder(path, keep)


@contextmanager
def _encoding(path: str, keep: int, hold: bool) -> Iterator[Encoder]:
    """The worker's encoder; unless it may hold them, its pieces go with the task."""
    encoder = _encoder(path, keep)
    try:
        yield encoder
    finally:
        if not hold:
            encoder.forget()
            give_back()


def key_hash(ids: np.ndarray, null: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x5851F42D4C957F2D))
    return mix(np.where(null, np.uint64(0x14057B7EF767814F), h) + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: level by level, keys alone in their cell of a bit array are placed."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [int(np.unpackbits(x).sum()) for x in levels]
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        # ones before each byte of a level
        self.rank = [np.concatenate([[0], np.cumsum(np.bitwise_count(x))]).astype(np.int64) for x in levels]

    @staticmethod
    def _cell(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0xA0761D6478BD642F % 2**64)) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.5) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            bits = max(64, int(gamma * len(left)) // 8 * 8)
            cell = cls._cell(left, len(levels), bits)
            alone = np.bincount(cell, minlength=bits)[cell] == 1
            row = np.zeros(bits, np.uint8)
            row[cell[alone]] = 1
            levels.append(np.packbits(row, bitorder="little"))
            left = left[~alone]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no level has it. Keys that were never added may get any slot."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for i, bits in enumerate(self.levels):
            if not len(left):
                break
            cell = self._cell(keys[left], i, len(bits) * 8)
            byte, bit = cell >> 3, (cell & 7).astype(np.uint8)
            hit = ((bits[byte] >> bit) & 1).astype(bool)
            below = np.bitwise_count(bits[byte[hit]] & ((np.uint8(1) << bit[hit]) - np.uint8(1)).astype(np.uint8))
            out[left[hit]] = self.before[i] + self.rank[i][byte[hit]] + below
            left = left[~hit]
        return out


def _index_bytes(keys: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> bytes:
    h = PerfectHash.build(keys)
    slot = h.slots(keys)
    print_, start, size = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u4")
    print_[slot], start[slot], size[slot] = (keys >> np.uint64(32)).astype(np.uint32), starts, lens
    head = struct.pack("<4sII", b"VTPH", len(keys), len(h.levels)) + np.array([len(x) for x in h.levels], "<u8").tobytes()
    return head + b"".join(x.tobytes() for x in h.levels) + print_.tobytes() + start.tobytes() + size.tobytes()


class Shard:
    """An open shard: read(key hashes) gives starts and lengths, -1 for keys that are not in it."""

    def __init__(self, fs: pafs.FileSystem, base: str, width: int):
        with fs.open_input_file(f"{base}.mph") as f:
            raw = f.read()
        magic, n, levels = struct.unpack_from("<4sII", raw)
        if magic != b"VTPH":
            raise ValueError(f"{base}.mph is no index")
        sizes = np.frombuffer(raw, "<u8", levels, 12).astype(np.int64)
        at, bits = 12 + 8 * levels, []
        for size in sizes:
            bits.append(np.frombuffer(raw, np.uint8, size, at))
            at += int(size)
        self.hash = PerfectHash(bits)
        self.print_ = np.frombuffer(raw, "<u4", n, at)
        self.start, self.size = np.frombuffer(raw, "<u8", n, at + 4 * n).astype(np.int64), np.frombuffer(raw, "<u4", n, at + 12 * n).astype(np.int64)
        self.fs, self.base, self.dtype = fs, base, np.dtype(f"<u{width}")

    def locate(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self.hash.slots(keys)
        known = slot >= 0
        known[known] = self.print_[slot[known]] == (keys[known] >> np.uint64(32)).astype(np.uint32)
        slot = np.where(known, slot, 0)
        none = np.full(len(keys), -1, np.int64)
        return (np.where(known, self.start[slot], none), np.where(known, self.size[slot], none)) if len(self.start) else (none, none)

    def ids(self, start: int, n: int) -> np.ndarray:
        with self.fs.open_input_file(f"{self.base}.ids") as f:
            return np.frombuffer(f.read_at(n * self.dtype.itemsize, start * self.dtype.itemsize), self.dtype)


def write_store(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID, width: int = 2, shard_tokens: int = 1 << 25, partitions: int | None = None, keep: int = 200_000, hold: bool = True) -> tuple[str, DataFrame]:
    """Encode every document and write the shards; returns (folder, manifest).

    Range partitions keep doc_id order; each task streams its sorted rows, closing a shard every shard_tokens ids. A retried
    task writes shards of new names; the manifest, committed by Spark, lists those of the attempt that counts. keep: how many
    encoded pieces a worker keeps; hold: whether it keeps them for the next task, which saves time but takes memory (some 170 MB
    for 200,000) from whatever runs on the worker later.
    """
    spark = docs.sparkSession
    path = path or fresh_dir(spark, "tokens")

    def write(batches):
        with _encoding(tokenizer, keep, hold) as encoder:
            yield from written(batches, encoder)

    def written(batches, encoder):
        fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        fs.create_dir(f"{root}/shards", recursive=True)
        shard, last, occurrence = None, object(), 0

        def close(s):
            s["sink"].close()
            ids, lens = np.concatenate(s["ids"]), np.concatenate(s["lens"])
            null, occ = np.concatenate(s["null"]), np.concatenate(s["occ"])
            with fs.open_output_stream(f"{root}/shards/{s['name']}.mph") as f:
                f.write(_index_bytes(key_hash(ids, null, occ), np.cumsum(lens) - lens, lens))
            lo, hi = (None if null[i] else int(ids[i]) for i in (0, -1))
            return pa.RecordBatch.from_arrays([pa.array([s["name"]]), pa.array([lo], pa.int64()), pa.array([hi], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([int(lens.sum())], pa.int64()), pa.array([width], pa.int32())], ["shard", "first_id", "last_id", "n_docs", "n_tokens", "width"])

        for b in text_chunks(batches, "text"):
            flat, bounds = encoder.encode(b.column(1).to_pylist())
            n = b.num_rows
            if len(flat) and int(flat.max()) >= 1 << 8 * width:
                raise ValueError(f"an id needs more than {width} bytes")
            out = np.insert(flat.astype(f"<u{width}"), bounds[1:], end_id)
            lens = np.diff(bounds) + 1
            null = pc.is_null(b.column(0)).to_numpy(zero_copy_only=False)
            ids = b.column(0).fill_null(0).to_numpy()
            occ = np.zeros(n, np.int64)
            for i in range(n):
                key = None if null[i] else int(ids[i])
                occurrence = occurrence + 1 if key == last else 0
                occ[i], last = occurrence, key
            if shard is None:
                name = f"s-{uuid.uuid4().hex}"
                shard = {"name": name, "sink": fs.open_output_stream(f"{root}/shards/{name}.ids"), "ids": [], "lens": [], "null": [], "occ": [], "n": 0}
            shard["sink"].write(out.tobytes())
            for k, v in (("ids", ids), ("lens", lens), ("null", null), ("occ", occ)):
                shard[k].append(v)
            shard["n"] += len(out)
            if shard["n"] >= shard_tokens:
                yield close(shard)
                shard = None
        if shard is not None:
            yield close(shard)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions or 2 * shuffle_parts(spark)
    rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return path, spark.read.parquet(f"{path}/manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with each shard's place in the whole: one row per shard, so one window over all is small."""
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), F.col("last_id").asc_nulls_first(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))


def read_store(docs: DataFrame, path: str) -> DataFrame:
    """Look every document's key up in the store: doc_id, start (ids before it in all), n_tokens, ids_crc32.

    Keys go to the shard whose id range holds them (an id's rows may go on in the next shard), grouped by shard.
    """
    spark = docs.sparkSession
    shards = with_starts(spark.read.parquet(f"{path}/manifest")).where("n_docs > 0")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("rows"))
    table = spark.sparkContext.broadcast([(r["first_id"], r["last_id"], r["shard"], r["start"], r["width"]) for r in shards.orderBy("start").toLocalIterator()])

    def route(batches):
        t = table.value
        none = [i for i, r in enumerate(t) if r[0] is None]
        last = np.array([-(2**63) if r[1] is None else r[1] for r in t], np.int64)
        first = np.array([-(2**63) if r[0] is None else r[0] for r in t], np.int64)
        for b in batches:
            ids, null = b.column(0).fill_null(0).to_numpy(), pc.is_null(b.column(0)).to_numpy(zero_copy_only=False)
            lo, hi = np.searchsorted(last, ids, "left"), np.searchsorted(first, ids, "right")
            lo, hi = np.where(null, none[0] if none else 0, lo), np.where(null, none[-1] + 1 if none else 0, hi)
            count = np.maximum(hi - lo, 0)
            row = np.repeat(np.arange(len(ids)), count)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(runs_to_index(lo, count), pa.int64())], ["doc_id", "rows", "at"])

    def read(batches):
        fs, root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        t, open_, opened = table.value, None, -1
        for b in batches:
            ids, rows, at = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            plain, null = ids.fill_null(0).to_numpy(), pc.is_null(ids).to_numpy(zero_copy_only=False)
            for k in np.unique(at):
                own = np.flatnonzero(at == k)
                if k != opened:
                    open_, opened = Shard(fs, f"{root}/shards/{t[k][2]}", t[k][4]), k
                own = np.repeat(own, rows[own])
                occ = np.arange(len(own)) - np.searchsorted(own, own)
                start, n = open_.locate(key_hash(plain[own], null[own], occ))
                here = start >= 0
                own, start, n = own[here], start[here], n[here]
                crc, by = np.zeros(len(own), np.int64), np.argsort(start)
                with fs.open_input_file(f"{open_.base}.ids") as f:
                    for i in by.tolist():
                        raw = f.read_at(int(n[i]) * open_.dtype.itemsize, int(start[i]) * open_.dtype.itemsize)
                        crc[i] = zlib.crc32(np.frombuffer(raw, open_.dtype).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), pa.array(start + t[k][3]), pa.array(n), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    routed = known.mapInArrow(route, "doc_id long, rows long, at long").repartition(shuffle_parts(spark), "at").sortWithinPartitions("at", "doc_id")
    return routed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
