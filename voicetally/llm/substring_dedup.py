"""Substring dedup: remove the words of every window that also starts elsewhere in the corpus.

Windows are `window` words of one document. Each takes the least k-gram hash within it (winnowing) as its anchor, so equal
windows have equal anchors, and only windows whose anchor stands in two places can repeat. Consecutive windows of one anchor
form a run, and equal runs are one stretch of words that stands in several places. A reference of all repeated text would
grow with the corpus and cannot be broadcast, so it is sharded by anchor: all distinct stretches of an anchor meet in one
task, which builds their suffix automaton (with the places of each) and streams them past it. Matching statistics of `window`
words or more at two places or more are repeats; their maximal spans are removed in every place of the stretch. An anchor of
many stretches is dealt out in blocks of bounded size; each block's automaton counts its windows, and the counts are summed.

Null text has no words; a document of fewer than `window` words keeps them all; repeated rows repeat each other; ids
may be null or stand at several texts (spans are kept by a hash of id and text); an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._io import as_long, binary_rows, bloom_bits, bloom_has, materialize, runs_to_index, shuffle_parts, text_chunks
from .suffix_automaton import SuffixAutomaton

#: Windows in a run at most, so that a run of one anchor in periodic text stays a small row.
RUN = 512
#: Words in one automaton, about.
BLOCK_WORDS = 60_000
#: Anchors up to which a Bloom filter thins runs out where they lie; beyond, all runs are joined.
BLOOM_KEYS = 1 << 25
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _anchors(s: W.Words, window: int, k: int):
    return W.winnow(W.ngram_hash(s.hash, k), W.valid(s.at, k), s.at, window - k + 1)


def _runs(s: W.Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor) of each run; runs break where the anchor changes, at text ends and every RUN."""
    _, least, whole = _anchors(s, window, k)
    at = np.flatnonzero(whole)
    if not len(at):
        return at, at, least[:0]
    anchor, doc = least[at], s.doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    lens = np.diff(np.append(first, len(at)))
    if lens.max() > RUN:
        inside = np.arange(len(at)) - np.repeat(first, lens)
        first = np.flatnonzero(inside % RUN == 0)
        lens = np.diff(np.append(first, len(at)))
    return at[first], lens, anchor[first]


def _digests(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of consecutive pieces of n items each."""
    if not len(flat):
        return flat
    scaled = flat * (runs_to_index(np.zeros_like(n), n).astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
    return W.mix(np.add.reduceat(scaled, np.cumsum(n) - n) + n.astype(np.uint64))


def row_key():
    """Equal for rows of equal id and text only, and never null."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row")


def repeated_spans(docs: DataFrame, window: int = 35, k: int = 8) -> DataFrame:
    """Spans (row, first, n): windows first..first+n of the rows named `row` (by row_key) start elsewhere too."""
    text = docs.select(row_key(), F.col("text").cast("string").alias("text"))
    table, parts = W.space_words(False), shuffle_parts(docs.sparkSession)

    def anchors(batches):
        for b in text_chunks(batches, "text"):
            s = W.scan(b.column(0), table)
            chosen, _, _ = _anchors(s, window, k)
            g, n = np.unique(W.ngram_hash(s.hash, k)[chosen] if len(s.hash) else s.hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(as_long(g)), pa.array(n)], ["anchor", "n"])

    def shared(keys: DataFrame):
        """A test for anchors that may be among the keys."""
        n = keys.count()
        if n > BLOOM_KEYS:
            return None
        return text.sparkSession.sparkContext.broadcast(bloom_bits(keys, "anchor", max(20, (32 * n).bit_length())))

    def runs_of(batches, keep, chunk_rows):
        for b in text_chunks(batches, "text"):
            s = W.scan(b.column(b.schema.get_field_index("text")), table)
            first, n, anchor = _runs(s, window, k)
            own = np.flatnonzero(bloom_has(keep.value, anchor)) if keep else np.arange(len(first))
            first, n, anchor = first[own], n[own], anchor[own]
            digest = _digests(W.ngram_hash(s.hash, window)[runs_to_index(first, n)], n) if len(own) else anchor
            yield chunk_rows(b, s, first, n, anchor, digest)

    def places(b, s, first, n, anchor, digest):
        row = s.doc[first]
        return pa.RecordBatch.from_arrays([pa.array(as_long(anchor)), pa.array(as_long(digest)), b.column(0).take(pa.array(row, pa.int64())), pa.array((first - s.at[row]).astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "run", "row", "first", "n"])

    twice = materialize(text.select("text").mapInArrow(anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"), "dedup-anchors")
    keep = shared(twice)
    found = text.mapInArrow(lambda it: runs_of(it, keep, places), "anchor long, run long, row long, first int, n int")
    found = materialize(found if keep else found.join(twice, "anchor", "left_semi"), "dedup-runs")
    stretches = materialize(found.groupBy("anchor", "run").agg(F.count("*").alias("places"), F.max("n").alias("n")), "dedup-stretches")
    per = stretches.groupBy("anchor").agg(F.count("*").alias("stretches"), F.sum(F.col("n") + window - 1).alias("words"))
    # written before the join, which then has exchanges of its own and can split an anchor of many stretches
    stretches = stretches.join(materialize(per, "dedup-anchor-sizes"), "anchor")
    # also the only stretch of an anchor: its automaton knows its places, and a stretch at one place may hold a window twice
    several = stretches.select("anchor", "run", "places", (F.expr(f"words div {BLOCK_WORDS}") + 1).cast("int").alias("blocks"))

    def contents(b, s, first, n, anchor, digest):
        _, at = np.unique(digest, return_index=True)
        first, n = first[at], n[at] + window - 1
        return pa.RecordBatch.from_arrays([pa.array(as_long(digest[at])), binary_rows(s.hash[runs_to_index(first, n)], np.concatenate([[0], np.cumsum(n)]))], ["run", "words"])

    few = shared(several.select("anchor").distinct())
    words = text.select("text").mapInArrow(lambda it: runs_of(it, few, contents), "run long, words binary").dropDuplicates(["run"])
    dealt = several.join(words, "run").withColumn("block", F.pmod(F.xxhash64("run"), "blocks").cast("int")).select("anchor", "block", "blocks", "run", "places", "words")
    dealt = dealt.repartition(parts, "anchor", "block").sortWithinPartitions("anchor", "block", "run")
    settled = materialize(dealt.mapInArrow(lambda it: _repeats(it, window), "run long, at int, n int, win long, places long"), "dedup-repeats")
    # windows that stand once in their block, of anchors in several blocks: counts of all blocks together
    parted = settled.where("win is not null")
    again = materialize(parted.groupBy("win").agg(F.sum("places").alias("places")).where("places > 1").select("win"), "dedup-again")
    repeats = settled.where("win is null").select("run", "at", "n").unionByName(parted.where("run is not null").join(again, "win", "left_semi").select("run", "at", "n"))
    # written first, so that the join has exchanges of its own and a run of many places can be split
    repeats = materialize(repeats, "dedup-spans")
    return found.join(repeats.withColumnRenamed("n", "len"), "run").select("row", (F.col("first") + F.col("at")).alias("first"), F.col("len").alias("n"))


def _repeats(batches, window: int):
    """Of rows (anchor, block, blocks, run, places, words) in order: the maximal spans (run, at, n) of windows that stand at two
    places or more. Of anchors in several blocks also, by the window's hash: those that stand once in their block, and (without
    a run) the others' places in the block."""

    def settle(rows):
        seqs = [np.frombuffer(r[4], np.uint64) for r in rows]
        automaton = SuffixAutomaton(seqs, [r[3] for r in rows])
        met: set[int] = set()
        for (_, blocks, run, _, _), seq in zip(rows, seqs):
            places = automaton.places(seq, window)[window - 1 :]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], (places > 1).astype(np.int8), [0]]))).tolist()
            yield from ((run, a, z - a, None, None) for a, z in zip(edge[::2], edge[1::2]))
            if blocks > 1:
                for at, (win, n) in enumerate(zip(as_long(W.ngram_hash(seq, window)[: len(places)]).tolist(), places.tolist())):
                    if n == 1:
                        yield run, at, 1, win, 1
                    elif win not in met:
                        met.add(win)
                        yield None, None, None, win, n

    def batch(out):
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["run", "at", "n", "win", "places"])

    now, rows, out = None, [], []
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns]):
            if r[:2] != now:
                out += settle(rows) if rows else []
                now, rows = r[:2], []
                if len(out) > 10_000:
                    yield batch(out)
                    out = []
            rows.append(r[1:])
    out += settle(rows) if rows else []
    yield batch(out)


def dedup(docs: DataFrame, window: int = 35, k: int = 8) -> DataFrame:
    """Each document with its number of words, of words removed, the kept text and the SHA-256 of it."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key())
    spans = repeated_spans(docs, window, k).groupBy("row").agg(F.collect_set(F.struct("first", "n")).alias("spans"))
    table = W.space_words(False)
    both = text.join(spans.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "spans")

    def cut(batches):
        for b in text_chunks(batches, "text"):
            s = W.scan(b.column(1), table, hashes=False)
            gone = np.zeros(len(s.start) + 1, np.int64)
            spans = b.column(2)
            if len(s.start):
                part = spans.flatten()
                count = pc.list_value_length(spans).fill_null(0).to_numpy().astype(np.int64)
                lo = np.repeat(s.at[:-1], count) + part.field(0).to_numpy()
                np.add.at(gone, lo, 1)
                np.add.at(gone, lo + part.field(1).to_numpy() + window - 1, -1)
            keep = np.cumsum(gone[:-1]) == 0
            total = np.concatenate([[0], np.cumsum(keep)])
            n, kept = np.diff(s.at), total[s.at[1:]] - total[s.at[:-1]]
            # bytes of the kept words, each with one space behind it
            lens = (s.end - s.start)[keep]
            room = np.concatenate([[0], np.cumsum(lens + 1)])
            out = np.full(int(room[-1]), 0x20, np.uint8)
            if len(lens):
                out[runs_to_index(room[:-1], lens)] = s.data[runs_to_index(s.start[keep], lens)]
            mem = memoryview(out.tobytes())
            lo, hi = room[total[s.at[:-1]]], room[total[s.at[1:]]]
            kept_text = [bytes(mem[a : max(a, z - 1)]) for a, z in zip(lo.tolist(), hi.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(n - kept), pa.array([hashlib.sha256(x).hexdigest() for x in kept_text]), pa.array(kept_text, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return both.mapInArrow(cut, RESULT + ", kept_text string")
