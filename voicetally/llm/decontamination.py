"""Benchmark decontamination by winnowing.

Both sides keep the least k-gram hash of every w consecutive k-grams (k + w - 1 = window), so a span of `window` equal
words always shares a fingerprint at the same place. Shared fingerprints are joined and each hit is extended word by word
to both sides; hits of `window` words or more count.

The benchmark's fingerprints are broadcast while they are few enough (`max_broadcast_words`); otherwise both sides'
fingerprints are dealt by hash and joined with the words around them. Both ways give the same rows.

Null or wordless texts have no words; an item shorter than `window` words is one window of its own length; rows of one
item_id are one item, rows without an item_id are one item that is counted but has no name in the list. Each row of the
documents gives a row, whether its id repeats or is null; further columns are left out of the result; an empty table or
benchmark gives no hits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._io import as_long, binary_rows, bloom_bits, bloom_has, cell_values, filter_rows, free_names, materialize, text_chunks

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
ROW = "_decontaminate_row"
#: Fingerprints of the benchmark up to which a Bloom filter thins the documents' ones out where they lie.
BLOOM_KEYS = 1 << 25


class Fingerprints:
    """Winnowed fingerprints of the benchmark: sorted k-gram hashes with the place of each in the items' words."""

    def __init__(self, items: list[str | None], texts: list[str | None], window: int, k: int):
        self.window, self.k = window, k
        number: dict[str | None, int] = {}
        self.id = np.array([number.setdefault(x, len(number)) for x in items], np.int64)
        self.names = list(number)
        s = W.scan(pa.array([t or "" for t in texts], pa.large_string()), W.alnum_words())
        self.words, self.at = s.hash, s.at
        n = np.diff(s.at)
        self.item = np.repeat(np.arange(len(n)), n)
        long = np.repeat(n >= window, n)
        chosen, _, _ = W.winnow(W.ngram_hash(s.hash, k), W.valid(s.at, k) & long, s.at, window - k + 1)
        place = np.flatnonzero(chosen)
        gram = W.ngram_hash(s.hash, k)[place] if len(place) else np.zeros(0, np.uint64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.place = gram[order], place[order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in np.unique(n[(n > 0) & (n < window)]):
            own = np.flatnonzero(n == length)
            h = W.ngram_hash(s.hash, int(length))[s.at[:-1][own]]
            order = np.argsort(h, kind="stable")
            self.short[int(length)] = (h[order], own[order])

    def search(self, s: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hit words as flags, document and item id's number of each hit pair, without repeats)."""
        n, docs = len(s.hash), s.doc
        delta = np.zeros(n + 1, np.int64)
        who, what = [], []

        def take(start, end, item):
            np.add.at(delta, start, 1)
            np.add.at(delta, end, -1)
            who.append(docs[start])
            what.append(item)

        if len(self.gram) and n:
            gram = W.ngram_hash(s.hash, self.k)
            chosen, _, _ = W.winnow(gram, W.valid(s.at, self.k), s.at, self.window - self.k + 1)
            p = np.flatnonzero(chosen)
            p = p[np.isin(gram[p], self.gram)]
            lo, hi = np.searchsorted(self.gram, gram[p], "left"), np.searchsorted(self.gram, gram[p], "right")
            count = hi - lo
            mine = np.repeat(p, count)
            theirs = self.place[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
            left, right = self._extend(s, docs, mine, theirs)
            good = left + right + self.k >= self.window
            take((mine - left)[good], (mine + right + self.k)[good], self.item[theirs[good]])
        for length, (h, own) in self.short.items():
            gram = W.ngram_hash(s.hash, length)
            p = np.flatnonzero(np.isin(gram, h) & W.valid(s.at, length)) if n else np.zeros(0, np.int64)
            lo, hi = np.searchsorted(h, gram[p], "left"), np.searchsorted(h, gram[p], "right")
            count = hi - lo
            mine = np.repeat(p, count)
            take(mine, mine + length, own[np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))])
        found = np.concatenate(what) if what else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([np.concatenate(who or [np.zeros(0, np.int64)]), self.id[found]]), axis=1)
        return np.cumsum(delta[:-1]) > 0, pairs[0], pairs[1]

    def _extend(self, s, docs, mine, theirs):
        """How far equal words go on, to the left and right of equal k-grams; `window - k` words settle it."""
        reach = self.window - self.k
        left, right = np.zeros(len(mine), np.int64), np.zeros(len(mine), np.int64)
        for length, first, step in ((left, -1, -1), (right, self.k, 1)):
            live = np.ones(len(mine), bool)
            for j in range(reach):
                a, b = mine + first + step * j, theirs + first + step * j
                inside = live & (a >= s.at[docs[mine]]) & (a < s.at[docs[mine] + 1]) & (b >= self.at[self.item[theirs]]) & (b < self.at[self.item[theirs] + 1])
                live = inside.copy()
                live[inside] = s.hash[a[inside]] == self.words[b[inside]]
                length += live
        return left, right


def _report(s: W.Words, ids: pa.Array, hit, who, what, names) -> pa.RecordBatch:
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[s.at[1:]] - total[s.at[:-1]]
    lists: list[list[str | None]] = [[] for _ in range(len(ids))]
    for d, i in zip(who.tolist(), what.tolist()):
        lists[d].append(names[i])
    sha = [hashlib.sha256(",".join(sorted(n for n in x if n is not None)).encode()).hexdigest() for x in lists]
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(s.at)), pa.array(n_hit), pa.array([len(x) for x in lists], pa.int64()), pa.array(sha), pa.array(n_hit > 0)],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    )


def _small(benchmark: DataFrame, max_words: int) -> tuple[DataFrame, bool]:
    """(item_id as string, text of items with text; whether they have at most max_words words)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    # a word and its separator take two characters at least
    letters = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return items, int(letters) <= 2 * max_words


def _broadcast(items: DataFrame, window: int, k: int):
    rows = items.collect()
    return items.sparkSession.sparkContext.broadcast(Fingerprints([r[0] for r in rows], [r[1] for r in rows], window, k))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, max_broadcast_words: int = 10_000_000) -> DataFrame:
    """One row per document: how many of its words lie in windows of the benchmark, and in how many items."""
    items, small = _small(benchmark, max_broadcast_words)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not small:
        return _by_join(_keyed(text), items, window, k).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    known = _broadcast(items, window, k)

    def find(batches):
        f, table = known.value, W.alnum_words()
        for b in text_chunks(batches, "text"):
            s = W.scan(b.column(1), table)
            yield _report(s, b.column(0), *f.search(s), f.names)

    return text.mapInArrow(find, RESULT)


def _keyed(docs: DataFrame, name: str = ROW) -> DataFrame:
    """docs with a key of each row, written first so that the key survives retries."""
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "decontaminate-rows")


def _prints(s: W.Words, window: int, k: int, lengths: list[int] | None):
    """Lists of (kind, hash, place) of a text's fingerprints: kind 0 for winnowed k-grams, else a short item's length.

    lengths: of the short items to look for; None for the benchmark itself, whose short items have their own.
    """
    n = np.diff(s.at)
    every = np.zeros(len(s.hash), bool) if lengths is None else np.ones(len(s.hash), bool)
    if lengths is None:
        every[np.repeat(n >= window, n)] = True
    gram = W.ngram_hash(s.hash, k)
    place = np.flatnonzero(W.winnow(gram, W.valid(s.at, k) & every, s.at, window - k + 1)[0])
    yield 0, gram[place], place
    for length in np.unique(n[(n > 0) & (n < window)]).tolist() if lengths is None else lengths:
        place = s.at[:-1][n == length] if lengths is None else np.flatnonzero(W.valid(s.at, length))
        yield length, W.ngram_hash(s.hash, length)[place], place


def _around(s: W.Words, place: np.ndarray, k: int, reach: int) -> np.ndarray:
    """The words left of each k-gram, nearest first, and right of it; 0 beyond the text."""
    doc = s.doc[place]
    out = np.zeros((len(place), 2 * reach), np.uint64)
    for j in range(reach):
        for column, at in ((j, place - 1 - j), (reach + j, place + k + j)):
            own = (at >= s.at[doc]) & (at < s.at[doc + 1])
            out[own, column] = s.hash[at[own]]
    return out


def _by_join(docs: DataFrame, items: DataFrame, window: int, k: int) -> DataFrame:
    """RESULT and the key of each row of docs, by a join of fingerprints."""
    reach, table = window - k, W.alnum_words()

    def rows(batches, key, lengths, keep):
        for b in text_chunks(batches, "text"):
            s = W.scan(b.column(1), table)
            if not len(s.hash):
                continue
            for kind, gram, place in _prints(s, window, k, lengths):
                gram = W.mix(gram + np.uint64(kind))
                own = np.flatnonzero(bloom_has(keep.value, gram)) if keep else np.arange(len(gram))
                gram, place = gram[own], place[own]
                near = _around(s, place, k, reach) if kind == 0 else np.zeros((len(place), 0), np.uint64)
                doc = s.doc[place]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), kind, np.int32)), pa.array(as_long(gram)), b.column(0).take(pa.array(doc)), pa.array((place - s.at[doc]).astype(np.int32)), binary_rows(near.reshape(-1), np.arange(len(place) + 1) * near.shape[1])], ["kind", "gram", key, f"at_{key}", f"near_{key}"])

    columns = "kind int, gram long, {0} {1}, at_{0} int, near_{0} binary"
    theirs = materialize(items.select("item_id", "text").mapInArrow(lambda it: rows(it, "item", None, None), columns.format("item", "string")), "decontaminate-items")
    lengths = sorted(r[0] for r in theirs.where("kind > 0").select("kind").distinct().collect())
    keys = theirs.select("gram").distinct()
    n = keys.count()
    keep = docs.sparkSession.sparkContext.broadcast(bloom_bits(keys, "gram", max(20, (16 * n).bit_length()))) if n <= BLOOM_KEYS else None
    ours = docs.select(ROW, "text").mapInArrow(lambda it: rows(it, "doc", lengths, keep), columns.format("doc", "long"))

    def extend(batches):
        for b in batches:
            kind, at = b.column(0).to_numpy(), b.column(2).to_numpy().astype(np.int64)
            start, end = at.copy(), at + kind
            own = np.flatnonzero(kind == 0)
            mine, yours = (cell_values(b.column(i).take(pa.array(own)), np.uint64)[0].reshape(-1, 2 * reach) for i in (3, 5))
            same = (mine == yours) & (mine != 0)
            left, right = (np.minimum.accumulate(same[:, x : x + reach], axis=1).sum(axis=1) for x in (0, reach))
            start[own], end[own] = at[own] - left, at[own] + k + right
            good = np.ones(len(kind), bool)
            good[own] = left + right + k >= window
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(start), pa.array(end), b.column(4)], [ROW, "start", "end", "item"]).filter(pa.array(good))

    both = ours.join(theirs, ["kind", "gram"]).select("kind", "doc", "at_doc", "near_doc", "item", "near_item")
    hits = both.mapInArrow(extend, f"{ROW} long, start long, end long, item string").distinct()
    spans = hits.groupBy(ROW).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull().cast("int")).alias("nameless"))
    step = lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(acc["end"], x["start"]))).alias("n"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), step, lambda acc: acc["n"])
    spans = spans.select(ROW, n_hit.alias("n_hit"), (F.size("items") + F.col("nameless")).cast("long").alias("n_items"), F.array_join("items", ",").alias("names"))

    def count(batches):
        for b in text_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(W.scan(b.column(2), table, hashes=False).at))], [ROW, "doc_id", "n_words"])

    every = docs.select(ROW, "doc_id", "text").mapInArrow(count, f"{ROW} long, doc_id long, n_words long")
    zero = F.lit(0).cast("long")
    return every.join(spans, ROW, "left").select(ROW, "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.sha2(F.coalesce("names", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, max_broadcast_words: int = 10_000_000) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark."""
    items, small = _small(benchmark, max_broadcast_words)
    if not small:
        (own,) = free_names(docs, ROW)
        rows = _keyed(docs, own)
        gone = _by_join(rows.select(F.col(own).alias(ROW), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), items, window, k).where("contaminated").select(F.col(ROW).alias(own))
        return rows.join(gone.hint("shuffle_hash"), own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    known = _broadcast(items, window, k)

    def keep():
        table = W.alnum_words()

        def mask(texts):
            _, who, _ = known.value.search(W.scan(texts, table))
            return ~np.isin(np.arange(len(texts)), who)

        return mask

    return filter_rows(docs, keep)
