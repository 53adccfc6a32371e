"""Language-model scoring by a weighted backoff automaton.

Training counts words, word pairs and triples over all training documents. Probabilities are smoothed with the lower order
as a prior: p(w | h) = (c(h w) + K p(w | shorter h)) / (c(h) + K), down to the add-k words with one unknown word, so what a
state's arcs and its failure arc give sums to 1. A context that was seen is a state; n-grams that were seen are its arcs with
their whole probability; its failure arc has the weight K / (c(h) + K) and leads to the shorter context. A text is scored in
one traversal from left to right, which carries the state: per token an arc of the state, or failure arcs to one that has it.

The weights K of the lower order come from the training documents alone, by leaving each token out: of the tokens, a share comes
once only in its context and would be new to the model without it, and K is chosen such that the contexts, each less that
token, leave just that share of their probability to the lower order. It is worked out from how often counts occur.

All n-grams of the training documents are in the model, whatever their counts. Texts are packed into chunks of about
`CHUNK_WORDS` tokens; a chunk asks once for each of its distinct n-grams and tells how often it trains them. Parts, by hash of
the n-gram, sum the counts exactly and answer each chunk, which builds the automaton of just the arcs that its texts can
walk. A part gets at most one row of an n-gram from a chunk, so frequent n-grams need no care; memory depends on the sizes
of chunks and parts alone, nothing is broadcast, and counts do not depend on the partitioning. N-grams are named by 56 bits
of a hash. The rows that chunks and parts exchange are as many as both numbers' product; where these would be more than
`MOST_CELLS`, n-grams are counted and joined back singly, in proportion to the input, with the same counts.

Null text is empty: its only token is the end. Repeated rows are trained on and scored each, rows without an id too (the fold
expression says whether they train); extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._io import cell_values, lean, materialize, text_chunks

BEGIN, END = np.uint64(0x7B1E2C4D5A697887), np.uint64(0x3C6EF372FE94F82B)
ADD = 0.1
#: Steps of counts in a histogram: eight for each doubling.
BINS = 512
CHUNK_WORDS = 750_000
#: N-grams per part of the exchange of counts.
PART_GRAMS = 2_000_000
#: Cells of chunks and parts up to which n-grams are exchanged in packs.
MOST_CELLS = 200_000_000
RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return W.mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _bin(counts: np.ndarray) -> np.ndarray:
    return np.minimum((8 * np.log2(counts)).astype(np.int64), BINS - 1)


def _bin_values() -> np.ndarray:
    """A count for each bin: the mean of those that fall into it, or its middle where they are many."""
    c = np.arange(1, 1 << 16)
    n = np.bincount(_bin(c), minlength=BINS)
    return np.where(n > 0, np.bincount(_bin(c), c, BINS) / np.maximum(n, 1), 2 ** ((np.arange(BINS) + 0.5) / 8))


def histogram(counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many n-grams of each order (0, 1, 2) have a count of each bin; bin 0 has those that come once."""
    seen = counts > 0
    return np.bincount(order[seen] * BINS + _bin(counts[seen]), minlength=3 * BINS).reshape(3, BINS)


def priors(hist: np.ndarray) -> tuple[float, float]:
    """The weights of the lower order for pairs and triples, from the histogram of all training counts."""
    value = _bin_values()

    def solved(contexts: np.ndarray, singles: int) -> float:
        lo, hi = np.log(1e-3), np.log(1e6)
        for _ in range(60):
            k = np.exp((lo + hi) / 2)
            left = (contexts * value * k / (value - 1 + k)).sum()
            lo, hi = ((lo + hi) / 2, hi) if left < singles else (lo, (lo + hi) / 2)
        return float(np.exp((lo + hi) / 2))

    return solved(hist[0], hist[1][0]), solved(hist[1], hist[2][0])


class Grams:
    """The distinct n-grams of a chunk, ordered by hash; which of them ends at each token; what they go back to."""

    def __init__(self, tokens: np.ndarray, bounds: np.ndarray, trained: np.ndarray):
        """tokens: of all texts, each with its end; trained: which tokens are of training texts."""
        self.tokens, self.bounds = tokens, bounds
        n = len(tokens)
        head = np.zeros(n, bool)
        head[bounds[:-1]] = True
        before = np.where(head, BEGIN, np.roll(tokens, 1))
        two = _pair(before, tokens)
        deep = np.flatnonzero(~head)
        key = np.concatenate([_pair(np.full(n, END), tokens), two, _pair(two[deep - 1], tokens[deep])])
        key >>= np.uint64(8)
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.key = key[new]
        name = np.empty(len(key), np.int32)
        name[order] = np.cumsum(new, dtype=np.int32) - 1
        del key, order, new
        size = len(self.key)
        self.trained = sum(np.bincount(x, minlength=size) for x in (name[:n][trained], name[n : 2 * n][trained], name[2 * n :][trained[deep]]))
        #: per order the n-gram that ends at each token; -1 for the triple at a text's first token
        self.at = np.full((3, n), -1, np.int32)
        self.at[0], self.at[1], self.at[2, deep] = name[:n], name[n : 2 * n], name[2 * n :]
        self.order = np.zeros(size, np.int8)
        self.lower, self.context = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        one, two, three = self.at
        self.order[two], self.order[three[deep]] = 1, 2
        self.lower[two], self.lower[three[deep]] = one, two[deep]
        # a text's first token follows BEGIN, which is there as often as the end
        end = one[bounds[-1] - 1] if n else -1
        self.context[two], self.context[three[deep]] = np.where(head, end, np.roll(one, 1)), two[deep - 1]

    def part(self, parts: int) -> np.ndarray:
        return ((self.key >> np.uint64(24)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Automaton:
    """States are n-grams by their number in Grams, then ROOT and BEGIN; arcs are n-grams too."""

    def __init__(self, grams: Grams, count: np.ndarray, total: int, distinct: int, prior: tuple[float, float]):
        """count: of each of the n-grams in all training texts; total and distinct: of training tokens; prior: as by priors()."""
        g, n = grams, len(grams.key)
        self.grams, self.count, self.root, self.begin = g, np.append(count, 0), n, n + 1
        self.denominator = total + ADD * (distinct + 1)
        p = (count + ADD) / self.denominator
        for order, k in enumerate(prior, 1):
            own = np.flatnonzero(g.order == order)
            p[own] = (count[own] + k * p[g.lower[own]]) / (count[g.context[own]] + k)
        self.weight = np.log10(p)
        known = count > 0
        itself = np.where(known, np.arange(n), n)
        #: the state after an arc, each state's failure arc, and its order (of the arcs that leave it)
        self.next = np.where(g.order == 2, g.lower, itself)
        self.fail = np.concatenate([np.where(g.order == 1, itself[g.lower] if n else itself, n), [n, n]])
        k = np.where(g.order == 1, prior[1], prior[0])
        end = count[g.at[0, -1]] if n else 0
        self.fail_weight = np.concatenate([np.log10(k / (count + k)), [0.0, np.log10(prior[0] / (end + prior[0]))]])
        self.depth = np.concatenate([g.order + 1, [0, 1]]).astype(np.int64)

    @cached_property
    def base(self) -> np.ndarray:
        """log10 probability of each token by the add-k words alone."""
        return np.log10((self.count[self.grams.at[0]] + ADD) / self.denominator)

    def score(self) -> np.ndarray:
        """log10 probability of each text: all texts are traversed at once, token by token, each with its own state."""
        bounds, at = self.grams.bounds, self.grams.at
        lens = np.diff(bounds)
        order = np.argsort(-lens, kind="stable")
        start, lens = bounds[:-1][order], lens[order]
        state, sums = np.full(len(order), self.begin), np.zeros(len(order))
        going = np.searchsorted(-lens, -np.arange(lens[0] if len(lens) else 0), "left")
        for t, k in enumerate(going.tolist()):
            here, now = start[:k] + t, state[:k]
            arc = at[self.depth[now], here]
            fails = np.flatnonzero((self.count[arc] == 0) & (now != self.root))
            while len(fails):
                sums[fails] += self.fail_weight[now[fails]]
                now[fails] = self.fail[now[fails]]
                arc[fails] = at[self.depth[now[fails]], here[fails]]
                fails = fails[(self.count[arc[fails]] == 0) & (now[fails] != self.root)]
            sums[:k] += self.weight[arc]
            state[:k] = self.next[arc]
        out = np.empty(len(order))
        out[order] = sums
        return out


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, held_out, text) packed: one row per chunk of whole texts."""
    table = W.space_words(True)

    def chunk(held):
        tokens, lens = (np.concatenate([h[i] for h in held]) for i in (2, 3))
        words, local, often = np.unique(tokens, return_inverse=True, return_counts=True)
        # numbers by frequency, high bytes apart, are the more compressible
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        words, planes = words[order], np.ascontiguousarray(rank[local].view(np.uint8).reshape(-1, 4).T)
        cell = lambda a: pa.array([np.ascontiguousarray(a).tobytes()], pa.binary())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(lens)], pa.int32()), pa.concat_arrays([h[i] for h in held])) for i in (0, 1)]
        packed = pa.array([pa.compress(planes.tobytes(), codec="zstd", asbytes=True)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([len(tokens)]), *lists, cell(lens.astype(np.int64)), cell(words), packed], ["n", "ids", "held", "lens", "words", "tokens"])

    def pack(batches):
        held, n = [], 0
        for b in text_chunks(batches, "text"):
            s = W.scan(b.column(2), table)
            held.append((b.column(0), b.column(1), np.insert(s.hash, s.at[1:], END), np.diff(s.at) + 1))
            n += len(held[-1][2])
            if n >= size:
                yield chunk(held)
                held, n = [], 0
        if held:
            yield chunk(held)

    made = rows.mapInArrow(pack, "n long, ids array<long>, held array<boolean>, lens binary, words binary, tokens binary")
    return materialize(made.withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks")


def _grams(row: dict) -> Grams:
    planes = np.frombuffer(pa.decompress(row["tokens"], decompressed_size=4 * row["n"], codec="zstd", asbytes=True), np.uint8)
    local = np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view(np.uint32)
    lens = np.frombuffer(row["lens"], np.int64)
    trained = np.repeat(np.array([h is False for h in row["held"]], bool), lens)
    return Grams(np.frombuffer(row["words"], np.uint64)[local], np.concatenate([[0], np.cumsum(lens)]), trained)


def _squeezed(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as compressed bytes, 255 standing for the next one of the large counts."""
    return pa.compress(np.minimum(counts, 255).astype(np.uint8).tobytes(), codec="zstd", asbytes=True), counts[counts >= 255].astype(np.int64).tobytes()


def _counts(n: int, small: bytes, large: bytes) -> np.ndarray:
    """Reverse of _squeezed, of n counts."""
    out = np.frombuffer(pa.decompress(small, decompressed_size=n, codec="zstd", asbytes=True), np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, np.int64)
    return out


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys: the first one, and then the differences in as few bytes as the largest of them takes."""
    step = np.diff(keys)
    width = max(1, -(-int(step.max(initial=0)).bit_length() // 8))
    return keys[:1].tobytes() + step.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _keys(n: int, steps: bytes) -> np.ndarray:
    """Reverse of _steps, of n keys."""
    out = np.zeros((n, 8), np.uint8)
    out[0] = np.frombuffer(steps, np.uint8, 8)
    if n > 1:
        out[1:, : (len(steps) - 8) // (n - 1)] = np.frombuffer(steps, np.uint8, offset=8).reshape(n - 1, -1)
    return np.cumsum(out.reshape(-1).view(np.uint64), dtype=np.uint64)


ASK = "part long, chunk long, n long, keys binary, words binary, pairs binary, small binary, large binary"
ANSWER = "part long, chunk long, n long, small binary, large binary, hist binary"
_ASK, _ANSWER = ([f.split()[0] for f in x.split(", ")] for x in (ASK, ANSWER))


def _exchange(chunks: DataFrame, parts: int) -> DataFrame:
    """Per chunk and part, in the order of the chunk's n-grams: their counts in all training texts; and per part (without a
    chunk) the histogram of its counts."""

    def ask(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                g = _grams(row)
                part, word, pair = g.part(parts), g.order == 0, g.order == 1
                edge = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part)).tolist()
                cells = [(_steps(g.key[a:z]), np.packbits(word[a:z]).tobytes(), np.packbits(pair[a:z]).tobytes(), *_squeezed(g.trained[a:z])) for a, z in zip(edge[:-1], edge[1:])]
                part = part[edge[:-1]]
                del g
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), row["chunk"])), pa.array(np.diff(edge)), *[pa.array(c, pa.binary()) for c in zip(*cells)]], _ASK)

    def answer(table):
        rows = table.to_pylist()
        key = np.concatenate([_keys(r["n"], r["keys"]) for r in rows])
        count = np.concatenate([_counts(r["n"], r["small"], r["large"]) for r in rows])
        bits = lambda c: np.concatenate([np.unpackbits(np.frombuffer(r[c], np.uint8))[: r["n"]] for r in rows]).astype(np.int64)
        kind = 2 - 2 * bits("words") - bits("pairs")
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = np.diff(key[order]) != 0
        first = np.flatnonzero(new)
        sums = np.add.reduceat(count[order], first)
        count[order] = sums[np.cumsum(new) - 1]
        edge = np.cumsum([0, *[r["n"] for r in rows]]).tolist()
        cells = [_squeezed(count[a:z]) for a, z in zip(edge[:-1], edge[1:])]
        part = rows[0]["part"]
        hist = histogram(sums, kind[order[first]])
        out = [(part, r["chunk"], r["n"], *c, None) for r, c in zip(rows, cells)] + [(part, None, 0, b"", b"", hist.astype("<i8").tobytes())]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=_ANSWER)

    asked = chunks.select("chunk", "n", "held", "lens", "words", "tokens").mapInArrow(ask, ASK)
    return materialize(asked.groupBy("part").applyInArrow(lambda t: lean(answer, t), ANSWER), "lm-answers")


def _singly(chunks: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(chunk, key, count) of each chunk's n-grams, and the histogram of all counts: the exchange by rows. Counts are combined
    before they are shuffled, and the join back may split an n-gram that very many chunks hold."""

    def ask(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                g = _grams(row)
                yield pa.RecordBatch.from_arrays([pa.array(g.key.view(np.int64)), pa.array(np.full(len(g.key), row["chunk"])), pa.array(g.order.astype(np.int32)), pa.array(g.trained.astype(np.int64))], ["key", "chunk", "order", "n"])

    asked = materialize(chunks.select("chunk", "n", "held", "lens", "words", "tokens").mapInArrow(ask, "key long, chunk long, order int, n long"), "lm-grams")
    counts = materialize(asked.groupBy("key").agg(F.sum("n").alias("count"), F.max("order").alias("order")), "lm-counts")

    def bins(batches):
        for b in batches:
            h = histogram(b.column(0).to_numpy(), b.column(1).to_numpy()).ravel()
            at = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(h[at])], ["i", "n"])

    hist = np.zeros(3 * BINS, np.int64)
    for i, n in counts.select("count", "order").mapInArrow(bins, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        hist[i] = n
    return asked.select("chunk", "key").join(counts.select("key", "count"), "key"), hist.reshape(3, BINS)


def _histogram(answers: DataFrame) -> np.ndarray:
    """The parts' histograms, added up: a fixed number of sums, whatever the number of parts."""

    def add(batches):
        total = np.zeros(3 * BINS, np.int64)
        for b in batches:
            total += sum((np.frombuffer(h, "<i8") for h in b.column(0).to_pylist()), np.zeros(3 * BINS, np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "n"])

    out = np.zeros(3 * BINS, np.int64)
    for i, n in answers.where("chunk is null").select("hist").mapInArrow(add, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        out[i] = n
    return out.reshape(3, BINS)


def score(docs: DataFrame, held_out, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """All documents scored by the model of those that are not held out (a boolean column expression)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    chunks = _chunks(rows, chunk_words)
    tokens = chunks.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-2 * tokens // PART_GRAMS))
    packs = parts * chunks.count() <= MOST_CELLS
    if packs:
        answers = _exchange(chunks, parts)
        hist = _histogram(answers)
        asked = answers.where("chunk is not null").select("chunk", "part", "n", "small", "large")
    else:
        asked, hist = _singly(chunks)
    distinct, prior = int(hist[0].sum()), priors(hist)
    total = int(_trained(chunks).agg(F.sum("trained")).first()[0] or 0)

    def walk(chunk, replies):
        row = chunk.to_pylist()[0]
        g = _grams(row)
        if packs:
            count = np.concatenate([_counts(r["n"], r["small"], r["large"]) for r in replies.sort_by("part").to_pylist()])
        else:  # keys have 56 bits, so their order as numbers with a sign is the same
            count = replies.sort_by("key").column("count").to_numpy()
        model = Automaton(g, count, total, distinct, prior)
        cut = g.bounds[:-1]
        known = (model.count[g.at[0]] > 0).astype(np.int64)
        sums = [np.diff(g.bounds), np.add.reduceat(known, cut), np.full(len(cut), total), np.add.reduceat(model.base, cut), model.score()]
        return pa.Table.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), *[pa.array(x) for x in sums]], names=RESULT)

    packed = chunks.select("chunk", "n", "ids", "held", "lens", "words", "tokens")
    return packed.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(lambda a, b: lean(walk, a, b), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _trained(chunks: DataFrame) -> DataFrame:
    """Per chunk its tokens of training texts."""

    def tokens(batches):
        for b in batches:
            lens, bounds = cell_values(b.column(1), np.int64)
            held = pc.fill_null(b.column(0).flatten(), True).to_numpy(zero_copy_only=False)
            done = np.concatenate([[0], np.cumsum(np.where(held, 0, lens))])
            yield pa.RecordBatch.from_arrays([pa.array(done[bounds[1:]] - done[bounds[:-1]])], ["trained"])

    return chunks.select("held", "lens").mapInArrow(tokens, "trained long")
