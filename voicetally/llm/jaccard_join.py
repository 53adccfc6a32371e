"""N-gram Jaccard join, exact, by prefix trees over globally ordered shingle sets.

A document's set is its distinct `n`-word shingles (64-bit hashes); with fewer words, the whole sequence as one. All items
are counted over all sets, and every set is put in one global order, rarest items first. Items that stand in one set only
can be in no overlap, so they count in a set's size but are not stored.

Sets that can link share an item among their rarest (their prefixes). Items lead to groups: a group is named by the least set
of an item, and items of the same least set make one group. A group's sets are stored in a prefix tree, and each of them is
searched for in it: the traversal shares partial overlaps along common beginnings, and cuts a subtree when the sizes and
the items that may still follow cannot reach the overlap needed, or when all that lies below is linked with the query
already. A group of any size is dealt out in blocks of bounded size, each with the group's least set; blocks that stay apart
then meet two by two. Only links that join two parts are returned, so there are fewer links than sets, and no pair list.

Documents without words or text have empty sets and link with nothing. Equal sets (copies) are one node, named by a 64-bit
digest, and are never expanded into pairs. Rows may repeat ids or have none; other columns are not read; an empty table gives
an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._io import as_long, binary_rows, cell_values, drop_keys, lean, materialize, runs_to_index, shuffle_parts, text_chunks
from .components import components

#: Items in one part of the exchange that counts them; sets and items in one block of a group.
PART_ITEMS, BLOCK_SETS, BLOCK_ITEMS = 2_000_000, 1024, 4_000_000
#: Kinds of rows in the exchange: a chunk's documents; its items held once in it; held by several of its sets; answers.
DOCS, ITEMS, SEVERAL, SHARED = range(4)
EXCHANGE = "part long, chunk long, kind int, a binary, b binary, c binary, d binary"
ANSWER = "chunk long, kind int, a binary, b binary, c binary, d binary"
LOW = np.uint64((1 << 40) - 1)
ITEM = np.uint64((1 << 56) - 1)


def overlap_needed(a, b, num: int, den: int):
    """Least overlap at which Jaccard similarity of sets of a and b items reaches num/den."""
    return -(-num * (a + b) // (num + den))


def chunk_sets(texts: pa.Array, n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles of all texts, each text's sorted and distinct; bounds)."""
    s = W.scan(texts, table)
    gram = W.ngram_hash(s.hash, n) if len(s.hash) else s.hash
    rows, at = [], s.at.tolist()
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo >= n:
            rows.append(np.unique(gram[lo : hi - n + 1]))
        elif hi > lo:
            rows.append(W.ngram_hash(s.hash[lo:hi], hi - lo)[:1])
        else:
            rows.append(gram[:0])
    return (np.concatenate(rows) if rows else gram), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def digests(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        scaled = flat * (runs_to_index(np.zeros_like(n), n).astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
        out[full] = W.mix(np.add.reduceat(scaled, bounds[:-1][full]) ^ n[full].astype(np.uint64))
    return out


def _changes(a: np.ndarray) -> np.ndarray:
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    return new


def _row(chunk: int, kind: int, *cells: np.ndarray, part: int | None = None) -> list[pa.Array]:
    head = [] if part is None else [pa.array([part], pa.int64())]
    cells = [*cells, *[np.zeros(0, np.uint8)] * (4 - len(cells))]
    return [*head, pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), *[pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cells]]


_EXCHANGE = [f.split()[0] for f in EXCHANGE.split(", ")]
_ANSWER = _EXCHANGE[1:]


def _ask(batches, n: int, parts: int):
    """Per chunk of texts: its documents, and its distinct sets' items, dealt to parts by hash. An item that several of the
    chunk's sets hold is sent once with their number, so an item of a third of all documents stays small."""
    table, task = W.space_words(True), TaskContext.get().partitionId()
    for i, b in enumerate(text_chunks(batches, "text")):
        chunk = task << 32 | i
        flat, bounds = chunk_sets(b.column(1), n, table)
        node, size = digests(flat, bounds), np.diff(bounds)
        ids = b.column(0)
        own = np.concatenate([ids.fill_null(0).to_numpy(), b.column(2).to_numpy()])
        yield pa.RecordBatch.from_arrays(_row(chunk, DOCS, own, pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.uint8), node, size.astype(np.uint32), part=chunk % parts), _EXCHANGE)
        own = np.unique(node, return_index=True)[1]
        own = np.sort(own[size[own] > 0])
        item = flat[runs_to_index(bounds[:-1][own], size[own])]
        doc = np.repeat(own, size[own])
        if not len(item):
            continue
        order = np.argsort(item, kind="stable")
        item, doc = item[order], doc[order]
        first = np.flatnonzero(_changes(item))
        held = np.diff(np.append(first, len(item)))
        part = ((item[first] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        edge = np.append(np.flatnonzero(_changes(part)), len(part))
        rows = []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
            at, w = first[lo:hi], held[lo:hi]
            one, many = at[w == 1], at[w > 1]
            one = one[np.argsort(doc[one], kind="stable")]
            step = np.diff(doc[one], prepend=0)
            low = (item[one] & LOW).view(np.uint8).reshape(-1, 8)[:, :5]
            rows.append(_row(chunk, ITEMS, low, step.astype(np.uint8 if step.max(initial=0) < 256 else np.uint16), item[many] & LOW, np.minimum(w[w > 1], 255).astype(np.uint8), part=int(part[lo])))
        several = held > 1
        if several.any():
            name = (part[several].astype(np.uint64) & np.uint64(0xFFFF)) << np.uint64(40) | (item[first[several]] & LOW)
            holders = doc[runs_to_index(first[several], held[several])]
            rows.append(_row(chunk, SEVERAL, name, holders.astype(np.uint16), held[several].astype(np.uint32), part=chunk % parts))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*rows)], _EXCHANGE)


def frequency_class(count: np.ndarray) -> np.ndarray:
    """0 to 255, not falling as the count grows: the count itself up to 127, then its logarithm."""
    return np.where(count < 128, count, np.minimum(255, 128 + 4 * (np.log2(np.maximum(count, 128)) - 7))).astype(np.uint64)


def _count(table: pa.Table) -> pa.Table:
    """One part of the exchange: each chunk learns its items that other sets hold too, as keys in the global order."""
    table = table.combine_chunks()
    kind = table.column("kind").to_numpy()
    passed = table.filter(pa.array(kind != ITEMS)).select(_ANSWER)
    asked = table.filter(pa.array(kind == ITEMS)).to_pylist()
    if not asked:
        return passed
    low, doc, weight, lens = [], [], [], []
    for r in asked:
        own = np.frombuffer(r["a"], np.uint8).reshape(-1, 5)
        wide = np.zeros((len(own), 8), np.uint8)
        wide[:, :5] = own
        many = np.frombuffer(r["c"], np.uint64)
        step = np.frombuffer(r["b"], np.uint8 if len(r["b"]) == len(own) else np.uint16)
        low += [wide.reshape(-1).view(np.uint64), many]
        doc += [np.cumsum(step, dtype=np.int64), np.full(len(many), 0xFFFF)]
        weight += [np.ones(len(own), np.int64), np.frombuffer(r["d"], np.uint8).astype(np.int64)]
        lens.append(len(own) + len(many))
    low, doc, weight = np.concatenate(low), np.concatenate(doc), np.concatenate(weight)
    order = np.argsort(low)
    new = _changes(low[order])
    count = np.add.reduceat(weight[order], np.flatnonzero(new))
    of = np.empty(len(low), np.int64)
    of[order] = count[np.cumsum(new) - 1]
    key = frequency_class(of) << np.uint64(56) | np.uint64((asked[0]["part"] & 0xFFFF) << 40) | low
    rows, at = [], 0
    for r, n in zip(asked, lens):
        own = at + np.flatnonzero(of[at : at + n] > 1)
        at += n
        if len(own):
            rows.append(_row(r["chunk"], SHARED, key[own], doc[own].astype(np.uint16)))
    if not rows:
        return passed
    return pa.concat_tables([passed, pa.Table.from_arrays([pa.concat_arrays(c) for c in zip(*rows)], schema=passed.schema)])


def _assemble(table: pa.Table, num: int, den: int) -> pa.Table:
    """One chunk's sets that may link: node, size, how many of the stored items are in the prefix, stored items in order."""
    rows = table.to_pylist()
    docs = next(r for r in rows if r["kind"] == DOCS)
    node, size = np.frombuffer(docs["c"], np.uint64), np.frombuffer(docs["d"], np.uint32).astype(np.int64)
    shared = [r for r in rows if r["kind"] == SHARED]
    key = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in shared] or [np.zeros(0, np.uint64)])
    doc = np.concatenate([np.frombuffer(r["b"], np.uint16) for r in shared] or [np.zeros(0, np.uint16)]).astype(np.int64)
    for r in rows:
        if r["kind"] == SEVERAL:
            held = np.frombuffer(r["c"], np.uint32)
            many = np.sort(key[doc == 0xFFFF] & ITEM), key[doc == 0xFFFF][np.argsort(key[doc == 0xFFFF] & ITEM)]
            full = many[1][np.searchsorted(many[0], np.frombuffer(r["a"], np.uint64))]
            one = doc != 0xFFFF
            key, doc = np.concatenate([key[one], np.repeat(full, held)]), np.concatenate([doc[one], np.frombuffer(r["b"], np.uint16)])
    order = np.lexsort((key, doc))
    key, stored = key[order], np.bincount(doc, minlength=len(node))
    # rare items come first: the prefix's other items are those held by this set alone
    head = size + (-num * size // den) + 1 - (size - stored)
    own = np.flatnonzero((head > 0) & (stored > 0))
    begin = np.cumsum(stored) - stored
    items = binary_rows(key[runs_to_index(begin[own], stored[own])], np.concatenate([[0], np.cumsum(stored[own])]))
    return pa.Table.from_arrays([pa.array(as_long(node[own])), pa.array(size[own]), pa.array(head[own]), pa.array(stored[own]), items], names=["node", "size", "head", "stored", "items"])


class _Edge:
    """A run of items on the way down, what follows, and the sets that end here."""

    __slots__ = ("run", "kids", "ends", "least", "most", "one")

    def __init__(self, run, kids, ends, least, most):
        self.run, self.kids, self.ends, self.least, self.most, self.one = run, kids, ends, least, most, -1


class Trie:
    """A prefix tree over ordered sets, with the parts that links have joined so far."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.root = _Edge(np.zeros(0, np.uint64), {}, [], 1 << 62, 0)
        self.items: list[np.ndarray] = []
        self.size: list[int] = []
        self.head: list[int] = []
        self.parts = 0

    def find(self, x: int) -> int:
        head = self.head
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.head[max(x, y)] = min(x, y)
        self.parts -= x != y
        return x != y

    def note(self, items: np.ndarray, size: int) -> int:
        """A set that searches and is joined, but is not stored in the tree."""
        self.items.append(items)
        self.size.append(size)
        self.head.append(len(self.head))
        self.parts += 1
        return len(self.head) - 1

    def add(self, items: np.ndarray, size: int) -> int:
        """Store a set: its items that other sets hold too, in order, and its whole size."""
        name, edge, at, n = self.note(items, size), self.root, 0, len(items)
        while True:
            edge.least, edge.most = min(edge.least, size), max(edge.most, n)
            if at == n:
                edge.ends.append(name)
                return name
            below = edge.kids.get(int(items[at]))
            if below is None:
                edge.kids[int(items[at])] = _Edge(items[at:], {}, [name], size, n)
                return name
            run = below.run
            m = min(len(run), n - at)
            differ = np.flatnonzero(run[:m] != items[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(run):
                lower = _Edge(run[same:], below.kids, below.ends, below.least, below.most)
                below.run, below.kids, below.ends = run[:same], {int(run[same]): lower}, []
            edge, at = below, at + same

    def search(self, name: int) -> list[int]:
        """Stored sets that link with set `name` and are in another part; the parts become one."""
        q, size, num, den = self.items[name], self.size[name], self.num, self.den
        nq, found, mine = len(q), [], self.find(name)
        stack = [(self.root, 0, 0, 0)]
        while stack:
            edge, depth, have, past = stack.pop()
            if edge.one >= 0 and self.find(edge.one) == mine:
                continue
            # the least overlap that a set below needs, against the most that one can still reach
            need = overlap_needed(edge.least, size, num, den)
            if have + min(edge.most - depth, nq - past) < need:
                continue
            run = edge.run
            if len(run):
                at = np.searchsorted(q[past:], run)
                have += int((q[np.minimum(past + at, nq - 1)] == run).sum())
                past += int(np.searchsorted(q[past:], run[-1], "right"))
                depth += len(run)
                if have + min(edge.most - depth, nq - past) < need:
                    continue
            for x in edge.ends:
                if have >= overlap_needed(self.size[x], size, num, den) and self.join(name, x):
                    found.append(x)
                    mine = self.find(name)
            stack += [(e, depth, have, past) for e in edge.kids.values()]
        return found

    def mark(self) -> None:
        """Note at every edge whether all sets below are of one part."""
        order, i = [self.root], 0
        while i < len(order):
            order += order[i].kids.values()
            i += 1
        for edge in reversed(order):
            heads = {self.find(x) for x in edge.ends} | {self.find(e.one) if e.one >= 0 else -1 for e in edge.kids.values()}
            edge.one = heads.pop() if len(heads) == 1 else -1

    def links(self, names) -> list[tuple[int, int]]:
        """Search for all names in turn, until all is one part."""
        out, fresh = [], 0
        for name in names:
            if self.parts == 1:
                break
            found = self.search(name)
            out += [(name, x) for x in found]
            fresh += len(found)
            if fresh >= max(8, self.parts // 2):
                self.mark()
                fresh = 0
        return out


def _groups(batches, keys: int):
    """Lists of rows (columns after the first `keys`) of equal keys, from sorted batches; a group ends with its keys."""
    now, held = None, []
    for b in batches:
        for r in zip(*[c.to_pylist() for c in b.columns]):
            if r[:keys] != now:
                if held:
                    yield held
                now, held = r[:keys], []
            held.append(r[keys:])
    if held:
        yield held


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _walk(batches, num: int, den: int):
    """Links of each block of rows (group, block, node, size, items), whose sets go into one tree."""
    found: list[tuple[int, int]] = []
    for rows in _groups(batches, 2):
        tree = Trie(num, den)
        for _, size, items in rows:
            tree.add(np.frombuffer(items, np.uint64), size)
        found += [(rows[a][0], rows[b][0]) for a, b in tree.links(range(len(rows)))]
        if len(found) > 10_000:
            yield _pairs(found)
            found = []
    yield _pairs(found)


def _meet(batches, num: int, den: int):
    """Links between two blocks of a group, of rows (group, i, j, role, node, size, items, part): sets of role 0 are stored in a
    tree, those of role 1 are searched for; sets of one part are joined from the start."""
    found: list[tuple[int, int]] = []
    for rows in _groups(batches, 3):
        tree, heads = Trie(num, den), {}
        for role, _, size, items, part in rows:
            name = (tree.note if role else tree.add)(np.frombuffer(items, np.uint64), size)
            tree.join(name, heads.setdefault(part, name))
        tree.mark()
        found += [(rows[a][1], rows[b][1]) for a, b in tree.links([i for i, r in enumerate(rows) if r[0]])]
        if len(found) > 10_000:
            yield _pairs(found)
            found = []
    yield _pairs(found)


def _documents(batches):
    for b in batches:
        own, bounds = cell_values(b.column(0), np.int64)
        ids, rows = (np.concatenate([own[lo:hi].reshape(2, -1)[k] for lo, hi in zip(bounds[:-1], bounds[1:])]) for k in (0, 1))
        nodes, sizes = (cell_values(b.column(i), t)[0] for i, t in ((2, np.int64), (3, np.uint32)))
        null = cell_values(b.column(1), np.uint8)[0].astype(bool)
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(rows), pa.array(sizes.astype(np.int64)), pa.array(nodes)], ["doc_id", "row", "n_shingles", "node"])


def _heads(batches):
    for b in batches:
        flat, bounds = cell_values(b.column(3), np.int64)
        head = b.column(2).to_numpy()
        row = np.repeat(np.arange(b.num_rows), head)
        yield pa.RecordBatch.from_arrays([pa.array(flat[runs_to_index(bounds[:-1], head)]), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], ["item", "node", "size"])


def row_key():
    """Equal for rows of equal id and text only, and never null."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row")


def set_links(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, row, n_shingles, node; links between nodes: a, b, fewer than nodes, whose components are the classes)."""
    spark = docs.sparkSession
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key())
    letters = text.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-int(letters) // (6 * PART_ITEMS)))
    asked = text.mapInArrow(lambda it: _ask(it, n, parts), EXCHANGE)
    answers = materialize(asked.groupBy("part").applyInArrow(lambda t: lean(_count, t), ANSWER), "join-answers")
    documents = answers.where(f"kind = {DOCS}").select("a", "b", "c", "d").mapInArrow(_documents, "doc_id long, row long, n_shingles long, node long")
    sets = answers.groupBy("chunk").applyInArrow(lambda t: lean(_assemble, t, num, den), "node long, size long, head long, stored long, items binary")
    # chunks may each have sent a copy
    sets = materialize(sets.dropDuplicates(["node"]), "join-sets")

    heads = sets.select("node", "size", "head", "items").mapInArrow(_heads, "item long, node long, size long")
    least = heads.groupBy("item").agg(F.min(F.struct("size", "node")).alias("least"), F.count("*").alias("c")).where("c > 1").select("item", F.col("least.node").alias("group"))
    members = materialize(heads.join(least, "item").select("group", "node").distinct().join(sets.select("node", "stored"), "node"), "join-members")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("stored") / BLOCK_ITEMS)).cast("int")
    dealt = members.join(members.groupBy("group").agg(blocks.alias("blocks")), "group")
    block = F.when(F.col("group") == F.col("node"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), "blocks").cast("int")))
    dealt = materialize(dealt.select("group", "node", "blocks", F.explode(block).alias("block")), "join-blocks")
    parts = shuffle_parts(spark)
    contents = dealt.join(sets.select("node", "size", "items"), "node").select("group", "block", "node", "size", "items")
    contents = contents.repartition(parts, "group", "block").sortWithinPartitions("group", "block", "size", "node")
    links = materialize(contents.mapInArrow(lambda it: _walk(it, num, den), "a long, b long"), "join-links")

    large = dealt.where("blocks > 1")
    if large.isEmpty():
        return documents, links
    # what stays apart in a group of several blocks: the sets outside its largest part meet all others, block by block
    label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    large = large.select("group", "node").distinct().join(label, "node", "left").withColumn("part", F.coalesce("component", "node"))
    sums = large.groupBy("group", "part").agg(F.count("*").alias("c")).groupBy("group").agg(F.max(F.struct("c", "part")).alias("top"), F.sum("c").alias("all"))
    apart = sums.where("top.c < all").select("group", F.col("top.part").alias("major"))
    apart = large.join(apart, "group").join(sets.select("node", "size", "stored", "items"), "node")
    minor = F.col("part") != F.col("major")
    per = apart.groupBy("group").agg(F.ceil(F.greatest(F.count(F.when(minor, 1)) / BLOCK_SETS, F.sum(F.when(minor, F.col("stored"))) / BLOCK_ITEMS)).cast("int").alias("stores"), blocks.alias("queries"))
    apart = apart.join(per, "group")
    own = F.xxhash64("node")
    store = apart.where(minor).select("group", F.pmod(own, "stores").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("queries") - 1)).alias("j"), F.lit(0).alias("role"), "node", "size", "items", "part")
    query = apart.select("group", F.explode(F.sequence(F.lit(0), F.col("stores") - 1)).alias("i"), F.pmod(own, "queries").cast("int").alias("j"), F.lit(1).alias("role"), "node", "size", "items", "part")
    met = store.unionByName(query).repartition(parts, "group", "i", "j").sortWithinPartitions("group", "i", "j", "role", "size", "node")
    more = materialize(met.mapInArrow(lambda it: _meet(it, num, den), "a long, b long"), "join-more-links")
    return documents, links.unionByName(more)


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, n_shingles, component_id, node, class, row; links between nodes: a, b). row is row_key()'s; class names
    a component of sets, and is null for an empty one."""
    documents, links = set_links(docs, n, num, den)
    label = materialize(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "join-labels")
    # empty sets stay apart
    classes = documents.join(label, "node", "left").withColumn("class", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")))
    # written first, so that the join has exchanges of its own and a class of many copies can be split
    least = materialize(classes.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least")), "join-least")
    out = classes.join(least, "class", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "node", "class", "row")
    return out, links


def one_per_group(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """The documents, with all their columns, without all but one of each group: the one of the least id stays, once.

    Rows without an id and documents without words are in no group and stay; of an id with several texts each goes by its own.
    """
    groups = materialize(jaccard_components(docs, n, num, den)[0].where("class is not null and doc_id is not null").select("doc_id", "class", "row"), "join-groups-of-docs")
    first = groups.groupBy("class").agg(F.min(F.struct("doc_id", "row"))["row"].alias("stays"), F.count("*").alias("c")).where("c > 1").select("class", "stays")
    members = materialize(groups.join(materialize(first, "join-stays"), "class"), "join-members-of-groups")
    own = next(f"_row{i}" for i in range(99) if f"_row{i}" not in docs.columns)
    keyed = docs.withColumn(own, row_key())
    gone = members.where("row <> stays").select(F.col("row").alias(own)).distinct()
    kept = drop_keys(keyed, gone, own)
    again = members.where("row = stays").groupBy("row").agg(F.count("*").alias("c")).where("c > 1").select(F.col("row").alias(own))
    if again.isEmpty():
        return kept.select(*docs.columns)
    single = kept.join(again.hint("shuffle_hash"), own, "left_semi").dropDuplicates([own])
    return drop_keys(kept, again, own).select(*docs.columns).unionByName(single.select(*docs.columns))
