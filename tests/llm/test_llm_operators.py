import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from llm_data import SCHEMA, documents, frame  # noqa: E402

from voicetally.llm import _words as W  # noqa: E402
from voicetally.llm import chat_format, decontamination, jaccard_join, lang_id, lm_score, mixing, quality_rules, substring_dedup, token_store, toxicity  # noqa: E402
from voicetally.llm._io import shared_dir  # noqa: E402
from voicetally.llm.components import components  # noqa: E402
from voicetally.llm.queries import fold  # noqa: E402
from voicetally.llm.suffix_automaton import SuffixAutomaton  # noqa: E402

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- words and hashes ---


def test_scan_finds_the_same_words():
    texts = [r[1] or "" for r in documents()] + ["\x00a b", "a\x0bb\x1cc"]
    col = pa.array(texts, pa.large_string())
    for table, pattern, lower in ((W.space_words(False), SPACED, False), (W.alnum_words(), ALNUM, True)):
        s = W.scan(col, table)
        hashes = defaultdict(set)
        for i, t in enumerate(texts):
            words = pattern.findall(low(t) if lower else t)
            assert s.at[i + 1] - s.at[i] == len(words)
            for w, h in zip(words, s.hash[s.at[i] : s.at[i + 1]].tolist()):
                hashes[w].add(h)
        assert all(len(h) == 1 for h in hashes.values()) and len(set().union(*hashes.values())) == len(hashes)


def test_winnowing_keeps_one_of_every_window():
    rng = np.random.default_rng(0)
    at = np.array([0, 50, 50, 57, 200])
    h = rng.integers(0, 9, 200).astype(np.uint64)
    gram, ok = W.ngram_hash(W.mix(h), 3), W.valid(at, 3)
    chosen, least, whole = W.winnow(gram, ok, at, 5)
    for a, z in zip(at[:-1], at[1:]):
        for s in range(a, z - 7 + 1):
            assert whole[s] and chosen[s : s + 5].any() and least[s] == gram[s : s + 5].min()
    assert not whole[51:57].any() or whole[50]


# --- 1: decontamination ---


def bench_rows(seed=1):
    text = [r[1] for r in documents(seed)]
    return [(1, " ".join(text[7].split()[-40:])), (2, "Four words, ARE here!"), (10, "one"), (3, None), (4, "..."), (5, " ".join(text[70 % len(text)].split()[:12]) if text[70 % len(text)] else "zz"), (6, "nothing like this occurs in any of the documents at all")]


def expected_hits(docs, bench):
    windows = defaultdict(set)
    for i, t in bench:
        w = ALNUM.findall(low(t))
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[j : j + n])].add(None if i is None else str(i))
    out = []
    for r in docs:
        w, items = ALNUM.findall(low(r[1])), set()
        hit = [0] * len(w)
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    items |= windows[tuple(w[j : j + n])]
                    hit[j : j + n] = [1] * n
        out.append((r[0], len(w), sum(hit), len(items), hashlib.sha256(",".join(sorted(items - {None})).encode()).hexdigest(), sum(hit) > 0))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most,bloom", [(10_000_000, 1 << 25), (10, 1 << 25), (10, 0)])
def test_decontamination(spark, docs, monkeypatch, most, bloom):
    """Broadcast and joined fingerprints: null ids, repeated rows, ids of several texts, items of one id and without an id."""
    monkeypatch.setattr(decontamination, "BLOOM_KEYS", bloom)
    odd = [(None, documents()[7][1]), (None, "no such words"), (None, "no such words"), (3, documents()[7][1]), (3, "clean text of an id with another text")]
    rows = [*documents(), *[(i, t, "en", "s", 0, "", 0, 0, 0) for i, t in odd]]
    items = [*bench_rows(), bench_rows()[0], (1, "no such"), (None, "four words are here"), (None, documents()[7][1])]
    every, bench = frame(spark, rows), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))
    want = expected_hits(rows, items)
    got = decontamination.decontaminate(every, bench, max_broadcast_words=most)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    kept = decontamination.clean(every, bench, max_broadcast_words=most)
    assert kept.columns == every.columns
    assert sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(r[0]) for r in want if not r[5])
    assert decontamination.decontaminate(docs, bench.where("false"), max_broadcast_words=most).where("contaminated").count() == 0
    assert decontamination.decontaminate(empty(spark), bench, max_broadcast_words=most).count() == 0


# --- 2: quality rules ---


def test_quality_rules(spark, docs):
    con = duckdb.connect()
    table = pa.table({"doc_id": [r[0] for r in documents()], "text": [r[1] for r in documents()]})
    con.register("documents_all", table)
    con.sql("create view documents as select distinct on (doc_id) * from documents_all")
    book = quality_rules.apply_policy(quality_rules.ledger(docs.dropDuplicates(["doc_id"])))
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept"]
    got = sorted(tuple(r[c] for c in cols) for r in book.collect())
    assert got == sorted(tuple(dict(zip(q.columns, r))[c] for c in cols) for q in [con.sql(quality_rules.SQL)] for r in q.fetchall())
    rows = book.select("failed").collect()
    m = quality_rules.mask("v2")
    for r in quality_rules.ablation(book).collect():
        bit = 1 << list(quality_rules.RULES).index(r["rule"])
        assert r["n_failed"] == sum(1 for x in rows if x["failed"] & m & bit)
        assert r["n_failed_alone"] == sum(1 for x in rows if x["failed"] & m == bit)
        assert r["n_kept_without"] == sum(1 for x in rows if not x["failed"] & m & ~bit)
    assert quality_rules.ledger(empty(spark)).count() == 0
    assert not [x for x in ("Python", "Pandas", "Arrow") if x in book._jdf.queryExecution().executedPlan().toString()]


# --- 3: mixing ---


def water(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_running_sum(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.randint(0, 9)) for g in "ab" for i in rng.sample(range(1000), 200)]
    got = mixing.running_sum(spark.createDataFrame(rows, "g string, i long, v long"), ["g"], "i", "v", "before", 16).collect()
    assert len(got) == 400 and all(r["before"] == sum(v for g, i, v in rows if g == r["g"] and i < r["i"]) for r in got)


def test_mixing(spark, docs):
    mixed, plan, _ = mixing.mix(docs, block_words=16)
    rows = mixed.collect()
    assert len(rows) == docs.count()
    size, taken = Counter(), Counter()
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"]
    want = water(dict(size))
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * want[r["source"]] and r["source_size"] == size[r["source"]]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(docs.repartition(3), block_words=16)[0].collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, again)) == sorted(map(key, rows))
    # early slots already follow the shares: low discrepancy
    first = Counter(r["src"]["s"] for r in plan.where("slot < 64").select("src").collect())
    total = sum(want.values())
    assert all(abs(first[s or ""] - 64 * want[s] / total) < 6 for s in want)
    assert mixing.mix(empty(spark))[0].count() == 0
    assert set(mixing.mixed_rows(docs).columns) == set(docs.columns)


def test_mixing_takes_rows_without_id(spark):
    rows = [(None if i % 2 else i, f"{i} some words of a text " * 9, "en", f"src{i % 3}", 0, "", 0, 0, 0) for i in range(60)]
    rows += [rows[1], rows[2], (2, "another text of this id " * 9, "en", "src2", 0, "", 0, 0, 0)]
    got = mixing.mix(frame(spark, rows), block_words=16)[0].collect()
    taken, size = Counter(), Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
    want = water(dict(size))
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert any(r["doc_id"] is None for r in mixing.mixed_rows(frame(spark, rows)).collect())


# --- 4: Jaccard join ---


def shingles(text, n=5):
    w = SPACED.findall(low(text))
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def expected_components(rows, n=5):
    sets, head = [shingles(r[1], n) for r in rows], list(range(len(rows)))

    def find(a):
        while head[a] != a:
            a = head[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and sets[b]:
                head[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def test_jaccard_join(spark, docs):
    got, links = jaccard_join.jaccard_components(docs)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == expected_components(documents())
    kept = jaccard_join.one_per_group(docs)
    assert set(kept.columns) == set(docs.columns)
    want = {r[2] for r in expected_components(documents())}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert jaccard_join.jaccard_components(empty(spark))[0].count() == 0


def test_jaccard_join_of_a_chain(spark):
    """Neighbours link, ends do not: every member of a chain is in one component, whoever is the pivot."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60]), "en", "s", 0, "", 0, 0, 0) for i in range(80)]
    got = jaccard_join.jaccard_components(frame(spark, rows))[0].select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == expected_components(rows)


def test_one_of_each_group_stays(spark):
    """Ids of several texts, repeated rows, rows without an id, near copies of one id, and a column named as the key is."""
    words = [f"w{i}" for i in range(80)]
    u, near, v, other = " ".join(words), " ".join([*words[:79], "x"]), " ".join(f"v{i}" for i in range(50)), " ".join(f"o{i}" for i in range(50))
    rows = [(3, u), (5, near), (5, v), (6, v), (7, other), (7, other), (7, f"{other} end"), (None, u), (8, None), (8, ""), (9, "one")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, _row0 string")
    got = jaccard_join.one_per_group(docs)
    assert got.columns == docs.columns
    kept = Counter((r["doc_id"], r["text"]) for r in got.collect())
    seven = [k for k in kept if k[0] == 7]
    assert len(seven) == 1 and seven[0][1] in (other, f"{other} end") and kept.pop(seven[0]) == 1
    assert kept == Counter([(3, u), (5, v), (None, u), (8, None), (8, ""), (9, "one")])


def test_trie_links_join_the_components():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 30))).astype(np.uint64) for _ in range(80)]
    sets += [sets[0], sets[1][:-1], sets[2]]
    linked = [[100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b)) for b in sets] for a in sets]

    def classes(pairs):
        head = list(range(len(sets)))
        for a, b in pairs:
            x, y = head[a], head[b]
            head = [min(x, y) if h in (x, y) else h for h in head]
        return head

    tree = jaccard_join.Trie(75, 100)
    for s in sets:
        tree.add(s, len(s))
    found = tree.links(range(len(sets)))
    assert all(linked[a][b] for a, b in found) and len(found) < len(sets)
    assert classes(found) == classes([(a, b) for a in range(len(sets)) for b in range(a) if linked[a][b]])


def test_jaccard_join_in_blocks(spark, monkeypatch):
    """A hot group in blocks: near copies of one text, others that share its passage, and links across blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 5)
    monkeypatch.setattr(jaccard_join, "PART_ITEMS", 300)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        words = list(base)
        if i < 15:
            words[rng.randrange(60)] = f"x{i}"
        elif i < 25:
            words = words[:44] + [f"y{i // 2}z{k}" for k in range(20)] + [f"v{i}"]
        else:
            words = words[4 * (i - 25) : 60] + [f"u{(i - 25) * 4 + k}" for k in range(60)][: 4 * (i - 25)]
        rows.append((i, " ".join(words), "en", "s", 0, "", 0, 0, 0))
    rows = rng.sample(rows, len(rows)) + rows[:3]
    for n in (1, 5):
        got = jaccard_join.jaccard_components(frame(spark, rows).repartition(7), n=n)[0].select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got)) == expected_components(rows, n)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (8, 7), (5, 5)], "u long, v long")
    assert dict(map(tuple, components(edges).collect())) == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7}


# --- 5: token store ---


def test_token_store(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = [(900, "a<|endoftext|>b", None, "s", 0, "", 0, 0, 0), (901, "日本語 text\x1c x", None, "s", 0, "", 0, 0, 0), (None, "no id", None, "s", 0, "", 0, 0, 0)]
    every = docs.unionByName(frame(spark, odd))
    folder, manifest = token_store.write_store(every, path, shard_tokens=500, partitions=4)
    got = sorted(map(tuple, token_store.read_store(every, folder).collect()), key=lambda r: r[1])
    lib, at, want = Tokenizer.from_file(path), 0, []
    rows = sorted(documents() + odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert manifest.count() >= 4 and manifest.agg(F.sum("n_tokens")).first()[0] == at
    folder, _ = token_store.write_store(empty(spark), path)
    assert token_store.read_store(empty(spark), folder).count() == 0


def test_pieces_are_split_as_the_library_splits_them():
    """Every character that is encoded piece by piece, in random company, and others, which are encoded whole."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, ours = Tokenizer.from_file(path), token_store.Encoder(path, keep=500)
    usual = [chr(c) for c in (9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x2010, 0x2028), 0x20AC)]
    rng = random.Random(12)
    pairs = [a + b for a in usual for b in rng.sample(usual, 3)]
    mixed = ["".join(rng.choice([*usual, " ", " ", "a", "s", "'", "7", "\u0301", "\u3000", "\x0b", "😀", "\x00"]) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts = [*usual, *pairs, *mixed, "it's we'll I'D  two  spaces \n\n end ", "<|endoftext|> inside", ""]
    for lo in range(0, len(texts), 700):
        part = texts[lo : lo + 700]
        ids, bounds = ours.encode(part)
        assert [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])] == [e.ids for e in lib.encode_batch(part, add_special_tokens=False)]


def test_frequent_pieces_stay_when_the_cache_is_full():
    """Pieces of every text are learned once, though new ones fill the cache again and again."""
    import public_tokenizers

    ours, learned = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"), keep=100), []
    learn = ours._learn
    ours._learn = lambda pieces: learned.extend(pieces) or learn(pieces)
    for i in range(40):
        often, new = "".join(f" often{chr(97 + k)}" for k in range(20)), "".join(f" new{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}" for k in range(20))
        ids, _ = ours.encode([often * 3 + new])
        assert ids.tolist() == ours.lib.encode(often * 3 + new, add_special_tokens=False).ids
    assert len(learned) == len(set(learned)) == 20 + 40 * 20


def test_perfect_hash():
    keys = W.mix(np.arange(5000, dtype=np.uint64))
    h = token_store.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(5000))
    assert token_store.PerfectHash.build(keys[:0]).slots(keys[:3]).tolist() == [-1, -1, -1]


# --- 6: transcripts ---


def test_transcripts(spark):
    turns = [(c, t, ["user", "assistant"][t % 2], f"{'What is it' if t % 2 == 0 else 'It is so'} {c}?\nsecond line") for c in range(40) for t in range(6)]
    turns += [(50, 0, None, None), (51, 0, "user", ""), (None, 0, "user", "no id")]
    conv = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.recover(spark, conv, F.col("conv_id") % 4 == 0).collect()}
    assert len(got) == 43 and sum(r["n_right"] for r in got.values()) >= 0.98 * sum(r["n_known"] for r in got.values())
    assert got[3]["roles"] == ",".join(["user", "assistant"] * 3) and got[3]["n_lines"] == 12
    want = "".join(f"<|{'user' if t % 2 == 0 else 'assistant'}|>\n{'What is it' if t % 2 == 0 else 'It is so'} 3?\nsecond line\n<|end|>\n" for t in range(6))
    assert got[3]["rendered_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert chat_format.recover(spark, conv.where("false"), F.lit(False)).count() == 0


def test_transcripts_with_ties_and_gaps(spark):
    """Equal turns are ordered by their text, missing turns leave no trace, further columns are not read."""
    turns = [(c, t, ["user", "assistant"][k % 2], f"line {k} of {c}") for c in range(30) for k, t in enumerate((0, 3, 9, 10))]
    turns += [(99, 4, "user", "b second"), (99, 4, "user", "a first")]
    conv = spark.createDataFrame([(*r, "x", 5) for r in turns], "conv_id long, turn int, role string, text string, mark string, k int")
    got = {r["conv_id"]: r for r in chat_format.recover(spark, conv, F.lit(False)).collect()}
    assert all(got[c]["roles"] == "user,assistant,user,assistant" for c in range(30)) and got[99]["n_known"] == 2
    again = {r["conv_id"]: r for r in chat_format.recover(spark, conv.repartition(11), F.lit(False)).collect()}
    assert got == again


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(2)
    m = chat_format.Model(["a", "b"], rng.integers(0, 9, 4), rng.integers(0, 9, (4, 4)), rng.integers(0, 9, (4, 4)), rng.integers(0, 9, (4, 4)), rng.integers(0, 9, (4, 2)), rng.integers(0, 9, (4, 2)))
    obs = [rng.integers(0, k, 6) for k in (4, 4, 2, 2)]
    e = m.emit(*obs)
    import itertools

    def value(p):
        return m.start[p[0]] + sum(e[s, t] for t, s in enumerate(p)) + sum(m.step[a, b] for a, b in zip(p, p[1:]))

    best = max(itertools.product(range(4), repeat=6), key=value)
    assert abs(value(m.decode(e)) - value(best)) < 1e-9


def test_streamed_viterbi_is_the_best_path(monkeypatch):
    """Lines settled batch by batch have the states of the whole transcript's best path, also where paths meet late."""
    rng = np.random.default_rng(9)
    for late in (0, 1):
        steps = rng.integers(0, 9, (4, 4)) if not late else np.eye(4, dtype=int) * 10**6
        m = chat_format.Model(["a", "b"], rng.integers(0, 9, 4), steps, rng.integers(0, 9, (4, 4)), rng.integers(0, 9, (4, 4)), rng.integers(0, 9, (4, 2)), rng.integers(0, 9, (4, 2)))
        rows = [(int(rng.integers(0, 4)), int(rng.integers(0, 4)), int(rng.integers(0, 2)), int(rng.integers(0, 5) == 0), f"line {i}", "a") for i in range(300)]
        monkeypatch.setattr(chat_format, "BATCH", 10_000)
        whole = chat_format._Transcript(1, m)
        monkeypatch.setattr(chat_format, "BATCH", 7)
        parts, most = chat_format._Transcript(1, m), 0
        for r in rows:
            parts.add(r)
            most = max(most, len(parts.rows))
        monkeypatch.setattr(chat_format, "BATCH", 10_000)
        for r in rows:
            whole.add(r)
        assert whole.close() == parts.close() and (late or most < 200)


def test_transcripts_are_whole(spark):
    """Over 1000 turns, over 16 roles, blank lines inside turns: all turns come out, and whole."""
    text = lambda t: f"turn {t}\n\nafter a blank line"
    turns = [(1, t, ["user", "assistant"][t % 2], text(t)) for t in range(1500)]
    turns += [(2 + r, t, f"role{r:02}", "words") for r in range(20) for t in range(2)]
    conv = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    lines = chat_format.transcripts(conv)
    assert "blank" not in lines.columns and lines.where("role is null and line = ''").count() > 50
    # turns without any sign of their start cannot all be told; with markers all come out, whatever blank lines they hold
    lines = chat_format.transcripts(conv, plain=True)
    model = chat_format.train(lines, F.lit(False))
    assert len(model.roles) == 22
    got = sorted((r for r in chat_format.parse(lines, model).where("conv_id = 1").collect()), key=lambda r: r["turn"])
    want = [f"<|{r}|>\n{x}\n<|end|>\n" for c, _, r, x in turns if c == 1]
    right = sum(g["rendered"] == w for g, w in zip(got, want))
    one = {r["conv_id"]: r for r in chat_format.summary(lines, model).collect()}[1]
    assert len(got) == 1500 and right >= 1490
    assert 0.99 * one["n_unmarked"] <= one["n_unmarked_right"] <= one["n_unmarked"] > 100
    assert one["n_turns"] == 1500 and one["roles"] == ",".join(["user", "assistant"] * 750)
    assert one["rendered_sha256"] == hashlib.sha256("".join(g["rendered"] for g in got).encode()).hexdigest()


# --- 7: substring dedup ---


def expected_dedup(rows, n=35):
    words = [SPACED.findall(r[1] or "") for r in rows]
    count = Counter(tuple(w[j : j + n]) for w in words for j in range(len(w) - n + 1))
    out = []
    for r, w in zip(rows, words):
        gone = [0] * len(w)
        for j in range(len(w) - n + 1):
            if count[tuple(w[j : j + n])] > 1:
                gone[j : j + n] = [1] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_substring_dedup(spark, docs):
    one = docs.dropDuplicates(["doc_id"])
    rows = list({r[0]: r for r in documents()}.values())
    assert sorted(map(tuple, substring_dedup.dedup(one).drop("kept_text").collect())) == expected_dedup(rows)
    assert substring_dedup.dedup(empty(spark)).count() == 0


def deduped(df):
    return sorted(map(tuple, substring_dedup.dedup(df).drop("kept_text").collect()), key=repr)


@pytest.mark.parametrize("block,bloom", [(60_000, 1 << 25), (150, 1 << 25), (150, 0)])
def test_substring_dedup_of_null_and_repeated_ids(spark, docs, monkeypatch, block, bloom):
    """Whole tables with repeated rows, null ids and ids of several texts; anchors in one block and in several; with and without
    a Bloom filter."""
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", block)
    monkeypatch.setattr(substring_dedup, "BLOOM_KEYS", bloom)
    rows = documents()
    odd = [(None, f"{rows[7][1]} one"), (None, rows[14][1]), (None, rows[14][1]), (5, f"short {rows[21][1]} tail"), (5, "three new words")]
    every = docs.unionByName(frame(spark, [(i, t, "en", "s", 0, "", 0, 0, 0) for i, t in odd]))
    want = expected_dedup([(-1 if i is None else i, t) for i, t in [(r[0], r[1]) for r in rows] + odd])
    assert deduped(every) == sorted(((None if i == -1 else i, *r) for i, *r in want), key=repr)


def test_substring_dedup_keeps_what_stands_once(spark):
    """Rows of one id are told apart, rows without an id are deduped."""
    word = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(5, word("u")), (5, word("v")), (6, "q " + word("u")), (None, word("u"))]
    got = deduped(frame(spark, [(i, t, "en", "s", 0, "", 0, 0, 0) for i, t in rows]))
    assert [(r[0], r[1], r[2]) for r in got] == [(5, 60, 0), (5, 60, 60), (6, 61, 60), (None, 60, 60)]


def test_without_automata_nothing_is_found(spark, docs, monkeypatch):
    """Every repeat comes through an anchor's automaton: without what these give, no word goes."""
    assert sum(r["n_removed"] for r in substring_dedup.dedup(docs).collect()) > 0
    monkeypatch.setattr(substring_dedup, "_repeats", lambda batches, window: iter(()))
    assert {r["n_removed"] for r in substring_dedup.dedup(docs).collect()} == {0}


def test_matching_statistics():
    rng = np.random.default_rng(7)
    for _ in range(30):
        seqs = [rng.integers(0, 3, rng.integers(1, 12)).astype(np.uint64) for _ in range(4)]
        often = rng.integers(1, 4, 4).tolist()
        known = Counter()
        for s, n in zip(seqs, often):
            known.update({w: c * n for w, c in Counter(tuple(s[a:z]) for a in range(len(s)) for z in range(a + 1, len(s) + 1)).items()})
        doc = rng.integers(0, 4, 60).astype(np.uint64)
        want = [max([n for n in range(1, i + 2) if tuple(doc[i + 1 - n : i + 1]) in known], default=0) for i in range(len(doc))]
        auto = SuffixAutomaton(seqs, often)
        assert auto.statistics(doc).tolist() == want
        for k in (1, 2, 3, 5):
            assert auto.places(doc, k).tolist() == [known[tuple(doc[i + 1 - k : i + 1])] if i + 1 >= k else 0 for i in range(len(doc))]


# --- 8: toxicity ---


def toxic_rows():
    rows = []
    for i, r in enumerate(documents(seed=4, n=200)[:200]):
        bad = i % 4 == 0
        rows.append((i, (f"{r[1]}. you are a {'blorker' if i % 8 else 'Zarplish'} indeed. " if bad else r[1]), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(901, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels, fold(5, 0)).collect()}
    assert len(got) == 202 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    kept = toxicity.clean(docs, labels, fold(5, 0))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert {r["score"] for r in toxicity.score(docs, labels.where("false"), fold(5, 0)).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), labels, fold(5, 0)).count() == 0
    # of several labels of an id the largest counts, others than 0 and 1 none
    more = labels.unionByName(spark.createDataFrame([(i, 0) for i, _, _ in rows] + [(i, 7) for i, _, _ in rows], "doc_id long, toxic int"))
    assert {r["doc_id"]: r["score"] for r in toxicity.score(docs, more, fold(5, 0)).collect()} == {i: r["score"] for i, r in got.items()}


def test_toxicity_scores_by_plain_rules(spark):
    """Whole scores again from words, clauses, learned weights and the rules one by one."""
    T, rows = toxicity, toxic_rows()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "You said IDIOT; he is not such a blorker!\nblorker you")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    grammar = T.learn(docs, labels, fold(5, 0))
    classes = {}
    for symbol, words in ((T.NEG, T.NEGATION), (T.REP, T.REPORTED), (T.TGT, T.TARGET), (T.SPK, T.SPEAKER), (T.INT, T.INTENT), (T.THR, T.THREAT), (T.MOD, T.INTENSIFIER), (T.COP, T.COPULA), (T.DET, T.DETERMINER)):
        for w in words:
            classes.setdefault(w, symbol)
    known = {k: i for i, k in enumerate(grammar.key.tolist())}

    def weight(word):
        keys = T.features(W.scan(pa.array([word], pa.large_string()), T._letters()))[0].tolist()
        found = [known[k] for k in keys if k and k in known]
        return max(grammar.weight(np.array(found)), default=0.0) if found else 0.0

    def score(text):
        sums, n = np.zeros(T.FEATURES), 0
        for clause in re.split(r"[.!?;:\n]", low(text)):
            words = re.findall(r"[a-z\u0080-\U0010ffff]+", clause)
            n += len(words)
            weights = [weight(w) for w in words]
            sums[:-1] += plain_matches([T.INS if x > 0 else classes.get(w, T.OTHER) for w, x in zip(words, weights)], weights)
        counted = [1.0, 1.3, 0.2, 0.12, 1.5]
        density = 100 * sum(a * b for a, b in zip(sums, counted)) / max(n, 20)
        b = grammar.coefficients
        return 1 / (1 + math.exp(-(b[0] + b[1] * sum(math.log1p(a) * c for a, c in zip(sums, counted)) + b[2] * math.log1p(density))))

    got = {r["doc_id"]: r["score"] for r in T.score(docs, labels, fold(5, 0)).collect()}
    assert len(got) == 202
    for i, t in [(r["doc_id"], r["text"]) for r in docs.collect()]:
        assert abs(got[i] - score(t or "")) < 1e-9, t


def test_toxicity_grammar_tells_settings():
    words = ["idiot"]
    key = W.scan(pa.array(words, pa.large_string()), toxicity._letters()).hash
    g = toxicity.Grammar(key, np.array([50]), np.array([0]), 100, 100)
    texts = ["an idiot here", "you are an idiot", "not an idiot", "he said idiot", "I will kill you", "no. idiot", "I will. kill", "idiot you", "I will not kill", "they said I will kill"]
    m = g.matches(pa.array(texts, pa.large_string()))
    settings = [np.flatnonzero(r[:-1]).tolist() for r in m > 0]
    T = toxicity
    assert settings == [[T.PLAIN], [T.AT_TARGET], [T.NEGATED], [T.REPORT], [T.MENACE], [T.PLAIN], [], [T.PLAIN, T.AT_TARGET], [T.NEGATED], [T.REPORT]]
    one, strong, twice = g.matches(pa.array(["an idiot", "such an idiot", "idiot idiot"], pa.large_string()))[:, T.PLAIN]
    assert abs(strong - 1.5 * one) < 1e-12 and twice == one


def test_toxicity_by_the_setting_of_the_same_words(spark, monkeypatch):
    """Pairs that words alone cannot tell: direct against negated and reported insults, and threats against the same verbs in
    other clauses. The grammar tells them; with the largest insult weight of a clause in its place half are wrong."""
    rng = random.Random(4)
    names = ["blorker", "snizzle", "grumwit"]
    filler = lambda: " ".join(rng.choice("the river runs down past old mills and green fields in spring".split()) for _ in range(rng.randint(6, 14)))
    direct = ["you are such a {}", "you {}", "he is a total {}", "a {} he is"]
    soft = ["you are not a {}", "they said a {}", "nobody wrote that {}", "she is never a {}"]
    threats, calm = ["i will kill you", "we are going to hurt you", "i shall be beating you"], ["i will not kill time", "they said we will hurt", "the fires destroy mills", "we will not be beating you"]
    around = lambda clause: f"{filler()}. {rng.choice(direct + soft).format('friend')}. {clause}. {rng.choice(threats + calm).replace('kill', 'help').replace('hurt', 'meet').replace('beating', 'calling')}."
    insult = lambda forms: around(rng.choice(forms).format(rng.choice(names)))
    rows = [(insult(direct), 1) for _ in range(300)] + [(around(rng.choice(threats)), 1) for _ in range(60)] + [(insult(soft), 0) for _ in range(25)] + [(around(rng.choice(calm)), 0) for _ in range(25)] + [(around(filler()), 0) for _ in range(3000)]
    docs, labels = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    grammar = toxicity.learn(docs, labels, F.lit(False))
    pairs = [(insult(f), y) for f, y in ((direct, 1), (soft, 0)) for _ in range(100)] + [(around(rng.choice(f)), y) for f, y in ((threats, 1), (calm, 0)) for _ in range(30)]
    texts, y = pa.array([t for t, _ in pairs], pa.large_string()), np.array([y for _, y in pairs])
    right = lambda: ((grammar.probability(grammar.matches(texts)) >= 0.5) == y).mean()
    by_grammar = right()
    alone = lambda symbols, weights: [max([w for s, w in zip(symbols, weights) if s == toxicity.INS], default=0.0), 0.0, 0.0, 0.0, 0.0]
    monkeypatch.setattr(toxicity, "clause_matches", alone)
    truth = np.array([y for _, y in rows])
    grammar.fit(grammar.matches(pa.array([t for t, _ in rows], pa.large_string()), truth), truth)
    by_words = right()
    assert by_grammar > 0.95 and by_words < 0.65, (by_grammar, by_words)


def test_threat_verbs_are_inflected():
    assert {"kill", "kills", "killed", "killing", "destroys", "burning", "hanged", "punishes", "strangling", "shot"} <= set(toxicity.THREAT)
    g = toxicity.Grammar(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), 1, 1)
    m = g.matches(pa.array(["We are going to kill him", "I want to be killing", "I will help", "they kill"], pa.large_string()))
    assert [np.flatnonzero(r[:-1]).tolist() for r in m] == [[toxicity.MENACE], [], [], []]


def plain_matches(symbols, weights):
    """The grammar's rules one by one, each looking back from its word."""
    T, best = toxicity, [0.0] * 5

    def since(i, on):
        return next((i - j for j in range(i - 1, -1, -1) if symbols[j] == on), None)

    def phrase(i):
        """Factor of the insult at i, by what opens its phrase."""
        if i and symbols[i - 1] == T.INS:
            return 0.5
        strong, j = False, i - 1
        while j >= 0 and symbols[j] in (T.COP, T.DET, T.MOD):
            strong |= symbols[j] == T.MOD
            j -= 1
        return 1.5 if strong else 1.0

    for i, s in enumerate(symbols):
        reported, neg, target = (since(i, x) for x in (T.REP, T.NEG, T.TGT))
        if s == T.INS:
            setting = T.REPORT if reported else T.NEGATED if neg and neg <= 3 else T.AT_TARGET if target and target <= 4 else T.PLAIN
            got = weights[i] * phrase(i)
            best[setting] = max(best[setting], got)
            if setting == T.PLAIN and T.TGT in symbols[i + 1 : i + 3] and T.INS not in symbols[i + 1 : i + 2]:
                if symbols[i + 1] == T.TGT or symbols[i + 1] not in (T.MOD, T.TGT):
                    best[T.AT_TARGET] = max(best[T.AT_TARGET], got)
        elif s == T.THR:
            for a in (i - 1, i - 2):
                if a >= 0 and symbols[a] == T.INT and T.SPK not in symbols[a + 1 : i] and T.THR not in symbols[a + 1 : i]:
                    for b in (a - 1, a - 2):
                        if b >= 0 and symbols[b] == T.SPK and not {T.INT, T.THR} & set(symbols[b + 1 : a]):
                            best[T.REPORT if reported else T.NEGATED if neg and neg <= 3 else T.MENACE] = max(best[T.REPORT if reported else T.NEGATED if neg and neg <= 3 else T.MENACE], 3.0)
    return best


def test_composed_grammar_equals_its_rules():
    rng = random.Random(8)
    T = toxicity
    symbols = [T.OTHER, T.NEG, T.REP, T.TGT, T.SPK, T.INT, T.THR, T.INS, T.INS, T.COP, T.DET, T.MOD]
    for _ in range(4000):
        s = [rng.choice(symbols) for _ in range(rng.randint(0, 9))]
        w = [rng.choice([1.0, 2.0, 3.0]) if x == T.INS else 0.0 for x in s]
        assert T.clause_matches(s, w) == plain_matches(s, w), s


# --- 9: language model ---


def expected_lm(tokens, out):
    """Smoothing with the lower order as a prior, over words, pairs and triples, from all counts: [(base, score)]."""
    words, pairs, triples = Counter(), Counter(), Counter()
    for t, held in zip(tokens, out):
        if not held:
            s = ["<", *t]
            words.update(t)
            words["<"] += 1
            pairs.update(zip(s, s[1:]))
            triples.update(zip(s, s[1:], s[2:]))
    starts = words.pop("<", 0)
    base = sum(words.values()) + 0.1 * (len(words) + 1)
    every = [words, pairs, triples]
    pair_prior, triple_prior = lm_score.priors(lm_score.histogram(np.array([n for c in every for n in c.values()], np.int64), np.repeat([0, 1, 2], [len(c) for c in every])))

    def p(g):
        if len(g) == 1:
            return (words[g[0]] + 0.1) / base
        prior, seen, n = (pair_prior, starts if g[0] == "<" else words[g[0]], pairs[g]) if len(g) == 2 else (triple_prior, pairs[g[:2]], triples[g])
        return (n + prior * p(g[1:])) / (seen + prior)

    whole = lambda t, k: sum(math.log10(p(tuple(["<", *t][max(0, j + 1 - k) : j + 2]) if k else (t[j],))) for j in range(len(t)))
    return [(whole(t, 0), whole(t, 2)) for t in tokens], words


@pytest.mark.parametrize("parts,size,cells", [(1, 1_000_000, 10**9), (23, 300, 10**9), (40, 1, 10**9), (1, 1_000_000, 0), (23, 300, 0)])
def test_lm_score(spark, docs, monkeypatch, parts, size, cells):
    """All n-grams are counted exactly, whatever the partitioning, in packs and singly, with repeated rows and null text."""
    monkeypatch.setattr(lm_score, "PART_GRAMS", 2000)
    monkeypatch.setattr(lm_score, "MOST_CELLS", cells)
    rows = documents()
    tokens = [[*SPACED.findall(low(r[1])), None] for r in rows]
    out = [zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    sums, words = expected_lm(tokens, out)
    want = sorted((r[0], o, len(t), sum(words[w] > 0 for w in t), sum(words.values()), *s) for r, t, o, s in zip(rows, tokens, out, sums))
    got = sorted(map(tuple, lm_score.score(docs.repartition(parts), fold(10, 0), chunk_words=size).select(*lm_score.RESULT).collect()))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-9)
    if parts == 1:
        assert lm_score.score(empty(spark), fold(10, 0)).count() == 0
        none = lm_score.score(docs, F.lit(True)).collect()  # nothing is trained on
        assert len(none) == len(rows) and all(r["n_known"] == r["train_tokens"] == 0 and abs(r["score"] - r["base_score"]) < 1e-6 for r in none)


def test_lm_priors_leave_to_new_words_what_comes_once():
    """Of texts with contexts of one size the share is plain: k / (size - 1 + k) of each context's tokens come once."""
    rng = np.random.default_rng(3)
    for size, once in ((10, 3), (40, 8), (7, 1)):
        contexts, n = np.full(500, size), 500 * once
        pairs = np.concatenate([np.ones(n, np.int64), np.full(200, 5)])
        k, _ = lm_score.priors(lm_score.histogram(np.concatenate([contexts, pairs]), np.repeat([0, 1], [500, len(pairs)])))
        assert abs(size * k / (size - 1 + k) - once) < 1e-6
    c = rng.zipf(1.5, 5000)
    assert abs((np.array([lm_score._bin_values()[b] for b in lm_score._bin(c[c < 65536])]) / c[c < 65536] - 1)).max() < 0.1


def test_lm_probabilities_sum_to_one():
    texts = ["a b c a b d", "a b c", "b c a b c", "c c a b d"] * 5
    word = lambda text: W.scan(pa.array([text], pa.large_string()), W.space_words(True)).hash
    trained = [np.append(word(t), lm_score.END) for t in texts]
    total = sum(map(len, trained))

    def whole(t):
        """Probability of a text that goes on after t."""
        if not len(t):
            return 1.0
        every = [t, *trained]
        g = lm_score.Grams(np.concatenate(every), np.cumsum([0, *map(len, every)]), np.arange(len(t) + total) >= len(t))
        return 10 ** lm_score.Automaton(g, g.trained, total, 5, (7.0, 3.0)).score()[0]

    for before in ("", "a", "a b", "d", "c c", "zz"):
        nexts = [*word("a b c d"), lm_score.END, np.uint64(12345)]  # the last one stands for all unknown words
        assert abs(sum(whole(np.append(word(before), x)) for x in nexts) / whole(word(before)) - 1) < 1e-9


# --- 10: language ---


def test_lang_id(spark, docs):
    got = lang_id.identify(docs.dropDuplicates(["doc_id"]), fold(3, 1)).collect()
    rows = {r[0]: r for r in documents()}
    for r in got:
        text, lang = rows[r["doc_id"]][1], rows[r["doc_id"]][2]
        if not text or not any(ch.isalpha() for ch in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("de", "en") and 0 <= r["score"] <= 1
            if lang and r["held_out"] and len(text.split()) > 8 and r["doc_id"] < 60 and r["doc_id"] % 10 != 9:
                assert r["lang_pred"] == lang
    assert {r["lang_pred"] for r in lang_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), fold(3, 1)).collect()} == {"und"}
    assert lang_id.identify(empty(spark), fold(3, 1)).count() == 0


def byte_grams(text):
    """4-byte windows of letters in lower case, all else one blank each, two blanks around the text, none over two blanks."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
    raw = b"  " + raw + b"  "
    return [raw[i : i + 4] for i in range(len(raw) - 3) if b"  " not in raw[i : i + 4]]


def expected_languages(rows, share=0.3, least=2):
    """Exact sets in place of filters, over all rows: {index: (language, score)} of rows that have n-grams."""
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and lang is not None and text is not None:
            counts[lang].update(byte_grams(text))
    total = {x: sum(c.values()) for x, c in counts.items()}
    most = Counter()
    for x, c in counts.items():
        for g, n in c.items():
            most[g] = max(most[g], n / total[x])
    known = {x: {g for g, n in c.items() if n >= least and n / total[x] >= share * most[g]} for x, c in sorted(counts.items())}
    out = {}
    for k, (_, text, _) in enumerate(rows):
        hits = {x: sum(g in grams for g in byte_grams(text)) for x, grams in known.items()}
        top = sorted(hits.values(), reverse=True)
        if top and top[0] > top[1]:
            out[k] = (max(hits, key=hits.get), top[0] / (top[0] + top[1]), top[0] - top[1])
    return out


@pytest.mark.parametrize("room", [None, 8 << 10])
def test_lang_id_against_exact_sets(spark, docs, monkeypatch, room):
    """Repeated rows count each; where one language is ahead, it is predicted with its share of hits. With all cells at once, and
    in slices of 1,024 cells."""
    if room:
        monkeypatch.setattr(lang_id, "LEAST_LOG2", 8)
        _, log2, slices, cells_of = lang_id.learn(docs.where("lang is not null and text is not null"), max_bytes=room)
        assert log2 == 10 and slices > 4 and all(c.nbytes == room and 0 < (c != 0).mean() < 0.7 for c in map(cells_of, range(slices)))
    rows = documents()
    got = defaultdict(list)
    for r in lang_id.identify(docs, fold(3, 1), max_bytes=room).collect():
        got[r["doc_id"]].append((r["lang_pred"], r["score"]))
    want = expected_languages([r[:3] for r in rows])
    clear = {k: w for k, w in want.items() if w[2] >= 3}
    assert len(clear) > 60
    for k, (lang, score, _) in clear.items():
        assert all(g == lang and abs(s - score) < 0.05 for g, s in got[rows[k][0]]), rows[k]


def test_over_64_languages(spark):
    words = lambda x: " ".join(f"{chr(97 + x // 26)}{chr(97 + x % 26)}{c}{c}{chr(97 + x % 26)}" for c in "abcdefgh")
    rows = [(7 * x + k, words(x), f"l{x:02}") for x in range(90) for k in range(7)]
    got = lang_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), fold(3, 1)).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {i: lang for i, _, lang in rows}


def test_bit_sliced_filters_give_all_languages():
    cells = np.zeros((2, 1 << 16), np.uint64)
    grams = np.array([1, 2, 3], np.uint32)
    for g, mask in zip(grams.tolist(), (1, 2, 3)):
        for a in lang_id.PROBES:
            cells[1, ((g * a) & 0xFFFFFFFF) >> 16] |= np.uint64(mask)
    masks = lang_id.languages_of(grams, cells)
    assert masks.tolist() == [[0, 0, 0], [1, 2, 3]]
    assert lang_id.has(masks, 65).tolist() == [False, True, True]


# --- the shared folder ---


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session)
