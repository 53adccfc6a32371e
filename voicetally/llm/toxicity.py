"""Toxicity by a weighted finite-state pattern grammar over clauses.

A clause's words are symbols of closed classes, or an insult with its learned weight. Five weighted transducers are composed,
each reading what the one before it writes: reported speech and negation mark insults and threats in their reach, target
marks insults that follow one, insult finds insult phrases (noun or adjective phrases around insults, with a target
before or after), and threat finds a speaker's intent to harm. Weights on the arcs multiply along the composition: an
intensifier raises the phrase it opens, a further insult in a phrase counts as part of it. A clause counts once per setting
(plain, at a target, negated, reported, menace), with its strongest match, so isolated repeated words do not add up.

Insults are words and word stems whose log likelihood ratio in labelled rows is large; it is their weight. What a match counts
in its setting is part of the grammar (`FACTORS`): a menace counts most, an insult at a target more than a plain one, a negated
one a fifth, and a reported one an eighth. Labelled rows only tell how the sums of matches turn into a probability: an
intercept and two slopes that are not negative (of all matches, and of their density), by logistic regression. So the setting
of the same words decides between texts, whatever the rows happen to hold. Both come from at most `max_rows` rows, and nothing
else is capped.

Null, empty and wordless texts match nothing and get the intercept's score; repeated rows count each; of several labels of
one id the largest counts; a label other than 0 or 1, or none, is not learned from; with no labelled rows every score is 0.
Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._io import as_hash, as_long, filter_rows, text_chunks

#: Closed word classes of the grammar.
NEGATION = "not no never nobody nothing isn aren wasn weren don doesn didn won nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún".split()
REPORTED = "said says told wrote claimed quoted called reported sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó".split()
TARGET = "you your yours he she him her they them their people du dich dir ihr euch sie vous toi tu te ils elles ellos usted ustedes ella".split()
SPEAKER = "i we ich wir je nous yo nosotros".split()
INTENT = "will shall gonna wanna want going must should werde werden vais allons voy vamos".split()
_THREAT = "kill hurt beat destroy burn shoot stab hang strangle punish crush".split()
_THREAT_FORMS = "shot hung beaten stabbing stabbed töten töte schlagen schlage verbrennen verbrenne tuer frapper brûler tuerai frapperai matar golpear quemar mataré golpearé".split()


def inflected(verb: str) -> list[str]:
    stem = verb.removesuffix("e")
    return [verb, f"{verb}{'es' if verb.endswith('sh') else 's'}", f"{stem}ed", f"{stem}ing"]


THREAT = [f for v in _THREAT for f in inflected(v)] + _THREAT_FORMS

COPULA = "is are am was were be being re bist ist sind seid est es sont son eres".split()
DETERMINER = "a an the this that these ein eine der die das dieser un une le la les ce cet cette una el los las este esta".split()
INTENSIFIER = "so very such total complete utter really truly absolute sehr echt si très vraiment muy tan".split()

OTHER, BREAK, NEG, REP, TGT, SPK, INT, THR, INS, COP, DET, MOD = range(12)
BASES = 12
#: Settings in which a match stands. A symbol of a tape is its class and its setting; the input's settings are plain.
PLAIN, AT_TARGET, NEGATED, REPORT, MENACE = range(5)
#: What a match counts in its setting.
FACTORS = np.array([1.0, 1.3, 0.2, 0.12, 1.5])
SYMBOLS = BASES * 5
#: Of what the grammar writes besides unmatched symbols: the insult before has its target behind it.
TARGET_AFTER = SYMBOLS
#: Of a text: one sum per setting, and the density of all as they count.
FEATURES = 6
STEMS = (4, 5, 6, 7, 8)
RESULT = "doc_id long, held_out boolean, score double, predicted int"


class Transducer:
    """A weighted deterministic transducer: per state and symbol the next state, the symbol written, and a factor.

    Unless an arc is set otherwise it copies its symbol, with factor 1; a clause break leads back to the start.
    """

    def __init__(self, states: int):
        self.next = np.zeros((states, SYMBOLS + 1), np.int64)
        self.out = np.tile(np.arange(SYMBOLS + 1), (states, 1))
        self.weight = np.ones((states, SYMBOLS + 1))

    def arc(self, state, base: int, to=None, mark: int | None = None, weight: float | None = None):
        """The arcs of a class in all its settings; mark: the setting written where it is plain or at a target."""
        for setting in range(5):
            symbol = base * 5 + setting
            if to is not None:
                self.next[state, symbol] = to
            if mark is not None and setting < NEGATED:
                self.out[state, symbol] = base * 5 + mark
            if weight is not None:
                self.weight[state, symbol] = weight
        return self

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: other reads what self writes."""
        n = len(other.next)
        both = Transducer(len(self.next) * n)
        for a in range(len(self.next)):
            for b in range(n):
                row, mid = a * n + b, self.out[a]
                both.next[row] = self.next[a] * n + other.next[b, mid]
                both.out[row] = other.out[b, mid]
                both.weight[row] = self.weight[a] * other.weight[b, mid]
        return both


def reach(on: int, span: int, mark: int, over: tuple[int, ...]) -> Transducer:
    """Marks symbols of `over` that come at most `span` words after a symbol of `on` (0: anywhere after it in the clause)."""
    t = Transducer(max(span, 1) + 1)
    for state in range(len(t.next)):
        for base in range(BASES):
            t.arc(state, base, to=0 if base == BREAK else state if not span else state + 1 if 0 < state < span else 0)
        t.arc(state, on, to=1)
        if state:
            for base in over:
                t.arc(state, base, mark=mark)
    return t


def insult() -> Transducer:
    """Insult phrases. States: nothing; a phrase is open; opened by an intensifier; one and two words after an insult."""
    none, opened, strong, after, later = range(5)
    t = Transducer(5)
    for state in range(5):
        for base in range(BASES):
            t.arc(state, base, to=later if state == after and base != BREAK else none)
        for base in (COP, DET):
            t.arc(state, base, to=strong if state == strong else later if state == after else opened)
        t.arc(state, MOD, to=strong)
        t.arc(state, INS, to=after, weight={opened: 1.0, strong: 1.5, after: 0.5}.get(state, 1.0))
    for state in (after, later):
        # the target follows its insult
        t.arc(state, TGT, to=none)
        t.out[state, TGT * 5 + PLAIN] = TARGET_AFTER
    return t


def threat() -> Transducer:
    """Speaker, then intent, then a threat verb, with up to one word between; what is written then is a menace."""
    t = Transducer(5)
    for state, skip in ((1, 2), (3, 4)):
        for base in range(BASES):
            t.arc(state, base, to=0 if base == BREAK else skip)
        t.next[state, TARGET_AFTER] = skip
    for state in range(5):
        t.arc(state, SPK, to=1)
    for state in (1, 2):
        t.arc(state, INT, to=3)
    for state in range(5):
        t.arc(state, THR, to=0)
    for state in (3, 4):
        t.arc(state, THR, mark=MENACE, weight=3.0)
    return t


GRAMMAR = reach(REP, 0, REPORT, (INS, THR)) @ reach(NEG, 3, NEGATED, (INS, THR)) @ reach(TGT, 4, AT_TARGET, (INS,)) @ insult() @ threat()
_NEXT, _OUT, _WEIGHT = GRAMMAR.next.tolist(), GRAMMAR.out.tolist(), GRAMMAR.weight.tolist()


def clause_matches(symbols: list[int], weights: list[float]) -> list[float]:
    """The strongest match of a clause in each setting. symbols: classes; weights: of the insults among them."""
    best, state, last = [0.0] * 5, 0, None
    for base, w in zip(symbols, weights):
        symbol = base * 5
        out, factor = _OUT[state][symbol], _WEIGHT[state][symbol]
        state = _NEXT[state][symbol]
        if out == TARGET_AFTER:
            if last is not None:
                best[AT_TARGET] = max(best[AT_TARGET], last)
                last = None
        elif base == INS:
            setting = out % 5
            # a plain insult waits for a target that may follow
            best[setting] = max(best[setting], w * factor)
            last = w * factor if setting == PLAIN else None
        elif base == THR and factor > 1:
            best[out % 5] = max(best[out % 5], factor)
    return best


def _classes() -> tuple[np.ndarray, np.ndarray]:
    listed = ((NEG, NEGATION), (REP, REPORTED), (TGT, TARGET), (SPK, SPEAKER), (INT, INTENT), (THR, THREAT), (MOD, INTENSIFIER), (COP, COPULA), (DET, DETERMINER))
    pairs: dict[str, int] = {}
    for symbol, words in listed:  # of a word in several classes the first counts
        for w in words:
            pairs.setdefault(w, symbol)
    h = W.scan(pa.array(list(pairs), pa.large_string()), _letters()).hash
    order = np.argsort(h)
    return h[order], np.array(list(pairs.values()))[order]


def _letters() -> np.ndarray:
    t = W.alnum_words()
    t[0x30:0x3A] = 0
    return t


def features(s: W.Words) -> np.ndarray:
    """(words, 1 + stems) keys: of the whole word, and of its first 4 to 8 bytes where it is longer than that."""
    padded = np.concatenate([_lowered(s.data), np.zeros(8, np.uint8)])
    code = np.zeros(len(s.start), np.uint64)
    keys = [s.hash]
    for j in range(max(STEMS)):
        code = (code << np.uint64(8)) | padded[s.start + j].astype(np.uint64)
        if j + 1 in STEMS:
            keys.append(np.where(s.end - s.start > j + 1, W.mix(code + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)), np.uint64(0)))
    return np.stack(keys, axis=1)


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 0x41) & (data < 0x5B), data + 0x20, data).astype(np.uint8)


class Grammar:
    """Learned insult features: sorted keys with their counts in toxic and clean training documents."""

    def __init__(self, key, toxic, clean, n_toxic, n_clean, least=3, ratio=10.0):
        self.key, self.toxic, self.clean, self.n = key, toxic, clean, (n_toxic, n_clean)
        self.least, self.ratio = least, ratio
        self.classes = _classes()
        self.coefficients = np.zeros(3)

    def weight(self, at, toxic_less=0, clean_less=0):
        """Log likelihood ratio of features; the training document itself can be left out of the counts."""
        t, c = self.toxic[at] - toxic_less, self.clean[at] - clean_less
        w = np.log((t + 0.5) / (self.n[0] - toxic_less + 1)) - np.log((c + 0.5) / (self.n[1] - clean_less + 1))
        return np.where((t >= self.least) & (w >= np.log(self.ratio)), w, 0.0)

    def matches(self, texts: pa.Array, labels=None) -> np.ndarray:
        """Per text the sums over its clauses' matches by setting, and what they count per hundred words (of 20 at least).

        labels: of training texts, which leave themselves out of the counts.
        """
        s = W.scan(texts, _letters())
        n, words = len(texts), len(s.hash)
        out = np.zeros((n, FEATURES))
        if not words:
            return out
        f = features(s)
        weight = np.zeros(words)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, f), len(self.key) - 1)
            word, col = np.nonzero((self.key[at] == f) & (f != 0))
            less = np.zeros(len(word)) if labels is None else labels[s.doc[word]].astype(float)
            got = self.weight(at[word, col], less, 0 if labels is None else 1 - less)
            np.maximum.at(weight, word, got)
        h, cls = self.classes
        at = np.minimum(np.searchsorted(h, s.hash), len(h) - 1)
        symbol = np.where(h[at] == s.hash, cls[at], OTHER)
        symbol[weight > 0] = INS
        stops = np.zeros(256, bool)
        stops[[ord(x) for x in ".!?;:\n"]] = True
        total = np.concatenate([[0], np.cumsum(stops[s.data])])
        new = np.ones(words, bool)
        new[1:] = (total[s.start[1:]] - total[s.end[:-1]] > 0) | (s.doc[1:] != s.doc[:-1])
        clause = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.append(first[1:], words)
        for c in np.unique(clause[(symbol == INS) | (symbol == THR)]).tolist():
            lo, hi = first[c], last[c]
            out[s.doc[lo], :-1] += clause_matches(symbol[lo:hi].tolist(), weight[lo:hi].tolist())
        out[:, -1] = 100 * (out[:, :-1] @ FACTORS) / np.maximum(np.diff(s.at), 20)
        return out

    @staticmethod
    def counted(sums: np.ndarray) -> np.ndarray:
        """1, the matches as they count in their settings, and their density."""
        logs = np.log1p(sums)
        return np.column_stack([np.ones(len(sums)), logs[:, :-1] @ FACTORS, logs[:, -1]])

    def probability(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.counted(sums) @ self.coefficients, -700, 700)))

    def fit(self, sums: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 60) -> None:
        """Ridge logistic regression by Newton steps, slopes held at 0 and above; the intercept is hardly held back."""
        x, b = self.counted(sums), np.zeros(3)
        penal = ridge * np.diag([1e-3, 1.0, 1.0]) * max(1, len(y) ** 0.5)
        free = np.ones(3, bool)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            slope = x.T @ (y - p) - penal @ b
            free = (b > 0) | (slope > 0) | [True, False, False]
            curve = (x * (p * (1 - p))[:, None]).T @ x + penal + 1e-9 * np.eye(3)
            step = np.zeros(3)
            step[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
            b = b + np.clip(step, -2, 2)
            b[1:] = np.maximum(b[1:], 0)
        self.coefficients = b


def learn(docs: DataFrame, labels: DataFrame, held_out, max_rows: int = 20_000) -> Grammar:
    """The grammar's weights from at most max_rows labelled rows (by a hash of their id) that are not held out."""
    spark = docs.sparkSession
    label = labels.where("toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    label = label.where(~held_out)
    # about max_rows of them by a hash threshold, then exactly that many at most
    share = min(1.0, 1.2 * max_rows / max(1, label.count()))
    label = label.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(label), "doc_id").select("text", "toxic")

    def count(batches):
        for b in text_chunks(batches, "text"):
            s = W.scan(b.column(0), _letters())
            f, y = features(s), b.column(1).to_numpy()
            parts = [np.unique(f[s.at[i] : s.at[i + 1]].ravel()) for i in range(b.num_rows)]
            key = np.concatenate(parts) if parts else f.ravel()
            toxic = np.repeat(y, [len(p) for p in parts])
            key, inv = np.unique(key, return_inverse=True)
            t = np.bincount(inv, toxic, len(key)).astype(np.int64)
            c = np.bincount(inv, 1 - toxic, len(key)).astype(np.int64)
            own = key != 0
            yield pa.RecordBatch.from_arrays([pa.array(as_long(key[own])), pa.array(t[own]), pa.array(c[own])], ["key", "toxic", "clean"])

    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counted = rows.mapInArrow(count, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    t, c = n.get(1, 0), n.get(0, 0)
    lift = F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("clean") + 0.5) / (c + 1))
    top = counted.where("toxic >= 3").withColumn("lift", lift).where("lift >= 1").select("key", "toxic", "clean").toArrow()
    key = as_hash(top.column(0))
    order = np.argsort(key)
    grammar = Grammar(key[order], top.column(1).to_numpy()[order], top.column(2).to_numpy()[order], t, c)
    sent = spark.sparkContext.broadcast(grammar)

    def match(batches):
        for b in text_chunks(batches, "text"):
            y = b.column(1).to_numpy()
            m = sent.value.matches(b.column(0), y)
            yield pa.RecordBatch.from_arrays([pa.array(m[:, j]) for j in range(FEATURES)] + [pa.array(y)], [f"m{j}" for j in range(FEATURES)] + ["toxic"])

    if t and c:
        seen = rows.mapInArrow(match, ", ".join(f"m{j} double" for j in range(FEATURES)) + ", toxic int").toArrow()
        grammar.fit(np.stack([seen.column(j).to_numpy() for j in range(FEATURES)], axis=1), seen.column(FEATURES).to_numpy())
    return grammar


def score(docs: DataFrame, labels: DataFrame, held_out, max_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. held_out: a boolean column over doc_id."""
    grammar = learn(docs, labels, held_out, max_rows)
    known = docs.sparkSession.sparkContext.broadcast(grammar)
    learned = bool(grammar.n[0] and grammar.n[1])

    def rate(batches):
        for b in text_chunks(batches, "text"):
            p = known.value.probability(known.value.matches(b.column(2))) if learned else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInArrow(rate, RESULT)


def clean(docs: DataFrame, labels: DataFrame, held_out, max_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score under the threshold."""
    grammar = learn(docs, labels, held_out, max_rows)
    if not (grammar.n[0] and grammar.n[1]):
        return docs
    known = docs.sparkSession.sparkContext.broadcast(grammar)
    return filter_rows(docs, lambda: lambda texts: known.value.probability(known.value.matches(texts)) < threshold)
