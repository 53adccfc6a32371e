"""Secrets in texts by a trigram index: DataFrame operations only.

From each rule's pattern a Boolean query over trigrams is derived: alternatives of sets of trigrams that a match must hold (on
lower-cased text, so letter case does not matter). The index has a posting (term, key) for every document and every trigram
that some query names. Postings of a document meet in one small row, each alternative is an intersection of its terms, and only
documents that satisfy a rule's query are verified with its pattern. A rule without mandatory trigrams scans all texts.

A key is a 64-bit hash of id and text. Equal keys only let a document be verified in vain, and never hide one. Matches are
leftmost and do not overlap within a kind; a match whose value is too short is dropped and still uses up its text. Offsets count
code points. Null texts are empty, repeated rows are found alike, rows without an id keep a null id, an empty table gives no
rows, and only the named columns are read.
"""

from __future__ import annotations

from functools import reduce
from re import _constants as C
from re import _parser as P
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let, prefix_sums
from ._io import discard, stored


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  # whose length counts
    least: int = 1


def either(word: str) -> str:
    """A word with its letters in either case."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(either, ("password", "passwd", "secret", "token"))) + f"|{either('api')}_?{either('key')}"
#: The base rules, in the order of their kinds. A run of 32 hexadecimal digits or more is the same as any run that is long enough.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}", 0, 32),
)
#: Rules that add spans: forms in which public services hand out their keys.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/=-]+)", 1, 20),
    Rule("url_login", r"[a-z]{2,12}://[^/:@\x20\x09-\x0D]+:[^/@\x20\x09-\x0D]+@"),
)
RULES = BASE + MORE
#: Candidates up to this number are joined by broadcast (16 bytes each).
MAX_BROADCAST = 1_000_000
SALTS = 8

# --- queries from patterns ---

Query = frozenset  # of frozensets of trigrams: any of them, each whole; {{}} holds always
ALWAYS: Query = frozenset([frozenset()])
#: Strings that are followed one by one, characters of a class, and alternatives of a query, before a pattern is taken as open.
MOST_STRINGS, MOST_CHARS, MOST_ALTERNATIVES = 64, 8, 32


def absorbed(q) -> Query:
    """Without the alternatives that ask for more than another one does."""
    q = frozenset(q)
    return frozenset(a for a in q if not any(b < a for b in q))


def both(q: Query, r: Query) -> Query:
    out = absorbed(a | b for a in q for b in r)
    return out if len(out) <= MOST_ALTERNATIVES else min(q, r, key=len)  # fewer demands are right, too


def of_strings(strings) -> Query:
    return absorbed(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _chars(items) -> set[str] | None:
    """Lower-cased characters of a class; None if it is open. Case beyond ASCII depends on context and counts as open."""
    out: set[str] = set()
    for op, v in items:
        if op is C.LITERAL and v < 128:
            out.add(chr(v).lower())
        elif op is C.RANGE and v[1] < 128:
            out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
        else:
            return None
    return out if len(out) <= MOST_CHARS else None


def _one(op, v) -> tuple[set[str] | None, Query]:
    """What one element of a pattern matches: all its strings if they are few, else None, and a query that matches must satisfy."""
    if op is C.LITERAL:
        return ({chr(v).lower()} if v < 128 else None), ALWAYS
    if op is C.IN:
        return _chars(v), ALWAYS
    if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
        return {""}, ALWAYS
    if op is C.SUBPATTERN:
        return _sequence(v[3])
    if op is C.BRANCH:
        each = [_sequence(x) for x in v[1]]
        if all(s is not None for s, _ in each) and len(out := set().union(*[s for s, _ in each])) <= MOST_STRINGS:
            return out, ALWAYS
        q = absorbed(a for s, q in each for a in (q if s is None else both(q, of_strings(s))))
        return None, q if len(q) <= MOST_ALTERNATIVES else ALWAYS
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        lo, hi, body = v
        strings, q = _sequence(body)
        if strings is not None and hi <= 4 and sum(len(strings) ** k for k in range(lo, int(hi) + 1)) <= MOST_STRINGS:
            out, power = set(), {""}
            for k in range(int(hi) + 1):
                out |= power if k >= lo else set()
                power = {a + b for a in power for b in strings}
            return out, ALWAYS
        return None, (q if strings is None else of_strings(strings)) if lo else ALWAYS
    return None, ALWAYS


def _sequence(items) -> tuple[set[str] | None, Query]:
    strings, query, whole = {""}, ALWAYS, True
    for op, v in items:
        s, q = _one(op, v)
        if s is not None and len(strings) * len(s) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in s}
            continue
        query, whole = both(both(query, of_strings(strings)), q), False
        strings = {""} if s is None else s
    return (strings, query) if whole else (None, both(query, of_strings(strings)))


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams that the lower-cased text around any match holds."""
    strings, q = _sequence(P.parse(pattern))
    return q if strings is None else of_strings(strings)


# --- the index ---


def terms_of(rules) -> list[str]:
    return sorted(set().union(*[a for r in rules for a in trigram_query(r.pattern)]))


def _key() -> Column:
    return F.xxhash64("doc_id", "t")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(term, key): every document that holds a term."""
    d = _texts(docs).select(_key().alias("key"), F.lower("t").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(x)), F.lit(x)) for x in terms])) if terms else F.array().cast("array<string>")
    # an outer generator: before an inner one Spark puts a filter that looks for all terms a second time
    return d.select("key", F.explode_outer(held).alias("term")).where("term is not null").select("term", "key")


def candidates(index: DataFrame, rules) -> DataFrame:
    """(key, rules): the documents that satisfy a rule's query, with a bit for each such rule (in the rules' order)."""
    terms, width = terms_of(rules), 60
    places = F.create_map(*[F.lit(v) for i, x in enumerate(terms) for v in (x, i)])
    words = range(-(-len(terms) // width))
    at = index.select("key", F.element_at(places, F.col("term")).alias("i"))
    bit = F.pow(F.lit(2.0), F.col("i") % width).cast("long")
    met = at.groupBy("key").agg(*[F.coalesce(F.bit_or(F.when(F.floor(F.col("i") / width) == w, bit)), F.lit(0).cast("long")).alias(f"w{w}") for w in words])

    def holds(alternative) -> Column:
        """The intersection of the postings of its terms."""
        need = [sum(1 << (i % width) for i, x in enumerate(terms) if x in alternative and i // width == w) for w in words]
        return reduce(lambda a, b: a & b, [F.col(f"w{w}").bitwiseAND(F.lit(n)) == n for w, n in enumerate(need) if n])

    mask = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        q = trigram_query(r.pattern)
        if q != ALWAYS:
            mask = mask + F.when(reduce(lambda a, b: a | b, map(holds, sorted(q, key=sorted))), 1 << i).otherwise(0)
    return met.select("key", mask.alias("rules")).where("rules <> 0")


# --- verification ---


def _matches(rule: Rule, rank: int) -> Column:
    """Spans of a rule in the text t. Gaps and matches are summed up along the text."""
    pattern, t = F.lit(rule.pattern), F.col("t")
    parts = F.struct(F.split(t, rule.pattern, -1).alias("gap"), F.regexp_extract_all(t, pattern, F.lit(0)).alias("m"), F.regexp_extract_all(t, pattern, F.lit(rule.group)).alias("v"))

    def spans(x: Column) -> Column:
        z = prefix_sums(F.zip_with(F.slice(x["gap"], F.lit(1), F.size(x["m"])), x["m"], lambda g, m: F.length(g) + F.length(m)))
        each = F.filter(F.arrays_zip(z.alias("z"), x["m"].alias("m"), x["v"].alias("v")), lambda y: F.length(y["v"]) >= rule.least)
        return F.transform(each, lambda y: F.struct((y["z"] - F.length(y["m"])).alias("start"), F.lit(rank).alias("rank"), y["z"].alias("end"), F.lit(rule.kind).alias("kind")))

    return let(parts, spans)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id and `found`, an array of (start, rank, end, kind) in that order, for every row."""
    spark = docs.sparkSession
    d = _texts(docs)
    indexed = any(trigram_query(r.pattern) != ALWAYS for r in rules)
    if indexed:
        index, at = stored(postings(docs, terms_of(rules)), "secret-index")
        hits, _ = stored(candidates(index, rules), "secret-candidates")
        discard(spark, at)
        keyed = d.withColumn("key", _key())
        if hits.count() <= max_broadcast:
            d = keyed.join(F.broadcast(hits), "key", "left")
        else:  # both sides are dealt by a salt too, so that a row that comes very often is spread; texts are hashed, not sorted
            salted = hits.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            d = keyed.withColumn("salt", F.monotonically_increasing_id() % SALTS).join(salted.hint("shuffle_hash"), ["key", "salt"], "left")
    else:
        d = d.withColumn("rules", F.lit(0).cast("long"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    spans = []
    for i, r in enumerate(rules):
        full = trigram_query(r.pattern) == ALWAYS
        look = F.col("t").rlike(r.pattern) if full else F.col("rules").bitwiseAND(F.lit(1 << i)) != 0
        spans.append(F.when(look, _matches(r, i)).otherwise(none))
    return d.select("doc_id", F.array_sort(F.concat(*spans)).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per document: matches of the base kinds, the digest of their spans, and all spans as kind:start:end."""
    base = {r.kind for r in BASE}
    d = scan(docs, rules, max_broadcast).withColumn("base", F.filter("found", lambda s: s["kind"].isin(*base)))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return d.select("doc_id", *[n(r.kind) for r in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def _sql() -> str:
    """For DuckDB: every pattern over every text."""
    quoted = lambda p: p.replace("'", "''")
    parts = []
    for i, r in enumerate(RULES):
        p = quoted(r.pattern)
        parts.append(
            f"""SELECT k, {i} AS rank, '{r.kind}' AS kind, z - length(m[i]) AS "start", z AS "end" FROM (SELECT k, m, v, i, (list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))))::BIGINT AS z FROM
(SELECT k, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {r.group}) AS v FROM d WHERE regexp_matches(t, '{p}')), unnest(range(1, len(m) + 1)) AS u(i)) WHERE length(v[i]) >= {r.least}"""
        )
    line = """string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank)"""
    n = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    out = ", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
a AS (SELECT k, {n}, {line} AS spans, {line} FILTER (rank < {len(BASE)}) AS base FROM s GROUP BY k)
SELECT doc_id, {out}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (k)"""


SQL = _sql()
