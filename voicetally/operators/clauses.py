"""A finite-state clause chunker: a text becomes typed tokens, one letter each, and the grammar is a pattern over those letters.

Each stage is a Catalyst expression over one row: tokens by a pattern, types by word lists, and matches over the string of types,
where a place is a token's number. Word lists, token pattern and grammar are plain data, so the same chunker can be written in
another engine. Time is linear in the text.

Types: N name word, M name word of organizations, X possessive (as in "Biden's"), K title before a name, H title in lower case
(as in "spokesman"), V verb of saying that is finite, v its base or participle, g its -ing form, A auxiliary, D adverb, T "the",
G "according", O "to", F "of", I another preposition, Y "by", C comma, Q quotation mark, & "and" or "or", W relative word,
P pronoun, L another word, S end of a sentence, Z other punctuation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.arrays import let, prefix_sums
from .turns import located

#: Forms that are not made by rule: third person, past, participle, -ing.
IRREGULAR = {
    "say": ("says", "said", "said", "saying"), "tell": ("tells", "told", "told", "telling"), "write": ("writes", "wrote", "written", "writing"),
    "deny": ("denies", "denied", "denied", "denying"), "reply": ("replies", "replied", "replied", "replying"), "testify": ("testifies", "testified", "testified", "testifying"),
    "admit": ("admits", "admitted", "admitted", "admitting"),
}
#: Words in a name that make it an organization.
ORG_WORDS = ("house", "senate", "congress", "department", "pentagon", "university", "institute", "court", "agency", "committee", "council", "party", "company", "corporation", "bank", "times", "post", "news", "police", "ministry", "bureau", "fbi", "cia", "un", "nato", "eu")
#: Titles that may also begin the name of an organization are name words.
_BOTH = ("attorney", "general", "justice", "father", "prince", "princess", "king", "queen", "director", "chief")
ABBREVIATED = ("Mr", "Mrs", "Ms", "Dr", "Sen", "Rep", "Gov", "Gen", "Lt", "Col", "Sgt", "Capt", "Prof", "Rev", "Hon", "Jr", "Sr", "St")


def forms(lemma: str) -> tuple[str, str, str, str]:
    """Third person, past, participle and -ing form."""
    if lemma in IRREGULAR:
        return IRREGULAR[lemma]
    past = lemma + ("d" if lemma.endswith("e") else "ed")
    third = lemma + ("es" if lemma.endswith(("s", "sh", "ch")) else "s")
    return third, past, past, lemma.removesuffix("e") + "ing"


FINITE = {f: lemma for lemma in L.CUE_VERBS for f in forms(lemma)[:2]}
BASE = {f: lemma for lemma in L.CUE_VERBS for f in (lemma, forms(lemma)[2]) if f not in FINITE}
ING = {forms(lemma)[3]: lemma for lemma in L.CUE_VERBS}
LEMMA = FINITE | BASE | ING

_WORD = r"[^\x00-\x26\x28-\x2C\x2E\x2F\x3A-\x40\x5B-\x60\x7B-\x7F“”„«»…—–]"
#: Abbreviated titles, initials, numbers with points, words, ends of sentences, and any other mark.
TOKEN = rf"(?:{'|'.join(sorted(ABBREVIATED, reverse=True))})\.|(?:[A-Z]\.)+|[0-9]+(?:[.,][0-9]+)+|{_WORD}+|[.!?…]+|[^\x00-\x20]"

_SPOKEN = ("spokesman", "spokeswoman", "spokesperson", "lawmaker", "analyst", "reporter", "lawyer", "candidate", "adviser", "leader", "minister", "official")
#: Types in the order in which they are tried: letter, kind of test, values. lower: the lower-cased token is one of them; word: the
#: token is; like: a pattern finds something in it.
TYPES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("C", "word", (",",)),
    ("Q", "word", ('"', "“", "”", "„", "«", "»")),
    ("S", "like", (r"^[.!?…]+$",)),
    ("Z", "like", (rf"^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E—–]$",)),
    ("T", "lower", ("the",)),
    ("&", "lower", ("and", "or")),
    ("F", "lower", ("of",)),
    ("O", "lower", ("to",)),
    ("Y", "lower", ("by",)),
    ("G", "lower", ("according",)),
    ("I", "lower", ("for", "in", "on", "at", "with", "from", "about", "against", "under", "over", "after", "before", "between", "through", "into", "during", "near", "without", "among")),
    ("W", "lower", ("who", "which", "that", "whose", "whom")),
    ("P", "lower", ("i", "you", "he", "she", "it", "we", "they", "him", "her", "them", "us", "me", "this", "these", "those", "there", "what", "nobody", "someone")),
    ("A", "lower", ("is", "are", "am", "was", "were", "be", "been", "being", "has", "have", "had", "having", "do", "does", "did", "will", "would", "can", "could", "may", "might", "shall", "should", "must", "isn't", "wasn't", "hasn't", "hadn't", "didn't", "doesn't", "don't", "won't", "wouldn't", "couldn't", "can't")),
    ("D", "lower", ("also", "then", "later", "once", "never", "not", "again", "earlier", "today", "yesterday", "just", "already", "now", "soon", "since", "often", "even", "still", "ever", "always")),
    ("L", "lower", ("a", "an", "but", "so", "as", "if", "when", "while", "yet", "nor", "because", "no", "yes", "well", "my", "your", "his", "its", "our", "their", "how", "why", "where", "some", "many", "most", "all", "one", "two", "experts", "officials", "people", "thank", "thanks", "hello", "good", "let")),
    ("V", "word", tuple(FINITE)),
    ("v", "word", tuple(BASE)),
    ("g", "word", tuple(ING)),
    ("H", "word", tuple(t for t in L.TITLES if len(t) > 4 and t not in ("general", "father", "chief", "justice", "judge")) + _SPOKEN),
    ("K", "word", tuple(f"{t}." for t in ABBREVIATED) + tuple(t.capitalize() for t in L.TITLES if t not in _BOTH)),
    ("M", "lower", ORG_WORDS),
    ("X", "like", (r"['’]s?$",)),
    ("N", "like", (r"^\p{Lu}",)),
    ("D", "like", ("^[a-z]+ly$",)),
)
#: A name, and what may stand before it: titles, or a lower-case title with its own modifiers ("White House spokesman").
NAME = r"T?(?:[NM]{0,4}MFT?[NM]{1,4}|[NM]{1,5})"
LEAD = r"(?:T?[NMXL]{0,4}H)?K*"
#: What may stand between a subject and its verb: phrases with a preposition, further names, an insertion between commas, adverbs.
AFTER = rf"(?:[IF][TLKHNMX]{{1,6}}){{0,2}}(?:C?&{LEAD}{NAME}|C{LEAD}{NAME}){{0,4}}(?:[IF][TLKHNMX]{{1,6}})?(?:C[^SQCZ]{{1,14}}C)?[AD]*"
#: In this order: according to a name; a quotation or comma, a verb and its subject; a name after a preposition, which is no
#: subject; a subject and its verb (finite, or after auxiliaries, or after several subjects).
GRAMMAR = rf"(GO{LEAD})({NAME})|([QC]+[AD]*)(V)({LEAD})({NAME})|[IFOY]{LEAD}{NAME}|({LEAD})({NAME})({AFTER})(V|(?:A[AD]*)[vg])|({LEAD})({NAME})(C?&{LEAD}{NAME}[D]*)(v)"
GROUPS = ("to", "name1", "quote", "cue2", "lead2", "name2", "lead3", "name3", "after3", "verb3", "lead4", "name4", "after4", "verb4")


def type_of(token: Column) -> Column:
    return let(F.lower(token), lambda low: _type(token, low))


def _type(token: Column, low: Column) -> Column:
    def test(kind: str, values: tuple[str, ...]) -> Column:
        if kind == "like":
            return reduce(lambda a, b: a | b, [token.rlike(v) for v in values])
        return (low if kind == "lower" else token).isin(*values)

    out = F.when(test(*TYPES[0][1:]), TYPES[0][0])
    for letter, *rest in TYPES[1:]:
        out = out.when(test(*rest), letter)
    return out.otherwise("L")


def type_sql(token: str) -> str:
    """The same types in SQL."""
    text = lambda v: "'" + v.replace("'", "''") + "'"

    def test(kind: str, values: tuple[str, ...]) -> str:
        if kind == "like":
            return " OR ".join(f"regexp_matches({token}, {text(v)})" for v in values)
        return f"{f'lower({token})' if kind == 'lower' else token} IN ({', '.join(map(text, values))})"

    return "CASE " + " ".join(f"WHEN {test(*rest)} THEN '{letter}'" for letter, *rest in TYPES) + " ELSE 'L' END"


def tokens(text: Column) -> Column:
    """Tokens in order: start a, end z, the gap before, the token m, its type k."""
    return F.transform(located(text, TOKEN), lambda x: F.struct(x["a"], x["z"], x["gap"], x["m"], type_of(x["m"]).alias("k")))


def sentence_numbers(ts: Column) -> Column:
    """For each token its sentence: one begins after an end that white space follows."""
    new = F.transform(ts, lambda x, i: F.when((F.get(ts, i - 1)["k"] == "S") & (x["gap"] != ""), 1).otherwise(0))
    return prefix_sums(new)


def sentences(ts: Column, number: Column, separator: Column) -> Column:
    """The sentences' texts, in order: texts since the token before, put together and split where the number rises."""
    rises = lambda i: F.get(number, i) > F.coalesce(F.get(number, i - 1), F.lit(0))
    piece = F.transform(ts, lambda x, i: F.concat(F.when(rises(i), separator).otherwise(x["gap"]), x["m"]))
    return F.split(F.array_join(piece, ""), separator, F.lit(-1))


def chunks(ts: Column) -> Column:
    """Credited names by token: first and last token of the name, the verb's token, and the pattern's name."""

    def parsed(m: Column) -> Column:
        """A match's groups, found again in the match alone, which is short; nothing in the grammar looks beyond a match."""
        return F.struct(m["a"].alias("a"), m["z"].alias("z"), *[F.regexp_extract(m["m"], GRAMMAR, i).alias(g) for i, g in enumerate(GROUPS, 1)])

    def chunk(m: Column) -> Column:
        size = lambda c: F.length(m[c])
        to, told = m["name1"] != "", m["name2"] != ""
        lead = F.when(to, size("to")).when(told, size("quote") + 1 + size("lead2")).otherwise(size("lead3") + size("lead4"))
        name = F.when(to, size("name1")).when(told, size("name2")).otherwise(size("name3") + size("name4"))
        verb = F.when(to, F.lit(None).cast("int")).when(told, m["a"] + size("quote")).otherwise(m["z"] - 1)
        return F.struct((m["a"] + lead).alias("first"), (m["a"] + lead + name - 1).alias("last"), verb.alias("verb"), F.when(to, "according_to").otherwise("subj_cue").alias("pattern_id"))

    kinds = F.array_join(F.transform(ts, lambda x: x["k"]), "")
    some = F.filter(F.transform(located(kinds, GRAMMAR), parsed), lambda m: F.concat(m["name1"], m["name2"], m["name3"], m["name4"]) != "")
    return F.transform(some, chunk)


def credits(text: Column) -> Column:
    """All credited names of a text: sentence_index, char_start, char_end, source_span, the verb as written, pattern_id and
    sentence_text."""

    def found(ts: Column, number: Column, whole: Column) -> Column:
        def one(c: Column) -> Column:
            first, last = F.get(ts, c["first"]), F.get(ts, c["last"])
            rest = F.transform(F.slice(ts, c["first"] + 2, c["last"] - c["first"]), lambda x: F.concat(x["gap"], x["m"]))
            span = F.concat(first["m"], F.array_join(rest, ""))
            n = F.get(number, c["first"]).cast("int")
            return F.struct(n.alias("sentence_index"), first["a"].alias("char_start"), last["z"].alias("char_end"), span.alias("source_span"), F.get(ts, c["verb"])["m"].alias("verb"), c["pattern_id"].alias("pattern_id"), F.trim(F.get(whole, n)).alias("sentence_text"))

        return F.transform(chunks(ts), one)

    separator = F.concat(F.lit("\u0001"), F.md5(text))
    return let(tokens(text), lambda ts: let(sentence_numbers(ts), lambda n: let(sentences(ts, n, separator), lambda s: found(ts, n, s))))
