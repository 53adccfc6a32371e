"""Credited sources: cases of word order, their offsets and sentences, and growth with the text."""

import time

import pytest
from pyspark.sql import functions as F

from voicetally.operators import clauses as C
from voicetally.operators.attribution import extract_attributions

#: text -> (source, verb, type) in order.
CASES = {
    "Joe Biden said the economy is strong.": [("Joe Biden", "say", "PERSON")],
    '"We will win," said Hillary Clinton.': [("Hillary Clinton", "say", "PERSON")],
    "According to Barack Obama, the plan worked.": [("Barack Obama", "according to", "PERSON")],
    "The White House said it would respond.": [("The White House", "say", "ORG")],
    "The weather is nice today.": [],
    "Joe Biden said the economy is strong. According to Barack Obama, it worked.": [("Joe Biden", "say", "PERSON"), ("Barack Obama", "according to", "PERSON")],
    # inverted
    "“No,” later added White House spokesman Jay Carney.": [("Jay Carney", "add", "PERSON")],
    "It was John Smith, said Sen. Ann Roe.": [("Ann Roe", "say", "PERSON")],
    '"Never." "Why?" asked Élise Dupont, and left.': [("Élise Dupont", "ask", "PERSON")],
    # passive: the subject, not the agent
    "Mary Smith of Maine was accused by George Bush.": [("Mary Smith", "accuse", "PERSON")],
    "It was reported by John Smith.": [],
    "Jane Doe, a member of the House, had never been told.": [("Jane Doe", "tell", "PERSON")],
    # several subjects: the head
    "Joe Biden and Barack Obama say so.": [("Joe Biden", "say", "PERSON")],
    "Joe Biden, Barack Obama and John Smith said no.": [("Joe Biden", "say", "PERSON")],
    # between subject and verb
    "Joe Biden, who was there, has since denied it.": [("Joe Biden", "deny", "PERSON")],
    "The Department of State, which knew it, has not responded.": [("The Department of State", "respond", "ORG")],
    "The U.N. has warned that Iran will say no.": [("The U.N.", "warn", "ORG"), ("Iran", "say", "PERSON")],
    "Prof. J. R. Smith of the Bank of America repeatedly wrote it.": [("J. R. Smith", "write", "PERSON")],
    # no subjects
    "Biden's spokesman said no.": [],
    "The spokesman for John Smith said no.": [],
    "He said to Joe Biden that all was well.": [],
    "The president said so. Experts say no, but officials claim it.": [],
    "": [],
    "NATO: said. JOHN DOE, GUEST: Hello.": [],
    "In Washington, Sen. John McCain later warned of it. Yesterday President Obama also replied.": [("John McCain", "warn", "PERSON"), ("Obama", "reply", "PERSON")],
}


def test_cases(spark):
    texts = [*CASES, None]
    rows = extract_attributions(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i", "char_start").collect()
    got = {t: [] for t in texts}
    for r in rows:
        t = texts[r["i"]]
        assert t[r["char_start"] : r["char_end"]] == r["source_span"] and r["source_span"] in r["sentence_text"] and r["sentence_text"] in t
        assert r["pattern_id"] == ("according_to" if r["cue_verb"] == "according to" else "subj_cue")
        got[t].append((r["source_span"], r["cue_verb"], r["entity_type"]))
    assert got.pop(None) == [] and got == CASES
    last = [r for r in rows if texts[r["i"]].startswith("In Washington")]
    assert [(r["sentence_index"], r["sentence_text"]) for r in last] == [(0, "In Washington, Sen. John McCain later warned of it."), (1, "Yesterday President Obama also replied.")]


def test_names_on_air_are_dropped(spark):
    df = spark.createDataFrame([("Joe  Biden said hello. Ann Roe said no.", ["JOE biden"]), ("Joe Biden said hello.", None)], "text string, air array<string>")
    assert sorted(r["source_span"] for r in extract_attributions(df, exclude="air").collect()) == ["Ann Roe", "Joe Biden"]


@pytest.mark.parametrize("lemma", ["say", "argue", "deny", "admit", "post", "write", "testify", "accuse"])
def test_forms(lemma):
    third, past, participle, ing = C.forms(lemma)
    assert {C.LEMMA[x] for x in (lemma, third, past, participle, ing)} == {lemma}
    assert not set(C.FINITE) & set(C.BASE)


def test_types_have_one_letter_each():
    assert all(len(k) == 1 for k, *_ in C.TYPES) and {k for k, *_ in C.TYPES} <= set("NMXKHVvgADTGOFIYCQ&WPLSZ")


def test_time_grows_with_the_text(spark):
    def seconds(n):
        text = " ".join(list(CASES)[k % len(CASES)] for k in range(n))
        df = spark.createDataFrame([(text,)], "text string")
        began = time.time()
        count = extract_attributions(df).agg(F.count("*"), F.sum("char_end"), F.max(F.length("sentence_text"))).first()[0]
        return count, time.time() - began

    seconds(50)
    (n1, t1), (n2, t2) = seconds(2500), seconds(10_000)
    assert n2 > 3.9 * n1 > 0 and t2 < 8 * t1 + 2
