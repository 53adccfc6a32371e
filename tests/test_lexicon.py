import random

import pytest

from voicetally.operators.lexicon import first_match, pieces

SCHEMA = "i int, text string, _low0 string, _rank0 int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], SCHEMA).repartition(5)


@pytest.mark.parametrize("chars", [4_000_000, 40, 1])
def test_first_match_by_order(spark, chars):
    """Overlaps, prefixes, equal keywords, empty ones; in one automaton, in several, and in one for each keyword."""
    rng = random.Random(2)
    words = [("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 5))), k) for k in range(60)] + [("ab", 3), ("ab", 200), (None, 1), ("zz", None)]
    texts = [None, "", "ABC", "zz", *["".join(rng.choice("abcdÉé ") for _ in range(rng.randint(0, 30))) for _ in range(200)]]
    lex = spark.createDataFrame(words, "w string, ord int").repartition(3)
    got = {r["i"]: r for r in first_match(frame(spark, texts), "text", lex, "w", chars=chars).collect()}
    for i, t in enumerate(texts):
        assert got[i]["match"] == min((k for w, k in words if w and k is not None and t is not None and w in t.lower()), default=None), t
        assert got[i]["_low0"] == "a" and got[i]["_rank0"] == 1 and got[i]["text"] == t


def test_large_lexicon_in_one_pass(spark):
    n = 100_000
    lex = spark.range(n).selectExpr("concat('k', lpad(cast(id * 7919 % 100003 as string), 6, '0')) as w", "id as ord")
    docs = spark.createDataFrame([(i, " ".join(f"k{(i * 31 + j) * 7919 % 100003:06d}" for j in range(20)), "a", 1) for i in range(200)], SCHEMA)
    found = first_match(docs, "text", lex, "w")
    assert {r["i"]: r["match"] for r in found.collect()} == {i: i * 31 for i in range(200)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_lexicon_and_table(spark):
    lex = spark.createDataFrame([], "w string, ord int")
    assert first_match(frame(spark, ["a"]), "text", lex, "w").first()["match"] is None
    assert first_match(frame(spark, []), "text", spark.createDataFrame([("a", 1)], "w string, ord int"), "w").count() == 0
    assert list(pieces(lex, "w", "ord")) == []
