import hashlib
import random
import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_data import SCHEMA, documents, frame  # noqa: E402

from voicetally.llm import secret_scan as S  # noqa: E402

HEX = "0123456789abcdef" * 3
ODD = [
    "password = hunter2", "PassWord: 'hunter2hunter2'", 'API_KEY="abcdefgh"', "apikey=abcdefg", "apiKEY :abc/def+ghi=", "token: secret: abcdefgh", "token==abcdefgh", "secret  =  \"x.y-z_12345\" token=short",
    "😀é password=äbcdefgh token=abcdefgh😀", "AKIAABCDEFGHIJKL AKIAshort AKIAAKIAAKIA", "AKIA" * 20, HEX, HEX[:31], "g" + HEX[:32] + "G" + HEX, "ghp_" + "a1B2" * 9 + " ghx_" + "a1B2" * 9, "xoxb-123456789-abc xoxz-123456789-abc",
    "AIza" + "Sy_-5" * 7, "sk_live_" + "a" * 16 + " sk_test_" + "a" * 16, "eyJhbGciOi.eyJzdWIiOi.SflKxwRJSMeKKF2QT4", "-----BEGIN RSA PRIVATE KEY-----\nabc", "-----BEGIN PUBLIC KEY-----", "Authorization: Bearer " + "abcDEF.12" * 3,
    "see https://user:pa55word@host/x and https://host:80/x@y", "Kelvin: toKen=abcdefgh ſecret=abcdefgh", "password=" * 5000 + "abcdefgh ", "tok en = abcdefgh", "secret\x0b=abcdefgh", "pass" * 20_000 + "word:abcdefghi", " " * 50_000 + "token" + " " * 50_000 + "=abcdefgh",
]
ROWS = [*documents(), *[(1000 + i, t, "en", "s", 0, "", 0, 0, 0) for i, t in enumerate(ODD)], *[(i, ODD[3 * k], "en", "s", 0, "", 0, 0, 0) for k, i in enumerate([None, None, 1000, 5])], (None, ODD[0], "en", "s", 0, "", 0, 0, 0)]


def found(text, rules=S.RULES):
    out = []
    for rank, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), rank, m.end(), r.kind))
    return sorted(out)


def row(i, text):
    line = lambda f: ",".join(f"{k}:{a}:{z}" for a, _, z, k in f)
    f = found(text)
    base = [x for x in f if x[1] < 3]
    return (i, *[sum(x[3] == k for x in f) for k in ("assign", "access", "hex")], hashlib.sha256(line(base).encode()).hexdigest(), line(f))


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_secrets_equal_plain_matching(spark, most):
    """Candidates by broadcast and by the salted join; ids that are null, repeated, or of several texts."""
    got = S.secrets(frame(spark, ROWS).repartition(7), max_broadcast=most)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((row(r[0], r[1]) for r in ROWS), key=repr)
    assert not [x for x in ("Python", "Pandas", "Arrow") if x in got._jdf.queryExecution().executedPlan().toString()]
    assert S.secrets(spark.createDataFrame([], SCHEMA), max_broadcast=most).count() == 0


def test_index_is_used_and_hides_nothing(spark):
    docs = frame(spark, ROWS)
    terms = S.terms_of(S.RULES)
    index = S.postings(docs, terms)
    texts = {(r[0], r[1]): (r[1] or "").lower() for r in ROWS}.values()
    assert sorted(r[0] for r in index.distinct().select("term").collect()) == sorted(x for t in texts for x in terms if x in t)
    n = S.candidates(index, S.RULES).count()
    assert 0 < n < len({(r[0], r[1]) for r in ROWS})
    clean = S.scan(frame(spark, documents()[:20]), rules=(S.BASE[0], S.BASE[1]))
    assert clean.where("size(found) > 0").count() == 0
    only_hex = S.scan(docs, rules=(S.BASE[2],)).where("size(found) > 0").count()
    assert only_hex == sum(bool(found(r[1], (S.BASE[2],))) for r in ROWS)


PATTERNS = ["abc", "abcd?e", "(foo|ba[rz]+x)q{2}", "[Aa][Bb]c*def", "a.bcd", "(ab|cd){2}e", "x(?=abc)yzz", "[^a]bcdef", "(?:one|two|th[re]{2}e)\\b-[0-9]", "éabc|ABCé", "a{3,}", "a{0,2}bcd", "(a|)(b|)c", "[a-f]{4}", "colou?r(ful)?"]


@pytest.mark.parametrize("pattern", PATTERNS + [r.pattern for r in S.RULES])
def test_queries_hold_for_every_match(pattern):
    rng = random.Random(pattern)
    q = S.trigram_query(pattern)
    seen = 0
    alphabet = sorted(set(re.sub(r"[\\\[\](){}|?*+^]", "", pattern))) + ["a", "b", "c", "f", "q", "-", "1"]
    for _ in range(3000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 12)))
        t = rng.choice([t, t + "ABCdef", "barzxqq" + t, "one-1" + t, "xyzz abc" + t, "AKIA" + t, "token=" + t, "eyJa.b.c" + t, "colourful", "éabc", "ababe cdabe"])
        if re.search(pattern, t):
            seen += 1
            assert any(all(x in t.lower() for x in a) for a in q), (t, q)
    assert q == S.absorbed(q)


def test_queries_of_patterns():
    q = lambda p: sorted(map(sorted, S.trigram_query(p)))
    assert q("abcd") == [["abc", "bcd"]] and q("ab") == [[]] and q("(abc|xyz)+") == [["abc"], ["xyz"]] and q("(abc|x)") == [[]]
    assert q("api_?key") == [["_ke", "api", "i_k", "key", "pi_"], ["api", "ike", "key", "pik"]]
    assert q("[0-9a-f]{32,}") == [[]] and q("AbC[0-9]*dEf") == [["abc", "def"]]
