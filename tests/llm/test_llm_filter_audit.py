import re
import sys
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_data import SCHEMA, documents, frame  # noqa: E402

from voicetally.llm import filter_audit as A  # noqa: E402

ODD = [(None, documents()[3][1]), (None, documents()[3][1]), (3, documents()[3][1]), (2, "A B C $"), (500, "A B C $"), (500, "A B C $"), (501, "CAPITALS ONLY " * 30), (502, "word " * 60), (503, "a b " * 50)]
ROWS = [*documents(), *[(i, t, "en", s, 0, "", 0, 0, 0) for (i, t), s in zip(ODD, ["src1", None, "", "src2", "src2", "src2", None, "src0", "src0"])]]
LABELS = [(i, q, t) for i, (q, t) in enumerate([(0, 1), (1, 0), (1, 1), (None, 1), (1, None)] * 12)] + [(500, 1, 0), (500, 0, 1), (None, 1, 1), (9999, 1, 1)]


def failed(rows):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(r[0], first.get(r[1] or "", r[0]))
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), r[0] is not None and first[t] < r[0])
        yield r, {x for x, f in zip("ABCDE", own) if f}


def expected(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for r, f in failed(rows):
        parts[r[3] or ""].append((f, r[0] in good, r[0] in toxic))
    out = {}
    for part, docs in parts.items():
        total = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for k, x in enumerate(order, 1):
                here = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                total[x] += len(here)
                out[part, "".join(order), k] = [len(left), len(here), sum(x in d[0] for d in docs) - len(here), sum(d[0] == {x} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here), x]
        for (p, _, _), v in out.items():
            if p == part:
                v[6] = total[v[6]] if isinstance(v[6], str) else v[6]
    return out


def test_audit_equals_playing_every_order(spark):
    docs, labels = frame(spark, ROWS).repartition(7), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = A.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = got.collect()
    assert len(rows) == 600 * 5
    assert {(r[0], r[1], r[2]): list(r[3:]) for r in rows} == expected(ROWS, LABELS)


def test_audit_of_nothing(spark):
    empty, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(empty, labels).count() == 0
    one = A.audit(spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string"), labels).where("step = 1 and filter_order = 'ABCDE'").first()
    assert tuple(one) == ("", "ABCDE", 1, 0, 1, 0, 1, 0, 0, 120)


@pytest.mark.parametrize("n", [1, 3, 5])
def test_weights_integrate_to_the_shapley_value(n):
    """Against the definition: the mean over all orders of what a filter adds, for the game 'T is in the set'."""
    for t in range(1, 1 << n):
        for i in range(n):
            adds = [all(j in p[: p.index(i) + 1] for j in range(n) if t >> j & 1) and bool(t >> i & 1) for p in permutations(range(n))]
            assert A.diagonal_weights(i, n)[t] == sum(adds) and Fraction(sum(adds), len(adds)) == (Fraction(1, t.bit_count()) if t >> i & 1 else 0)
