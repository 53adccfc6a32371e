import hashlib
import math
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from voicetally.llm import vector_codes as V  # noqa: E402
from voicetally.llm.vector_codes import assign, down, grouped, own_squares, quantize, squares  # noqa: E402

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, x int"


def vectors(n=400, dim=32, scale=1.0, seed=3):
    """Clustered vectors with ties (coarse values), repeated rows, nulls, bad components, short and empty vectors, null ids."""
    rng = random.Random(seed)
    heads = [[rng.gauss(0, scale) for _ in range(dim)] for _ in range(12)]
    rows = [(i, [round(x + rng.gauss(0, 0.2 * scale), 2 if i % 3 else 0) for x in heads[i % 12 if i % 2 else 0]], i % 5 if i % 11 else None) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [None] + [0.0] * (dim - 1), 1), (n + 2, [float("nan")] * dim, 2), (n + 3, [float("inf")] * dim, 2), (n + 4, [0.5] * (dim - 3), 3), (n + 5, [], 3), (None, rows[0][1], None), (None, [1.0] * dim, 4)]
    rows += [rows[5], rows[5], (7, rows[8][1], 1), (-3, [-0.0001] * dim, None)]
    rng.shuffle(rows)
    return [(*r, "clash", "clash", 1) for r in rows]


def expected(rows):
    """Plain Lloyd rounds with whole numbers of any size."""
    as32 = lambda x: float(np.float32(x))
    kept = [(i, [math.floor(4096 * as32(x)) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dim = -(-max(len(v) for _, v, _ in kept) // 8) * 8
    w, kept = dim // 8, [(i, v + [0] * (dim - len(v)), label, np.array(v, "<i4").tobytes()) for i, v, label in kept]
    first = {}
    for i, v, _, raw in kept:
        if i is not None and (i not in first or raw < first[i][0]):
            first[i] = raw, v
    seeds = [first[i][1] for i in sorted(first)[:16]]
    books = [[v[j * w : j * w + w] for v in seeds] for j in range(8)]
    part = lambda v, j: v[j * w : j * w + w]
    near = lambda v, j: min((sum((a - b) ** 2 for a, b in zip(part(v, j), c)), e) for e, c in enumerate(books[j]))
    for _ in range(6):
        members = defaultdict(list)
        for _, v, _, _ in kept:
            for j in range(8):
                members[j, near(v, j)[1]].append(part(v, j))
        for (j, e), m in members.items():
            books[j][e] = [sum(x) // len(m) for x in zip(*m)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, per = [], Counter()
    for i, v, label, _ in kept:
        d = [near(v, j) for j in range(8)]
        out.append((i, "".join(f"{e:02x}" for _, e in d), sum(x for x, _ in d), label))
        per[label] += out[-1][2]
    return Counter((i, code, error, per[label], digest) for i, code, error, label in out)


@pytest.mark.parametrize("scale,most", [(1.0, 1_000_000), (1.0, 2), (20_000.0, 1_000_000)])
def test_codes_equal_plain_rounds(spark, scale, most):
    """Small values (products in doubles) and large ones (64-bit integers); labels by broadcast and by salted join."""
    rows = vectors(scale=scale)
    got = quantize(spark.createDataFrame(rows, SCHEMA).repartition(6), max_broadcast=most)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == expected(rows)


def test_partitions_do_not_matter_and_bounds_save_work(spark):
    rows = vectors(1500)
    df = spark.createDataFrame(rows, SCHEMA)
    work = []
    a, books = V.encode(df.repartition(1), work=work)
    b, again = V.encode(df.repartition(13, F.col("label")))
    assert (books == again).all() and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert work[0][0] == work[0][1] and all(scanned < plain / 2 for plain, scanned in work[2:])


def test_few_rows_and_none(spark):
    assert quantize(spark.createDataFrame([], SCHEMA)).count() == 0
    assert quantize(spark.createDataFrame([(1, None, 1, "", "", 0)], SCHEMA)).count() == 0
    one = quantize(spark.createDataFrame([(None, [1.5] * 8, None, "", "", 0), (None, [2.5] * 8, 3, "", "", 0)], SCHEMA)).collect()
    assert sorted((r[0], r[1], r[2]) for r in one) == [(None, "00" * 8, 0), (None, "01" * 8, 0)]
    none = quantize(spark.createDataFrame([(4, [], 3, "", "", 0)], SCHEMA)).first()
    assert none[:4] == (4, "00" * 8, 0, 0)


def test_bounded_assignment_equals_full_scans():
    """Rounds of random moves, with ties and equal entries: codes, exact distances and bounds that hold."""
    rng = np.random.default_rng(5)
    for width, most in ((4, 6), (1, 3), (8, 40), (0, 1)):
        a, c = rng.integers(-most, most, (300, width)).astype(float), rng.integers(-most, most, (16, width)).astype(float)
        of = grouped(c.astype(int), 4)
        code = low = None
        for _ in range(6):
            code, d, low, _ = assign(a, c, of, 4, code, low)
            every = squares(a, c)
            assert (code == every.argmin(1)).all() and (d == every.min(1)).all() and (own_squares(a, c, code) == d).all()
            low = down(low).astype(float)
            for g in range(4):
                others = np.where((of == g) & (np.arange(16) != code[:, None]), np.sqrt(every), np.inf).min(1)
                assert (low[:, g] <= others).all()
            new = c + rng.integers(-1, 2, c.shape)
            low = low - [np.sqrt(((new - c) ** 2).sum(1))[of == g].max(initial=0) * (1 + 1e-9) for g in range(4)]
            c = new
