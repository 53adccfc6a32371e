"""Interaction audit of document filters by the multilinear extension of what they remove.

Each document is graded once into a mask of the filters it fails. For a part with c(T) documents whose masks hold all of T,
the documents that a set of filters removes have the multilinear extension

    f(x) = sum over T, not empty, of (-1)**(|T| + 1) * c(T) * product of x_i over i in T

so the removal polynomial of a part is an array of 2**n coefficients, summed up from mask counts. A corner f(1_S) is what the
set S removes, in any order, which gives survivors, steps and unique failures. The Shapley value of filter i is the integral of
df/dx_i along the diagonal x = (t, ..., t): each T with i in it adds its coefficient times 1/|T|, an exact rational, and n!
times that is whole.

Null texts are empty, null sources belong to the part '', and a document without a label is neither good nor toxic (of several
label rows of one id, any counts). Filter E compares ids: a row without an id fails it never and causes no failure, and rows of
one id with one text do not fail each other. Repeated rows count each. An empty table has no parts. Only named columns are read.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import discard, stored

LETTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
SALTS = 16
COUNTS = ("n", "n_good", "n_toxic")


def graded(docs: DataFrame) -> DataFrame:
    """part, doc_id, a digest of the text, the mask of the filters A to D, and how many rows are alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    d = d.select("*", F.btrim("t", F.lit(" \t\n\v\f\r")).alias("b"))
    d = d.select("*", F.when(F.col("b") != "", F.split("b", SPACE)).otherwise(F.array().cast("array<string>")).alias("words"))
    n, capitals = F.size("words"), F.length(F.regexp_replace("t", "[^A-Z]+", ""))
    failed = (n < 50, 100 * F.size(F.array_distinct("words")) < 65 * n, 100 * capitals > 5 * F.length("t"), F.col("t").rlike("[#$%&*|]"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)), F.lit(0))
    g = d.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("same"), mask.alias("mask"))
    return g.groupBy("doc_id", "part", "same", "mask").agg(F.count("*").alias("n"))


def with_copies(g: DataFrame) -> DataFrame:
    """Filter E joins the mask: a smaller id has the same text. Only texts under several ids are looked up, and both sides are
    dealt by a salt too, so that a text with very many copies is spread."""
    firsts = g.groupBy("same").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    firsts = firsts.select("same", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    salted = g.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    mask = F.col("mask") + F.when(copy, 1 << LETTERS.index("E")).otherwise(0)
    return salted.join(firsts, ["same", "salt"], "left").select("doc_id", "part", "same", mask.alias("mask"), "n")


def mask_counts(g: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part and mask: documents, good ones and toxic ones. Rows without an id are dealt by text, since no label is theirs."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic")).withColumn("spread", F.lit(0).cast("long"))
    d = g.withColumn("spread", F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("same"), F.lit(8191))).otherwise(F.lit(0)).cast("long"))
    n = F.col("n")
    c = d.join(known, ["doc_id", "spread"], "left").groupBy("part", "mask")
    return c.agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(x) == 1, n).otherwise(0)).alias(f"n_{x}") for x in ("good", "toxic")])


def removal_polynomial(count: str, filters: int) -> Column:
    """An aggregate: the coefficients by subset T as a bit mask; the empty set's is 0."""
    def coefficient(t: int) -> Column:
        holds = F.col("mask").bitwiseAND(F.lit(t)) == t
        return F.sum(F.when(holds, F.col(count)).otherwise(0)) * (1 if t.bit_count() % 2 else -1)

    return F.array(F.lit(0).cast("long"), *[coefficient(t) for t in range(1, 1 << filters)])


def corners(poly: Column, filters: int) -> Column:
    """The polynomial at every corner 1_S: its coefficients summed over the subsets of S."""
    zero = F.lit(0).cast("long")

    def at(s: Column) -> Column:
        return F.aggregate(F.transform(poly, lambda v, t: F.when(t.bitwiseAND(s) == t, v).otherwise(zero)), zero, lambda a, x: a + x)

    return F.transform(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), at)


def diagonal_weights(i: int, filters: int) -> list[int]:
    """By subset T: n! times the integral over t from 0 to 1 of d(t**|T|)/dx_i at the diagonal, which is t**(|T| - 1) if i is in T."""
    out = []
    for t in range(1 << filters):
        whole = math.factorial(filters) * (Fraction(1, t.bit_count()) if t >> i & 1 else Fraction(0))
        assert whole.denominator == 1
        out.append(whole.numerator)
    return out


def shapley_values(poly: Column, filters: int) -> Column:
    """Per filter, n! times its Shapley value: removals summed over all orders."""
    zero = F.lit(0).cast("long")

    def value(i: int) -> Column:
        return F.aggregate(F.zip_with(poly, F.lit(diagonal_weights(i, filters)), lambda c, w: c * w), zero, lambda a, x: a + x)

    return F.array(*[value(i) for i in range(filters)])


def steps(letters: str = LETTERS) -> tuple[list[str], list[int], list[int], list[int]]:
    """All orders with their steps: order, step, the step's filter by number, and the mask of the filters before it."""
    orders, at, own, before = [], [], [], []
    for p in permutations(range(len(letters))):
        for k, i in enumerate(p):
            orders.append("".join(letters[j] for j in p))
            at.append(k + 1)
            own.append(i)
            before.append(sum(1 << j for j in p[:k]))
    return orders, at, own, before


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """The audit of a table of mask counts (part, mask, n, n_good, n_toxic): a row per part, order of the filters and step."""
    k = len(letters)
    polys = counts.groupBy("part").agg(F.sum("n").alias("total"), *[removal_polynomial(c, k).alias(f"p_{c}") for c in COUNTS])
    d = polys.select("part", "total", *[corners(F.col(f"p_{c}"), k).alias(c) for c in COUNTS], shapley_values(F.col("p_n"), k).alias("values"))
    orders, at, own, before = map(F.lit, steps(letters))
    d = d.select("*", F.explode(F.arrays_zip(orders.alias("filter_order"), at.alias("step"), own.alias("own"), F.transform(own, lambda i: F.pow(F.lit(2.0), i).cast("int")).alias("bit"), before.alias("before"))).alias("x"))
    bit, before = F.col("x.bit"), F.col("x.before")
    after, whole = before.bitwiseOR(bit), (1 << k) - 1
    lost = lambda c: F.get(c, after) - F.get(c, before)
    return d.select(
        "part",
        "x.filter_order",
        F.col("x.step").cast("int").alias("step"),
        (F.col("total") - F.get("n", after)).alias("kept"),
        lost("n").alias("removed"),
        (F.get("n", bit) - lost("n")).alias("redundant"),
        (F.get("n", F.lit(whole)) - F.get("n", F.lit(whole).bitwiseXOR(bit))).alias("unique_fails"),
        lost("n_good").alias("good_lost"),
        lost("n_toxic").alias("toxic_lost"),
        F.get("values", F.col("x.own")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters. Texts are read once; what goes on are a mask and a digest per document, and then the counts
    of at most 32 masks per part."""
    g, at = stored(graded(docs), "filter-masks")
    counts, _ = stored(mask_counts(with_copies(g), labels), "filter-counts")
    discard(docs.sparkSession, at)
    return interactions(counts)


#: The audit for DuckDB: every order is played through, without polynomials.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, doc_id > min(doc_id) OVER (PARTITION BY t) AS again FROM t),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws),
             100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(again, false)] AS f
      FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM m GROUP BY 1, 2),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda j: chr(64 + j)), '') AS filter_order, i AS step, o[i] AS own, o[1:i - 1] AS before FROM o, x),
e AS (SELECT part, filter_order, step, own, n, n_good, n_toxic, f[own] AS fails, len(list_filter(before, lambda j: f[j])) > 0 AS gone, len(list_filter(f, lambda y: y)) AS fs FROM c, s),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (fails AND gone), 0) AS redundant,
             coalesce(sum(n) FILTER (fails AND fs = 1), 0) AS unique_fails, coalesce(sum(n_good) FILTER (fails AND NOT gone), 0) AS good_lost, coalesce(sum(n_toxic) FILTER (fails AND NOT gone), 0) AS toxic_lost
      FROM e GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
