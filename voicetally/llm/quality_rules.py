"""Quality rules as a bitmask ledger, in DataFrame operations only.

Each rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; policies are
versioned masks over those bits, so a new policy or an ablation reads the ledger and never the text.

Null and wordless texts have no words and fail `few_words`; repeated rows stand for themselves; very long texts are whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: Rules in bit order: name -> failed condition over the measurements, in SQL.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 40 * n_words",
    "repeated_lines": "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}
#: Policies by version: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("few_words", "repeated_windows"),
    "v2": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length"),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def _joined(h: Column, n: Column, by: int) -> Column:
    """Hashes of twice the span: each item with the one `by` places on; n items in h."""
    m = F.greatest(n - by, F.lit(0))
    return F.zip_with(F.slice(h, 1, m), F.slice(h, 1 + by, m), lambda a, b: F.xxhash64(a, b))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of its whole text."""
    trimmed = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).select("doc_id", "t", F.btrim("t", F.lit(" \t\n\v\f\r")).alias("b"))
    d = trimmed.select("doc_id", "t", F.when(F.col("b") != "", F.split("b", SPACE)).otherwise(F.array().cast("array<string>")).alias("words"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\v\f\r")) != "")
    d = d.select(
        "doc_id",
        F.size("words").alias("n"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    n = F.col("n")
    d = d.select("*", F.when(n > WINDOW, _joined(F.col("h1"), n, 1)).alias("h2"))
    d = d.select("*", F.when(n > WINDOW, _joined(F.col("h2"), n - 1, 2)).alias("h4"))
    d = d.select("*", F.when(n > WINDOW, _joined(F.col("h4"), n - 3, 4)).alias("h8")).drop("h1", "h2", "h4")
    # only texts in which a window comes twice go on to find out where
    twice = F.col("h8").isNotNull() & (F.size(F.array_distinct("h8")) < F.size("h8"))
    d = d.select("*", F.when(twice, F.array_sort(F.transform("h8", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s")).drop("h8")

    def repeated(x, i):
        return F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False))

    d = d.select("*", F.array_sort(F.transform(F.filter("s", repeated), lambda x: x["i"])).alias("p")).drop("s")
    steps = F.zip_with("p", F.slice("p", F.lit(2), F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    in_repeats = F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return d.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("p").isNull(), F.lit(0).cast("long")).otherwise(in_repeats).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def ledger(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """The measurements and `failed`: one bit per rule, in the rules' order."""
    m = measure(docs)
    bits = F.lit(0)
    for i, rule in enumerate(rules.values()):
        bits = bits + F.when(F.expr(rule), 1 << i).otherwise(0)
    return m.withColumn("failed", bits.cast("int"))


def apply_policy(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(book: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that would be kept without it.

    One aggregation by the ledger's bits (2**rules rows at most, combined before the shuffle) answers for all rules.
    """
    m = mask(policy)
    by_bits = book.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).alias("bit")) for i, r in enumerate(RULES) if r in POLICIES[policy]])
    each = by_bits.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.expr("bits & bit") != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.expr("bits & bit") != 0, F.when(F.bit_count("bits") == 1, F.col("n"))).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.expr("bits & ~bit") == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
        F.sum(F.when(F.col("bits") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
    )


#: The ledger under the current policy, for DuckDB.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM t),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(ws) - 6)) AS u(i)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n FROM
        (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM dup) GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(w.t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines
      FROM w JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       few_words OR repeated_windows AS base_failed, NOT (few_words OR repeated_windows OR symbols OR repeated_lines OR word_length) AS kept,
       few_words::INT + 2 * repeated_windows::INT + 4 * symbols::INT + 8 * repeated_lines::INT + 16 * word_length::INT AS failed
FROM (SELECT *, n_words < 20 AS few_words, 100 * n_repeat_words > 30 * n_words AS repeated_windows, 100 * n_symbols > 40 * n_words AS symbols,
             n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines AS repeated_lines, word_chars < 2 * n_words OR word_chars > 15 * n_words AS word_length FROM m)
"""
