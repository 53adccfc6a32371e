import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from llm_data import SCHEMA, documents, frame  # noqa: E402

from voicetally.llm import quality_rules as Q  # noqa: E402


def measured(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by plain rules."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_every_row_counts(spark):
    """Repeated rows, ids of several texts and rows without an id come back each."""
    rows = [*documents(), documents()[3], (3, "another text", "en", "s", 0, "", 0, 0, 0), (None, "a b c d e f g h " * 4, "en", "s", 0, "", 0, 0, 0), (None, None, "en", "s", 0, "", 0, 0, 0)]
    book = Q.apply_policy(Q.ledger(frame(spark, rows).repartition(5)))
    got = Counter(tuple(r) for r in book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    assert got == Counter((r[0], *measured(r[1])) for r in rows)
    for r in book.collect():
        few, repeated = r["n_words"] < 20, 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert (r["failed"] & 1, r["failed"] >> 1 & 1) == (few, repeated) and (not r["kept"] or not (few or repeated))


def test_no_rows(spark):
    none = Q.ledger(spark.createDataFrame([], SCHEMA))
    assert Q.apply_policy(none).count() == 0 and {(r["n_failed"], r["n_kept"]) for r in Q.ablation(none).collect()} <= {(0, 0)}
