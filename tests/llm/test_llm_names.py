import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from llm_data import documents, frame  # noqa: E402
from test_llm_operators import bench_rows  # noqa: E402

from voicetally.llm import decontamination, jaccard_join, mixing  # noqa: E402
from voicetally.llm._io import free_names  # noqa: E402

CLASH = ["_decontaminate_row", "_Decontaminate_Row0", "_mix_key", "_mix_source", "_mix_n", "_mix_own", "_mix_i", "_mix_N0", "_row0"]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(0))) for c in CLASH}).cache()


def test_free_names(docs):
    assert free_names(docs, "_mix_n", "_x") == ["_mix_n1", "_x1"] and free_names(docs, "new") == ["new0"]


@pytest.mark.parametrize("stage", ["broadcast", "join", "mix", "groups"])
def test_columns_of_any_name_come_through(spark, docs, stage):
    bench = spark.createDataFrame(bench_rows(), "item_id long, text string")
    if stage == "mix":
        out, plain = mixing.mixed_rows(docs, 16), mixing.mixed_rows(frame(spark), 16)
    elif stage == "groups":
        out, plain = jaccard_join.one_per_group(docs), jaccard_join.one_per_group(frame(spark))
    else:
        words = 10_000_000 if stage == "broadcast" else 10
        out, plain = decontamination.clean(docs, bench, max_broadcast_words=words), decontamination.clean(frame(spark), bench, max_broadcast_words=words)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r['doc_id'] or 0}" for r in rows for c in CLASH)
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in plain.collect())
    assert len(documents()) >= len({r["doc_id"] for r in rows}) > 0
