import shutil
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_data import documents, frame  # noqa: E402
from test_llm_operators import bench_rows, expected_components, expected_hits, water  # noqa: E402

pipeline = pytest.importorskip("corpus_pipeline")
from voicetally.llm import token_store, toxicity  # noqa: E402
from voicetally.llm._io import materialize  # noqa: E402
from voicetally.llm.queries import fold  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows = documents()
    rows = [(*r[:1], f"{r[1]}. what a blorker you are" if r[0] % 5 == 1 and r[1] and r[0] < 60 else r[1], *r[2:]) for r in rows]
    frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] % 5 == 1)) for r in {r[0]: r for r in rows if r[0] < 60}.values()], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench_rows(), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, sf_dir), f"test-{name}")
        rows = sorted((r["doc_id"], r["text"]) for r in before.collect()) if name == "token_output" else None
        kept[name] = docs.count()
        if name != "token_output":
            assert set(docs.columns) == set(before.columns)
        was, now = before.collect(), docs.collect()
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score(before, labels, fold(5, 0)).collect() if r["predicted"]}
            assert bad and sorted(r["doc_id"] for r in now) == sorted(r["doc_id"] for r in was if r["doc_id"] not in bad)
        elif name == "ngram_jaccard_join":
            want = {c for _, _, c in expected_components([tuple(r) for r in was])}
            assert sorted(r["doc_id"] for r in now) == sorted(want)
        elif name == "benchmark_decontamination":
            want = expected_hits([tuple(r) for r in was], bench_rows())
            assert sorted(r["doc_id"] for r in now) == sorted(r[0] for r in want if not r[5])
        elif name == "source_mixing":
            size, got, texts = Counter(), Counter(), {r["doc_id"]: r["text"] for r in was}
            for r in was:
                size[r["source"]] += len((r["text"] or "").split())
            for r in now:
                got[r["source"]] += len(r["text"].split())
                assert texts[r["doc_id"]] == r["text"]
            assert max(Counter(r["doc_id"] for r in now).values()) <= 2
            longest = max(len((t or "").split()) for t in texts.values())
            assert all(abs(got[s] - t) <= longest for s, t in water(dict(size)).items())
        else:
            import public_tokenizers
            from tokenizers import Tokenizer

            lib, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
            for i, t in rows:
                ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
                want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
                at += len(ids)
            assert sorted(map(tuple, now), key=lambda r: r[1]) == want
    assert kept["toxicity"] > kept["ngram_jaccard_join"] > kept["benchmark_decontamination"] > 0


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0 and (name == "token_output" or set(out.columns) == set(docs.columns))


def test_token_stage_leaves_no_pieces_in_workers(spark, monkeypatch, tmp_path):
    """What the token stage's encoders learn goes with each task, so that later stages have the workers' memory."""
    path = str(shutil.copy(pipeline.public_tokenizers.path("byte_bpe_50k.json"), tmp_path / "own.json"))
    monkeypatch.setattr(pipeline.public_tokenizers, "path", lambda name: path)
    docs = frame(spark, documents())

    def held(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(token_store._encoder(path, 200_000).known)])], ["n"])

    def most():
        return max(r["n"] for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect())

    assert pipeline.token_stage(spark, docs, "").count() == docs.count()
    assert most() == 0
    folder, _ = token_store.write_store(docs, path)
    assert most() > 0 and token_store.read_store(docs, folder).count() == docs.count()
