"""The stream's totals after each batch of files are the batch's counts over the same files."""

import pytest
from pyspark.sql import functions as F

from voicetally.plans import pipeline as P
from voicetally.plans import queries as Q
from voicetally.sources import segments as G
from voicetally.streaming import resolved_counts as R
from voicetally.streaming import turn_counts as T

#: Files in turn; SMITH is nobody, then John, then ambiguous; DOE comes with its full name at once, ROE stays bare, BUSH is an alias.
FILES = [
    ["SMITH, GUEST: One. DOE, MAYOR: Two. JANE DOE, MAYOR: Three.", "ROE, POET: x. SMITH, GUEST: y. BARACK OBAMA, PRESIDENT: z. BUSH, AUTHOR: q."],
    ["JOHN SMITH, GUEST: One. SMITH, GUEST: Two.\n(BEGIN VIDEO CLIP) SMITH, GUEST: clip (END VIDEO CLIP)", "ANN HOST, CNN HOST: no guest. ROE, POET: x."],
    ["MARY SMITH, GUEST: One. DOE, MAYOR: Two.", "no turns here", "SMITH, GUEST: again."],
    ["PAUL SMITH, GUEST: One. SMITH, GUEST: Two. SMITH, GUEST: Three.", "JOHN SMITH, GUEST: Four."],
]


def write(folder, k):
    rows = [",".join(f'"{c}"' for c in G.RAW)]
    for i, text in enumerate(FILES[k]):
        rows.append(",".join(f'"{v}"' for v in (f"http://x.example/{k}{i}", "NET", "P", f"acd.0{i}", "", 2001 + (k + i) % 2, 1 + k, 2, "20:00", "ET", "p", 1, "s", text)))
    (folder / f"{k}.csv").write_text("\n".join(rows) + "\n")


def batch(spark, folder):
    t = P.build_turns(G.coerce(G.read_csv(spark, f"{folder}/*.csv"))).where("staff_flag = 'guest' and canonical_id <> ''")
    return sorted(map(tuple, t.groupBy("year", "source_mode", "canonical_id").agg(F.count("*").alias("n")).collect()))


def test_differences_add_up_after_every_file(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    spark.conf.set(*R.STORE)
    seen = []
    for k in range(len(FILES)):  # each start goes on from the state of the one before
        write(tmp_path / "in", k)
        changes = R.count_changes(T.read_stream(spark, str(tmp_path / "in")))
        q = changes.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = R.totals(spark.read.schema(R.CHANGES).parquet(str(tmp_path / "out")))
        assert sorted(map(tuple, got.select("year", "mode", "canonical_id", "n").collect())) == batch(spark, tmp_path / "in")
        seen.append({r["canonical_id"] for r in got.collect()})
    assert "smith" in seen[0] and "john smith" in seen[1] and "smith" not in seen[1] and "ambiguous:smith" in seen[2]
    assert all({"roe", "jane doe", "barack obama", "george w. bush"} <= s for s in seen)


@pytest.mark.parametrize("one", [True, False])
def test_all_files_at_once_or_one_by_one(spark, tmp_path, one):
    for k in range(len(FILES)):
        write(tmp_path, k)
    stream = T.read_stream(spark, str(tmp_path), 1 if one else 10)
    assert sorted(map(tuple, R.run_available(stream).select("year", "mode", "canonical_id", "n").collect())) == batch(spark, tmp_path)


def test_fixed_names(spark, tmp_path):
    for k in range(len(FILES)):
        write(tmp_path, k)
    names = spark.createDataFrame([("roe", "ann roe")], "name string, canonical_id string")
    got = T.run_available(T.count_turns(T.read_stream(spark, str(tmp_path)), names))
    assert {(r["canonical_id"], r["n"]) for r in got.where("canonical_id like '% roe'").collect()} == {("ann roe", 1)}
    assert got.agg(F.sum("n")).first()[0] == sum(r[3] for r in batch(spark, tmp_path))


def test_files_grow_in_number_not_in_size(spark, tmp_path):
    """A file is one task's work: of 5,000 segments each file holds some thousand, and a stream takes a third of the files at once."""
    spark.range(5000).selectExpr("id as conv_id", "0L as turn", "'user' as role", "'Hello.' as text").write.parquet(f"{tmp_path}/conversations.parquet")
    taken = []
    files = T.read_stream
    with pytest.MonkeyPatch.context() as m:
        m.setattr(T, "read_stream", lambda spark, path, n=1: taken.append((path, n)) or files(spark, path, n))
        got = Q.QUERIES["stream_resolved"](spark, str(tmp_path))
    ((path, n),) = taken
    per = [r["n"] for r in G.read_csv(spark, path).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(per) == 5 and sum(per) == 5000 and max(per) < 1300 and n == 2
    assert got.agg(F.sum("n")).first()[0] > 0
