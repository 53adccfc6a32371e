import csv
import gzip

import pytest

from voicetally.plans import pipeline as P
from voicetally.sources import segments as G
from voicetally.streaming import turn_counts

ROWS = [
    ("http://x.example/2022.02.01/acd.01.html", "NET", "Evening", "acd.01", "", "2022", "2", "1", "20:00", "ET", "p", "30", "Economy", 'ANN COOPER, CNN HOST: Tonight, "the economy". Joe Biden said the plan works. SENATOR JANE DOE, (D-NY): I disagree.'),
    ("http://x.example/2022.02.02/acd.02.html", "NET", "Evening", "", "", "2022", "2", "2", "20:00", "ET", "p", "", "Reform", "ANN COOPER, CNN HOST: More news.\nAccording to Barack Obama, reform is needed. JOHN SMITH, EYEWITNESS: Indeed it is."),
    ("http://x.example/z", "NET", "Evening", "acd.03", "", "3007", "2", "30", "", "", "", "x", "", "ROE, GUEST: Lost year."),
]


def write(path, rows=ROWS, zipped=False):
    with (gzip.open if zipped else open)(path, "wt", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(G.RAW)
        w.writerows(rows)


@pytest.fixture
def segments(spark, tmp_path):
    write(tmp_path / "a-1.csv", ROWS[:2])
    write(tmp_path / "a-2.csv.gz", ROWS[2:], zipped=True)
    return G.validate(G.read_csv(spark, [str(tmp_path / "a-1.csv"), str(tmp_path / "a-2.csv.gz")], partitions=3))


def test_scan_and_coercion(segments):
    r = {x["url"]: x for x in segments.collect()}
    assert len(r) == 3 and r[ROWS[2][0]]["year"] is None and r[ROWS[1][0]]["wordcount"] is None and r[ROWS[0][0]]["wordcount"] == 30
    assert '"the economy"' in r[ROWS[0][0]]["text"] and "\n" in r[ROWS[1][0]]["text"]


def test_checks(spark, tmp_path):
    write(tmp_path / "b.csv", [ROWS[0][:11] + ("-3",) + ROWS[0][12:], ROWS[1]])
    raw = G.read_csv(spark, str(tmp_path / "b.csv"))
    good, bad = G.quarantine(G.coerce(raw))
    assert good.count() == 1 and bad.first()["violations"] == ["wordcount_negative"]
    with pytest.raises(Exception, match="wordcount_negative"):
        G.validate(raw).select("url").collect()
    m = G.manifest(spark, str(tmp_path), "*.csv").first()
    assert m["filename"] == "b.csv" and len(m["sha256"]) == 64


def test_turns_and_series(segments):
    t = P.build_turns(segments)
    r = t.collect()
    assert len(r) == 5 and {x["show_code"] for x in r} == {"acd"} and {x["host"] for x in r} == {"Anderson Cooper"}
    doe = next(x for x in r if x["name_norm"] == "senator jane doe")
    assert (doe["canonical_id"], doe["office"], doe["party"], doe["year"], doe["era_id"]) == ("jane doe", "", "D", 2022, "era3")
    s = P.annual_hhi_speakers(t).collect()
    assert [(x["year"], x["n_distinct"], x["variant"]) for x in s] == [(2022, 2.0, "external")]
    assert P.annual_hhi_speakers(t, mode="clip").count() == 0
    tables = P.trend_tables(t)
    assert {x["variant"] for x in tables["hhi"].collect()} == {"external-all", "external-live"}
    assert tables["top_sources"].where("mode = 'all'").count() == 2


def test_pilot(segments):
    p = P.pilot(segments, "2022-02-01", "2022-02-02")
    assert {x["canonical_id"] for x in p["attributions"].collect()} == {"joe biden", "barack obama"}
    assert {(x["measure"], x["variant"]) for x in p["series"].collect()} == {("speakers", "external"), ("speakers", "all"), ("attributions", "person")}
    assert p["face_validity"].first()["ok"]
    assert P.between_days(segments, "2022-02-02", "2022-02-28").count() == 1


def test_lexicon_scans_and_sinks(spark, tmp_path, segments):
    (tmp_path / "lex.csv").write_text("# note\nkeyword,office\nVice President,vp\n\npresident,p\n")
    assert [(r["keyword"], r["office"]) for r in G.read_lexicon(spark, str(tmp_path / "lex.csv"), ["keyword", "office"]).orderBy("ord").collect()] == [("vice president", "vp"), ("president", "p")]
    (tmp_path / "words.txt").write_text("# note\nSay\n\ntell \n")
    assert [r["word"] for r in G.read_word_list(spark, str(tmp_path / "words.txt")).collect()] == ["say", "tell"]
    s = P.annual_hhi_speakers(P.build_turns(segments), "all")
    G.write_csv(s, str(tmp_path / "out"), ["year"])
    assert G.read_series(spark, str(tmp_path / "out")).first()["n_events"] == 4
    G.write_parquet(s, str(tmp_path / "pq"), ["year"])
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 1


def test_stream_counts_as_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "1.csv", ROWS[:1])
    write(tmp_path / "in" / "2.csv", ROWS[1:])
    names = spark.createDataFrame([("jane doe", "jane doe")], "name string, canonical_id string")
    q = turn_counts.count_turns(turn_counts.read_stream(spark, str(tmp_path / "in")), names).writeStream.outputMode("complete").format("memory").queryName("turns_now").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["year"], r["canonical_id"], r["n"]) for r in spark.sql("select * from turns_now").collect()} == {(2022, "jane doe", 1), (2022, "john smith", 1)}
