import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from voicetally.operators import lookups
from voicetally.operators.lookups import asof_lookup, interval_lookup
from voicetally.sources.tables import stored as lookups_stored
from voicetally.operators.shares import islands

RNG = random.Random(4)
POINTS = [(i, RNG.choice(["a", "b", "c", None]), RNG.choice([None, *range(-50, 2000)])) for i in range(600)] + [(600 + i, "a", 77) for i in range(300)]
SPANS = [(RNG.choice(["a", "b", None]), lo := RNG.choice([None, -60, *range(0, 2000, 7)]), None if lo is None else RNG.choice([None, lo, lo - 3, lo + 1, lo + 2, lo + RNG.randint(1, 900)]), k // 2) for k in range(150)]
ROWS = [(RNG.choice(["a", "b", None]), RNG.choice([None, *range(-20, 2000, 9)]), k) for k in range(150)]


def frames(spark, kind):
    """As whole numbers, days, or timestamps (microseconds)."""
    cast = {"number": lambda c: F.col(c).cast("int"), "date": lambda c: F.date_add(F.lit(dt.date(1970, 1, 1)), F.col(c)), "timestamp": lambda c: F.timestamp_micros(c)}[kind]
    p = spark.createDataFrame(POINTS, "i int, k string, p int").withColumn("p", cast("p"))
    t = spark.createDataFrame(SPANS, "k string, lo int, hi int, v int").withColumns({"lo": cast("lo"), "hi": cast("hi")})
    r = spark.createDataFrame(ROWS, "k string, at int, v int").withColumn("at", cast("at"))
    return p.repartition(5), t.repartition(3), r.repartition(3)


@pytest.mark.parametrize("kind", ["number", "date", "timestamp"])
@pytest.mark.parametrize("by", [(), ("k",)])
def test_interval_of_a_point(spark, kind, by):
    p, t, _ = frames(spark, kind)
    for order in (None, "v"):
        got = {r["i"]: (r["lo"], r["v"]) for r in interval_lookup(p, "p", t.withColumn("lo2", F.col("lo")).select("k", F.col("lo2").alias("lo"), "hi", "v"), "lo", "hi", ["lo", "v"], by=by, order=order).collect()}
        first = {r["i"]: r for r in p.collect()}
        spans = [(r["k"], r["lo"], r["hi"], r["v"]) for r in t.collect()]
        assert len(got) == len(POINTS)
        for i, x in first.items():
            fit = [(lo, hi, v) for k, lo, hi, v in spans if x["p"] is not None and lo is not None and lo <= x["p"] and (hi is None or x["p"] < hi) and (not by or (k is not None and k == x["k"]))]
            ends = lambda s: (s[0], s[1] is None, s[1] or s[0], s[2])
            want = min(fit, key=(lambda s: (s[2], *ends(s))) if order else ends, default=None)
            assert got[i] == ((want[0], want[2]) if want else (None, None)), (x, want)


@pytest.mark.parametrize("kind", ["number", "date", "timestamp"])
@pytest.mark.parametrize("by,within,parts", [((), None, 7), (("k",), None, 3), ((), 5, 5), (("k",), 30, 1)])
def test_latest_row_before_a_point(spark, kind, by, within, parts):
    p, _, r = frames(spark, kind)
    step = {"number": 1, "date": dt.timedelta(days=1), "timestamp": dt.timedelta(microseconds=1)}[kind]
    got = {x["i"]: x["v"] for x in asof_lookup(p, "p", r, "at", ["v"], by=by, within=within, parts=parts).collect()}
    rows = [(x["k"], x["at"], x["v"]) for x in r.collect()]
    assert len(got) == len(POINTS)
    for x in p.collect():
        fit = [(at, v) for k, at, v in rows if x["p"] is not None and at is not None and at <= x["p"] and (not by or (k is not None and k == x["k"]))]
        want = max(fit, default=None)
        if want and within is not None and x["p"] - want[0] > within * step:
            want = None
        assert got[x["i"]] == (want[1] if want else None), (x, want)


def test_empty_tables_and_plans(spark):
    p, t, r = frames(spark, "number")
    assert interval_lookup(p, "p", t.where("false"), "lo", "hi", ["v"]).where("v is null").count() == len(POINTS)
    assert asof_lookup(p, "p", r.where("false"), "at", ["v"]).where("v is null").count() == len(POINTS)
    assert interval_lookup(p.where("false"), "p", t, "lo", "hi", ["v"]).count() == asof_lookup(p.where("false"), "p", r, "at", ["v"]).count() == 0
    for df in (interval_lookup(p, "p", t, "lo", "hi", ["v"]), asof_lookup(p, "p", r, "at", ["v"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(TypeError):
        interval_lookup(p.withColumn("p", F.col("p").cast("double")), "p", t, "lo", "hi", ["v"])


def runs(rows):
    out = []
    for k, o, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if v is None:
            continue
        if out and out[-1][:2] == [k, v] and out[-1][3] == o - 1:
            out[-1][3:] = [o, out[-1][4] + 1]
        else:
            out.append([k, v, o, o, 1])
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("by", [(), ("k",)])
@pytest.mark.parametrize("parts", [1, 3, 16])
def test_runs_over_ranges(spark, by, parts):
    """One run over all ranges, runs that end at an edge, gaps, nulls, and groups."""
    rng = random.Random(7)
    rows = [(None, o, None if o % 97 == 0 else "x" if 200 < o < 700 else rng.choice("xyz")) for o in range(1000) if o % 131 != 5]
    if by:
        rows = [(k, o, v) for k in ("a", "b", None) for _, o, v in rows if k != "b" or o % 2]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(5)
    got = islands(df, "o", "v", by, parts=parts)
    assert sorted(((r["k"] if by else None, r["v"], r["first"], r["last"], r["n"]) for r in got.collect()), key=repr) == runs(rows)
    assert islands(df.where("false"), "o", "v", by, parts=parts).count() == 0


@pytest.mark.parametrize("by", [(), ("k",), ("k", "n")])
@pytest.mark.parametrize("rows", [1, 7, 60])
def test_intervals_over_ranges(spark, by, rows):
    """Intervals over many ranges, over one, and ends at an edge: the smallest that holds a point, whatever the ranges."""
    p, t, _ = frames(spark, "number")
    p, t = p.withColumn("n", F.col("p") % 2), t.withColumn("n", F.col("v") % 2)
    want = {}
    spans = [r for r in t.collect() if r["lo"] is not None]
    for x in p.collect():
        fit = [r["v"] for r in spans if x["p"] is not None and r["lo"] <= x["p"] and (r["hi"] is None or x["p"] < r["hi"]) and all(x[b] is not None and x[b] == r[b] for b in by)]
        want[x["i"]] = min(fit, default=None)
    got = interval_lookup(p, "p", t.select("k", "n", "lo", "hi", "v"), "lo", "hi", ["v"], by=by, order="v", rows=rows)
    assert {r["i"]: r["v"] for r in got.select("i", p["p"], got["v"]).collect()} == want


def most_rows(spark, first):
    """The most rows that a step of the SQL executions from number `first` on made."""
    store = spark._jsparkSession.sharedState().statusStore()
    out = 0
    for e in range(first, store.executionsCount()):
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for m in (nodes.apply(i).metrics().apply(j) for i in range(nodes.size()) for j in range(nodes.apply(i).metrics().size())):
            if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                out = max(out, int(values.apply(m.accumulatorId()).replace(",", "")))
    return out


def test_intervals_that_all_overlap(spark):
    """Each of 2,000 intervals holds most of 3,000 points: no step makes the six million pairs of them."""
    t = spark.range(2000).selectExpr("id % 50 as lo", "3000 - id % 70 as hi", "id as v")
    p = spark.range(3000).selectExpr("id as p")
    first = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {r["p"]: r["v"] for r in interval_lookup(p, "p", t, "lo", "hi", ["v"], order="v").collect()}
    assert got == {i: min((v for v in range(350) if v % 50 <= i < 3000 - v % 70), default=None) for i in range(3000)}
    assert most_rows(spark, first) <= 8000


def test_intervals_of_all_lengths(spark):
    """Points are not repeated for each length that intervals have."""
    t = spark.range(30).selectExpr("shiftleft(1L, int(id)) as lo", "shiftleft(1L, int(id) + 1) as hi", "id as v")
    p = spark.range(3000).selectExpr("id * 300001 as p")
    first = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {r["p"]: r["v"] for r in interval_lookup(p, "p", t, "lo", "hi", ["v"]).collect()}
    assert got == {i * 300001: (i * 300001).bit_length() - 1 if 0 < i * 300001 < 1 << 30 else None for i in range(3000)}
    assert most_rows(spark, first) <= 4000


def test_what_an_interval_lookup_stores(spark, monkeypatch):
    """Tables between the steps hold keys, places and values only: no hashes, and of what is found not its interval."""
    seen = {}
    monkeypatch.setattr(lookups, "stored", lambda df, name: (seen.setdefault(name, df.schema), lookups_stored(df, name))[1])
    p, t, _ = frames(spark, "number")
    assert interval_lookup(p, "p", t, "lo", "hi", ["v"], by=["k"], order="v").count() == len(POINTS)
    assert seen["spans"].names == ["_k0", "_lo", "_hi", "_v"] and seen["points"].names == ["_k0", "_p"]
    assert seen["intervals"].names == ["_k0", "_p", "_v"] and seen["intervals"]["_v"].dataType.names == ["v"]
