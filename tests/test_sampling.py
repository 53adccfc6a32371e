import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from voicetally.operators.sampling import bottom_k, least_of_each, stratified_sample, yearly_sample

RNG = random.Random(6)
ROWS = [(i, RNG.choice(["a", "b", "b", "b", None]), RNG.choice([1, 2, None]), "x", i) for i in range(3000)]
SCHEMA = "id int, s string, t int, _digest0 string, _rank0 int"


@pytest.mark.parametrize("parts", [1, 9])
@pytest.mark.parametrize("strata", [["s"], ["s", "t"]])
def test_same_rows_as_ranking(spark, parts, strata):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(parts)
    got = stratified_sample(df, strata, 7, "id", 3)
    assert got.columns == df.columns
    groups = defaultdict(list)
    for r in ROWS:
        key = r[1:2] if strata == ["s"] else r[1:3]
        if None not in key:
            groups[key].append((hashlib.md5(f"3:{r[0]}".encode()).hexdigest(), r))
    assert sorted(map(tuple, got.collect())) == sorted(r for g in groups.values() for _, r in sorted(g)[:7])


def test_tasks_send_few_rows(spark):
    """The shuffle gets k rows per stratum and task at most, and rows are ranked after it only."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    plan = bottom_k(df.dropna(subset=["s"]), ["s"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 and "NestedLoop" not in plan
    assert yearly_sample(df.withColumnRenamed("t", "year"), 2, "id").count() == 4
    assert bottom_k(df.where("false"), ["s"], ["id"], 5).count() == 0


def test_merging_parts():
    t = pa.table({"s": [x or "z" for _, x, *_ in ROWS], "id": [r[0] for r in ROWS]})
    whole = least_of_each(t, ["s"], ["id"], 10)
    halves = pa.concat_tables([least_of_each(t.slice(0, 1000), ["s"], ["id"], 10), least_of_each(t.slice(1000), ["s"], ["id"], 10)])
    assert least_of_each(halves, ["s"], ["id"], 10).equals(whole) and whole.num_rows == 30
    assert least_of_each(t.slice(0, 0), ["s"], ["id"], 10).num_rows == 0
