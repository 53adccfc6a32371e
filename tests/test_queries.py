import math
from pathlib import Path

import duckdb
import pytest

from voicetally.plans.queries import ORACLE, QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 7) if isinstance(v, float) else v


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got
    if name in ORACLE:
        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from '{p}'")
        q = con.sql(ORACLE[name])
        assert sorted(q.columns) == cols
        assert got == sorted((tuple(plain(dict(zip(q.columns, r))[c]) for c in cols) for r in q.fetchall()), key=repr)
