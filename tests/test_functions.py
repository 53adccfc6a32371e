import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from voicetally.functions import market as M
from voicetally.functions import text as X


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows)]


def test_names(spark):
    raw = ["Sen. John McCain (R-AZ)", "President Barack Obama", "Dr. Sanjay Gupta", "COOPER", "Vice President Joe Biden", "Rep. Nancy Pelosi, (D) California", "Mr. James O'Brien", "President", "Vice President", "", None]
    want = ["john mccain", "barack obama", "sanjay gupta", "cooper", "joe biden", "nancy pelosi", "james o'brien", "president", "", "", ""]
    assert each(spark, raw, X.normalize_name) == want


def test_offices_and_parties(spark):
    roles = ["PRESIDENT OF THE UNITED STATES", "VICE PRESIDENT", "WHITE HOUSE PRESS SECRETARY", "U.S. SECRETARY OF STATE", "SENATOR (D-CA)", "REPUBLICAN PRES. CANDIDATE", "ACTOR", "AMS METEOROLOGIST", "", None]
    assert each(spark, roles, X.classify_office) == ["president", "vice_president", "press_secretary", "cabinet_secretary", "senator", "candidate", "entertainment", "", "", ""]
    tags = ["SENATOR (D-CA)", "REP. (R-TX)", "SENATOR, I-VT", "D-CALIF.", "REPUBLICAN STRATEGIST", "DEMOCRATIC POLLSTER", "DEMOCRAT (R-XX)", "(D) NEW YORK", "ACTOR", "", None]
    assert each(spark, tags, X.parse_party) == ["D", "R", "I", "D", "R", "D", "R", None, None, None, None]


def test_role_classes(spark):
    assert each(spark, ["CNN HOST", "HOSTAGE NEGOTIATOR", "EYEWITNESS", "", None], lambda c: X.classify_role(c, F.lit("JANE DOE"))) == ["staff", "staff", "guest", "unknown", "unknown"]
    assert each(spark, ["MALE", "UNIDENTIFIED MALE 2", "MALEK"], X.is_nonperson) == [True, True, False]


def test_uids_and_urls(spark):
    uids = ["acd.01", "acd", "lkl.00", "ACD.02", "cnni.cf.03", "", None]
    assert each(spark, uids, X.show_code) == ["acd", "acd", "lkl", "acd", "cnni", None, None]
    assert each(spark, uids, X.segment_index) == [1, None, 0, 2, 3, None, None]
    assert each(spark, ["http://x/2022.02.01/a", "http://x/2022.02.30/a", "http://x", None], X.url_date) == [dt.date(2022, 2, 1), None, None, None]
    assert each(spark, ["http://x/acd.01.html", "http://x/acd.02/", ""], lambda c: X.effective_uid(F.lit(""), c)) == ["acd.01", "acd.02", ""]


def test_dates(spark):
    d = spark.createDataFrame([(2022, 2, 1), (2022, 2, 30), (2022, 2, None), (None, 1, 1)], "y int, m int, d int").select(X.air_date("y", "m", "d").alias("o")).collect()
    assert [r["o"] for r in d] == [dt.date(2022, 2, 1), None, None, None]
    days = [dt.date(2000, 6, 1), dt.date(2001, 1, 19), dt.date(2001, 1, 20), dt.date(2025, 6, 1), dt.date(1990, 1, 1), None]
    assert each(spark, days, X.president_on, "date") == ["bill clinton", "bill clinton", "george w. bush", "donald trump", None, None]
    eras = [dt.date(2000, 1, 1), dt.date(2002, 9, 16), dt.date(2002, 9, 17), dt.date(2014, 6, 17), dt.date(2014, 6, 18), None]
    assert each(spark, eras, X.era_of, "date") == ["era1", "era1", "era2", "era2", "era3", None]
    with pytest.raises(Exception, match="before the corpus start"):
        each(spark, [dt.date(1999, 12, 31)], X.era_of, "date")
    assert each(spark, [dt.date(1999, 12, 31)], lambda c: X.era_of(c, strict=False), "date") == [None]


def test_prf(spark):
    s = one(spark, X.prf(F.lit(8), F.lit(2), F.lit(4)), X.prf(F.lit(0), F.lit(0), F.lit(0)))
    assert s[0]["precision"] == 0.8 and abs(s[0]["recall"] - 2 / 3) < 1e-12
    assert tuple(s[1]) == (0.0, 0.0, 0.0)


def test_markets(spark):
    def f(m, *counts):
        return one(spark, m(F.array(*[F.lit(float(c)) for c in counts]) if counts else F.array().cast("array<double>")))[0]

    assert abs(f(M.hhi, 50, 30, 20) - 0.38) < 1e-12 and f(M.hhi, 1, 1, 1, 1) == 0.25 and f(M.hhi, 9, 0) == 1.0
    assert math.isnan(f(M.hhi)) and math.isnan(f(M.normalized_hhi)) and math.isnan(f(M.normalized_entropy)) and f(lambda c: M.top_k_share(c, 3)) == 0.0
    assert f(M.normalized_hhi, 5) == 1.0 and abs(f(M.normalized_hhi, 2, 2)) < 1e-12 and abs(f(M.normalized_entropy, 3, 3, 3) - 1) < 1e-12
    assert f(lambda c: M.top_k_share(c, 1), 6, 2, 2) == 0.6 and f(M.n_distinct, 1, 0, 2) == 2
    with pytest.raises(Exception, match="non-negative"):
        f(M.hhi, 1, -1)
