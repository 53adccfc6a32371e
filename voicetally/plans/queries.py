"""Queries over the standard tables, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import market as M
from ..functions import text as X
from ..operators import draws as D
from ..operators import lookups as K
from ..operators import shares as S
from ..operators import uncertainty as U
from ..operators.attribution import extract_with_model
from ..operators.concentration import METRICS, concentration, concentration_of_counts, market_counts
from ..operators.lexicon import first_match
from ..operators.resolve import read_aliases, resolve_mentions
from ..operators.sampling import stratified_sample, yearly_sample
from ..operators.turns import clip_spans, names_on_air, parse_turns
from ..sources import segments as G
from ..sources import tables
from . import corpus as C
from . import incremental as I
from . import pipeline as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _round(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


RATIOS = METRICS[:5]


def _metrics_sql(counts: str, by: str) -> str:
    """The METRICS of a counts query (by, e, c), per by."""
    return f"""
WITH cnt AS ({counts}),
r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY c DESC, e) AS rk FROM cnt),
a AS (SELECT {by}, sum(c)::DOUBLE AS s, sum(c * c)::DOUBLE AS s2, sum(c * ln(c)) AS sl, count(*)::DOUBLE AS n,
             sum(CASE WHEN rk <= 10 THEN c ELSE 0 END)::DOUBLE AS t10, sum(CASE WHEN rk <= 25 THEN c ELSE 0 END)::DOUBLE AS t25
      FROM r GROUP BY {by})
SELECT {by}, round(s2 / (s * s), 9) AS hhi,
       round(CASE WHEN n = 1 THEN 1.0 ELSE (s2 / (s * s) - 1 / n) / (1 - 1 / n) END, 9) AS hhi_normalized,
       round(t10 / s, 9) AS top10_share, round(t25 / s, 9) AS top25_share,
       round(CASE WHEN n = 1 THEN 0.0 ELSE (ln(s) - sl / s) / ln(n) END, 9) AS entropy_norm, n AS n_distinct, s AS n_events
FROM a"""


def _orders(spark, d) -> DataFrame:
    return _t(spark, d, "orders").withColumn("year", F.year("o_orderdate"))


ORDERS_BY_YEAR = "SELECT year(o_orderdate)::INT AS year, o_custkey AS e, count(*) AS c FROM orders GROUP BY 1, 2"


@query("hhi_by_year", f"SELECT year, hhi, n_distinct, n_events FROM ({_metrics_sql(ORDERS_BY_YEAR, 'year')})")
def hhi_by_year(spark, d):
    return _round(concentration(_orders(spark, d), ["year"], "o_custkey"), "hhi").select("year", "hhi", "n_distinct", "n_events")


@query("concentration_by_year", _metrics_sql(ORDERS_BY_YEAR, "year"))
def concentration_by_year(spark, d):
    return _round(concentration(_orders(spark, d), ["year"], "o_custkey"), *RATIOS)


@query("concentration_by_segment", _metrics_sql("SELECT c_mktsegment, o_custkey AS e, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2", "c_mktsegment"))
def concentration_by_segment(spark, d):
    # counted by customer before the join, so orders shuffle as partial counts
    per = market_counts(_t(spark, d, "orders"), [], "o_custkey").join(_t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return _round(concentration(per, ["c_mktsegment"], "o_custkey", F.col("c")), *RATIOS)


@query("concentration_events_by_type", _metrics_sql("SELECT event_type, user_id AS e, count(*) AS c FROM events WHERE event_type IN ('purchase', 'signup', 'error') GROUP BY 1, 2", "event_type"))
def concentration_events_by_type(spark, d):
    return _round(concentration(_t(spark, d, "events").where(F.col("event_type").isin("purchase", "signup", "error")), ["event_type"], "user_id"), *RATIOS)


@query("concentration_dedup", "SELECT year, 'attributions' AS measure, 'person' AS variant, * EXCLUDE (year) FROM (" + _metrics_sql("SELECT year(l_shipdate)::INT AS year, l_suppkey::VARCHAR AS e, count(DISTINCT l_orderkey) AS c FROM lineitem GROUP BY 1, 2", "year") + ")")
def concentration_dedup(spark, d):
    """A source counts once per order and year."""
    li = _t(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_suppkey").cast("string").alias("canonical_id"), F.col("l_orderkey").alias("url"), F.lit("PERSON").alias("entity_type"))
    return _round(P.annual_hhi_attributions(li), *RATIOS)


@query("concentration_weighted", _metrics_sql("SELECT l_returnflag, l_suppkey AS e, sum(l_quantity)::BIGINT AS c FROM lineitem GROUP BY 1, 2", "l_returnflag"))
def concentration_weighted(spark, d):
    return _round(concentration(_t(spark, d, "lineitem"), ["l_returnflag"], "l_suppkey", F.col("l_quantity").cast("bigint")), *RATIOS)


@query("market_functions", _metrics_sql(ORDERS_BY_YEAR, "year"))
def market_functions(spark, d):
    """The measures of each year's market given as one array of counts, with zeros, which do not count."""
    year = market_counts(_orders(spark, d), ["year"], "o_custkey").groupBy("year").agg(F.collect_list(F.col("c").cast("double")).alias("counts"))
    m = year.select("year", M.concentration_metrics(F.array_append("counts", F.lit(0.0))).alias("m"))
    return _round(m.select("year", "m.*"), *RATIOS)


@query("top_sources", """
WITH c AS (SELECT year(o_orderdate)::INT AS year, o_custkey, count(*) AS c FROM orders GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY c DESC, o_custkey) AS rk, sum(c) OVER (PARTITION BY year) AS s FROM c)
SELECT year, rk::INT AS "rank", o_custkey, c AS n_turns, round(c / s::DOUBLE, 9) AS share FROM r WHERE rk <= 15""")
def top_sources(spark, d):
    return _round(S.top_sources(market_counts(_orders(spark, d), ["year"], "o_custkey"), ["year"], "o_custkey"), "share")


@query("rank_bands", f"SELECT year, round(top10_share, 8) AS band_top10, round(top25_share - top10_share, 8) AS band_next15, round(1 - top25_share, 8) AS band_rest FROM ({_metrics_sql(ORDERS_BY_YEAR, 'year')})")
def rank_bands(spark, d):
    bands = ("band_top10", "band_next15", "band_rest")
    return _round(S.rank_bands(concentration(_orders(spark, d), ["year"], "o_custkey")).select("year", *bands), *bands, digits=8)


@query("effective_voices", "SELECT year, round(s * s / s2, 4) AS effective_voices FROM (SELECT year, sum(c)::DOUBLE AS s, sum(c * c)::DOUBLE AS s2 FROM (" + ORDERS_BY_YEAR + ") GROUP BY year)")
def effective_voices(spark, d):
    c = concentration(_orders(spark, d), ["year"], "o_custkey")
    return c.select("year", F.round(S.effective_voices(F.col("hhi")), 4).alias("effective_voices"))


MODE_SQL = """
WITH c AS (SELECT year(l_shipdate)::INT AS year, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag = 'A') AS b FROM lineitem GROUP BY 1)
SELECT year, a::DOUBLE AS n_R, b::DOUBLE AS n_A, round(a / (a + b)::DOUBLE, 9) AS R_share FROM c WHERE a > 0 AND b > 0"""


def _by_flag(spark, d) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("mode"), "l_suppkey")


@query("mode_share", MODE_SQL)
def mode_share(spark, d):
    n = _by_flag(spark, d).groupBy("year", "mode").agg(F.count("*").cast("double").alias("n_events"))
    return _round(S.mode_share(n, "R", "A"), "R_share")


@query("mode_share_join", MODE_SQL)
def mode_share_join(spark, d):
    n = concentration(_by_flag(spark, d), ["year", "mode"], "l_suppkey").select("year", "mode", "n_events")
    a, b = (n.where(F.col("mode") == m).select("year", F.col("n_events").alias(f"n_{m}")) for m in "RA")
    return a.join(b, "year").withColumn("R_share", F.round(F.col("n_R") / (F.col("n_R") + F.col("n_A")), 9))


@query("flag_share", """
SELECT year(o_orderdate)::INT AS year, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_flagged, count(*) AS n_total,
       round(count(*) FILTER (o_orderpriority = '1-URGENT') / count(*)::DOUBLE, 9) AS share FROM orders GROUP BY 1""")
def flag_share(spark, d):
    a = _orders(spark, d).groupBy("year", (F.col("o_orderpriority") == "1-URGENT").alias("flag")).agg(F.count("*").alias("n"))
    return _round(S.flag_share(a, "flag", ["year"]), "share")


@query("bucket_share_pivot", """
SELECT 'all' AS mode, year(o_orderdate)::INT AS year, count(*) AS n_guest_turns, 1.0::DOUBLE AS office_coverage, 0.0::DOUBLE AS executive_share, """ + ", ".join(f"round(nullif(count(*) FILTER (o_orderstatus = '{s}'), 0) / count(*)::DOUBLE, 9) AS {s}_share" for s in "FOP") + " FROM orders GROUP BY 2")
def bucket_share_pivot(spark, d):
    agg = _orders(spark, d).groupBy(F.lit("all").alias("mode"), "year", F.col("o_orderstatus").alias("office")).agg(F.count("*").alias("n"))
    return _round(S.office_share(agg, list("FOP")), "office_coverage", "executive_share", *[f"{s}_share" for s in "FOP"])


@query("all_mode_rollup", """
SELECT year, coalesce(m, 'all') AS mode, canonical_id, sum(n)::BIGINT AS n FROM
 (SELECT year(l_shipdate)::INT AS year, l_returnflag AS m, l_suppkey::VARCHAR AS canonical_id, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
GROUP BY GROUPING SETS ((year, m, canonical_id), (year, canonical_id))""")
def all_mode_rollup(spark, d):
    nothing = {"staff_flag": F.lit("guest"), "is_president": F.lit(False), "office": F.lit(""), "party": F.lit(None).cast("string")}
    t = _by_flag(spark, d).select("year", F.col("mode").alias("source_mode"), F.col("l_suppkey").cast("string").alias("canonical_id")).withColumns(nothing)
    return S.turn_aggregate(t).select("year", "mode", "canonical_id", "n")


@query("coverage_annual", "SELECT year(o_orderdate)::INT AS year, count(*) AS n_segments FROM orders GROUP BY 1")
def coverage_annual(spark, d):
    return S.coverage(_orders(spark, d))


@query("islands", """
WITH m AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate))::INT AS m, o_orderstatus AS s, count(*) AS c FROM orders GROUP BY 1, 2),
t AS (SELECT m, s FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY c DESC, s) AS rk FROM m) WHERE rk = 1),
g AS (SELECT *, CASE WHEN lag(s) OVER w = s AND lag(m) OVER w = m - 1 THEN 0 ELSE 1 END AS n FROM t WINDOW w AS (ORDER BY m)),
r AS (SELECT *, sum(n) OVER (ORDER BY m) AS run FROM g)
SELECT s AS status, min(m) AS "first", max(m) AS "last", count(*) AS n FROM r GROUP BY run, s""")
def islands(spark, d):
    m = _t(spark, d, "orders").groupBy((F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("c"))
    top = m.withColumn("r", F.row_number().over(Window.partitionBy("m").orderBy(F.col("c").desc(), "status"))).where("r = 1")
    return S.islands(top, "m", "status")


PRES_SQL, ERA_SQL, OFFICE_SQL, PARTY_SQL, FLAG_SQL = C.PRES, C.ERA, C.OFFICE, C.PARTY, C.FLAG


@query("interval_lookup", f"SELECT {PRES_SQL.format(d='o_orderdate::DATE')} AS president, count(*) AS n FROM orders GROUP BY 1")
def interval_lookup(spark, d):
    return _t(spark, d, "orders").groupBy(X.president_on(F.to_date("o_orderdate")).alias("president")).agg(F.count("*").alias("n"))


@query("asof_era", f"SELECT {ERA_SQL.format(d='o_orderdate::DATE')} AS era, count(*) AS n FROM orders GROUP BY 1")
def asof_era(spark, d):
    return _t(spark, d, "orders").groupBy(X.era_of(F.to_date("o_orderdate"), strict=False).alias("era")).agg(F.count("*").alias("n"))


def _presidents(spark) -> DataFrame:
    """The fixed table as a table of its own."""
    rows = [(k, who, first, after) for k, (who, _, first, after) in enumerate(L.PRESIDENTS)]
    return spark.createDataFrame(rows, "ord int, person string, first date, after date")


@query("interval_table", f"SELECT o_orderkey, {PRES_SQL.format(d='o_orderdate::DATE')} AS person FROM orders")
def interval_table(spark, d):
    days = _t(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return K.interval_lookup(days, "day", _presidents(spark), "first", "after", ["person"], order="ord").select("o_orderkey", "person")


@query("interval_by_user", """
WITH p AS (SELECT user_id, event_id, ts AS lo, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS hi FROM events WHERE event_type = 'purchase')
SELECT e.event_id, p.event_id AS purchase FROM events e LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.lo AND (p.hi IS NULL OR e.ts < p.hi)""")
def interval_by_user(spark, d):
    """Each event with the purchase in whose span it lies: a user's purchase lasts until the next one, or has no end."""
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    span = e.where("event_type = 'purchase'").withColumn("hi", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    span = span.select("user_id", F.col("ts").alias("lo"), "hi", F.col("event_id").alias("purchase"))
    return K.interval_lookup(e, "ts", span, "lo", "hi", ["purchase"], by=["user_id"]).select("event_id", "purchase")


@query("interval_overlaps", """
WITH c AS (SELECT o_custkey, min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders GROUP BY 1),
d AS (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem),
f AS (SELECT day, min(struct_pack(n := hi - lo, c := o_custkey)) AS v FROM d JOIN c ON day >= lo AND day < hi GROUP BY 1)
SELECT day, v.c AS o_custkey, n_lines FROM (SELECT l_shipdate::DATE AS day, count(*) AS n_lines FROM lineitem GROUP BY 1) LEFT JOIN f USING (day)""")
def interval_overlaps(spark, d):
    """Ship days with the customer of the shortest span of orders that holds them: spans of all lengths that overlap."""
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    days = _t(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n_lines"))
    span = o.withColumn("key", F.struct(F.datediff("hi", "lo"), "o_custkey"))
    return K.interval_lookup(days, "day", span, "lo", "hi", ["o_custkey"], order="key").select("day", "o_custkey", "n_lines")


@query("asof_by_user", """
SELECT e.event_id, CASE WHEN e.ts - p.ts <= INTERVAL 6 HOURS THEN p.event_id END AS seen FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def asof_by_user(spark, d):
    """Each event with the user's latest view at or before it, six hours back at most."""
    e = _t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("seen"))
    return K.asof_lookup(e, "ts", views, "at", ["seen"], by=["user_id"], within=6 * 3_600_000_000).select("event_id", "seen")


@query("asof_table", """
WITH o AS (SELECT o_orderdate::DATE AS day, max(struct_pack(p := o_totalprice, k := o_orderkey)) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT l_orderkey, l_linenumber, CASE WHEN l.l_shipdate::DATE - o.day <= 30 THEN v.k END AS latest FROM lineitem l ASOF LEFT JOIN o ON l.l_shipdate::DATE >= o.day""")
def asof_table(spark, d):
    """Each order line with the dearest of the latest pending orders up to its ship day, thirty days back at most, over all rows."""
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("day"))
    o = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.to_date("o_orderdate").alias("at"), "o_totalprice", F.col("o_orderkey").alias("latest"))
    return K.asof_lookup(li, "day", o, "at", ["o_totalprice", "latest"], within=30).select("l_orderkey", "l_linenumber", "latest")


ROLES = ("PRESIDENT OF THE UNITED STATES", "VICE PRESIDENT OF THE UNITED STATES", "WHITE HOUSE PRESS SECRETARY", "U.S. SECRETARY OF STATE", "U.S. SENATE MEMBER", "SENATOR (D-CA)", "REP. (R-TX)", "SENATOR, I-VT", "D-CALIF.", "DEMOCRAT (R-XX)", "REPUBLICAN STRATEGIST", "DEMOCRATIC POLLSTER", "BRITISH PRIME MINISTER", "ACTOR", "HOSTAGE NEGOTIATOR", "(D) NEW YORK", "EYEWITNESS", "CHIEF ANALYST", "")


def _roles(spark, d) -> DataFrame:
    """Every customer's role: one of ROLES (null for an empty one) beside the market segment, and a name."""
    k = F.expr("cast(c_custkey % 19 as int)")
    role = F.concat(F.nullif(F.element_at(F.array(*[F.lit(r) for r in ROLES]), k + 1), F.lit("")), F.lit(" "), F.col("c_mktsegment"))
    who = F.when(F.expr("c_custkey % 5 = 0"), F.concat(F.lit("Unidentified Male "), "c_name")).otherwise(F.col("c_name"))
    return _t(spark, d, "customer").select("c_custkey", role.alias("role"), who.alias("who"))


ROLES_SQL = "(SELECT c_custkey, nullif(CASE c_custkey % 19 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(ROLES)) + " END, '') || ' ' || c_mktsegment AS role, CASE WHEN c_custkey % 5 = 0 THEN 'Unidentified Male ' || c_name ELSE c_name END AS who FROM customer)"


@query("first_match_lexicon", f"SELECT c_custkey, {OFFICE_SQL.format(r='role')} AS office FROM {ROLES_SQL}")
def first_match_lexicon(spark, d):
    return _roles(spark, d).select("c_custkey", X.classify_office("role").alias("office"))


@query("regex_party", f"SELECT c_custkey, {PARTY_SQL.format(r='role')} AS party FROM {ROLES_SQL}")
def regex_party(spark, d):
    return _roles(spark, d).select("c_custkey", X.parse_party("role").alias("party"))


@query("role_class", f"SELECT c_custkey, {FLAG_SQL.format(r='role', n='who')} AS flag FROM {ROLES_SQL}")
def role_class(spark, d):
    return _roles(spark, d).select("c_custkey", X.classify_role("role", "who").alias("flag"))


@query("url_slug", r"""
SELECT page_id, regexp_replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '\.html$', '') AS uid,
       nullif(string_split(lower(trim(regexp_replace(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '\.html$', ''))), '.')[1], '') AS show_code FROM pages""")
def url_slug(spark, d):
    uid = X.effective_uid(F.lit(""), "url")
    return _t(spark, d, "pages").select("page_id", uid.alias("uid"), X.show_code(uid).alias("show_code"))


@query("uid_parts", """
WITH u AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || '.' || lpad((c_custkey % 100)::VARCHAR, 2, '0') WHEN 1 THEN c_mktsegment WHEN 2 THEN 'acd.x.' || (c_custkey % 7) ELSE c_mktsegment || '.a' END AS u FROM customer)
SELECT c_custkey, nullif(string_split(lower(u), '.')[1], '') AS show_code, CASE WHEN len(string_split(u, '.')) > 1 AND regexp_matches(string_split(u, '.')[-1], '^[0-9]+$') THEN string_split(u, '.')[-1]::INT END AS segment FROM u""")
def uid_parts(spark, d):
    uid = F.expr("CASE c_custkey % 4 WHEN 0 THEN c_mktsegment || '.' || lpad(cast(c_custkey % 100 as string), 2, '0') WHEN 1 THEN c_mktsegment WHEN 2 THEN 'acd.x.' || (c_custkey % 7) ELSE c_mktsegment || '.a' END")
    return _t(spark, d, "customer").select("c_custkey", X.show_code(uid).alias("show_code"), X.segment_index(uid).alias("segment"))


@query("url_date", """
SELECT o_orderkey, try_cast(CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN year(o_orderdate) || '-02-30' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS day FROM orders""")
def url_date(spark, d):
    url = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'http://x.example/none' WHEN o_orderkey % 5 = 0 THEN 'http://x.example/' || year(o_orderdate) || '.02.30/b' ELSE 'http://x.example/' || date_format(o_orderdate, 'yyyy.MM.dd') || '/a.html' END")
    return _t(spark, d, "orders").select("o_orderkey", X.url_date(url).alias("day"))


TITLED = ("Sen. ", "President ", "Dr. ", "", "Vice President ", "Rep. ", "Mr. Mr. ", "  Gen.  ", "Attorney General ", "Prof. (ret.) ", "Chief Judge ")


@query("normalize_names", "SELECT c_custkey, " + C.normalized("(CASE c_custkey % 11 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TITLED)) + " END || c_name || CASE WHEN c_custkey % 2 = 0 THEN ' (R-AZ), M.D.' ELSE '' END)") + " AS norm FROM customer")
def normalize_names(spark, d):
    name = F.concat(F.element_at(F.array(*[F.lit(t) for t in TITLED]), F.expr("cast(c_custkey % 11 as int) + 1")), "c_name", F.expr("if(c_custkey % 2 = 0, ' (R-AZ), M.D.', '')"))
    return _t(spark, d, "customer").select("c_custkey", X.normalize_name(name).alias("norm"))


@query("normalize_customers", "SELECT c_custkey, " + C.normalized("c_name", 1) + " AS norm FROM customer")
def normalize_customers(spark, d):
    return _t(spark, d, "customer").select("c_custkey", X.normalize_name("c_name").alias("norm"))


#: Mentions by scope: nation; full names of three surnames, and bare surnames.
@query("resolve_mentions", """
WITH m AS (SELECT c_custkey, c_nationkey AS scope, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'p' || (c_custkey % 4) || ' ' END || 'name' || (c_custkey % 7 % 5) AS n FROM customer),
f AS (SELECT scope, string_split(n, ' ')[-1] AS sn, count(DISTINCT n) AS many, min(n) AS one FROM m WHERE contains(n, ' ') GROUP BY 1, 2)
SELECT c_custkey, CASE WHEN contains(n, ' ') THEN n WHEN many = 1 THEN one WHEN many > 1 THEN 'ambiguous:' || n ELSE n END AS canonical_id
FROM m LEFT JOIN f ON m.scope = f.scope AND m.n = f.sn""")
def resolve(spark, d):
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("P"), k % 4, F.lit(" "))), F.lit("NAME"), k % 7 % 5)
    m = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("scope"), name.alias("n"))
    return resolve_mentions(m, "n", ["scope"]).select("c_custkey", "canonical_id")


@query("custom_aliases", """
WITH m AS (SELECT c_custkey, trim(lower('Customer ' || (c_custkey % 9) || ' ' || c_mktsegment)) AS n FROM customer),
a AS (SELECT DISTINCT lower('Customer ' || (c_custkey % 9) || ' ' || c_mktsegment) AS alias, lower(c_mktsegment) || ' house' AS person FROM customer WHERE c_custkey % 9 < 4)
SELECT c_custkey, coalesce(person, n) AS canonical_id FROM m LEFT JOIN a ON n = alias""")
def custom_aliases(spark, d):
    """Names resolved with an alias map of the caller's, read from a file: forms in any case, with notes and blanks around them."""
    c = _t(spark, d, "customer").withColumn("name", F.concat(F.lit("Customer "), F.expr("c_custkey % 9"), F.lit(" "), "c_mktsegment"))
    path = tables.scratch(spark, "aliases")
    rows = c.where("c_custkey % 9 < 4").select(F.concat(F.lit(" "), F.upper("name"), F.lit(" ")).alias("surface"), F.concat(F.initcap("c_mktsegment"), F.lit(" House")).alias("person")).distinct()
    rows.write.csv(path, header=True)
    return resolve_mentions(c, "name", aliases=read_aliases(spark, path)).select("c_custkey", "canonical_id")


@query("word_list", """
WITH b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)
SELECT doc_id, count(*) AS n_listed FROM w JOIN b USING (word) GROUP BY 1""")
def word_list(spark, d):
    """Words of a list read from a file (all words of the benchmark, some in capitals, with notes), counted per document."""
    words = lambda t: F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")
    path = tables.scratch(spark, "words")
    listed = _t(spark, d, "benchmark").select(words("text")).distinct().select(F.when(F.length("word") % 2 == 0, F.concat(F.lit("  "), F.upper("word"))).otherwise(F.concat("word", F.lit(" "))).alias("value"))
    listed.unionByName(spark.createDataFrame([("# a note",), ("",), ("   ",)], "value string")).write.text(path)
    return _t(spark, d, "documents").select("doc_id", words("text")).join(G.read_word_list(spark, path), "word").groupBy("doc_id").agg(F.count("*").alias("n_listed"))


def refused(df: DataFrame) -> str:
    """What Spark says when it refuses to run df; an empty text if it does not."""
    try:
        df.write.format("noop").mode("overwrite").save()
    except Exception as e:  # noqa: BLE001
        found = re.search(r"counts must be non-negative|schema violation: [a-z_,]+|is before the corpus start", str(e))
        return found[0] if found else "another error"
    return ""


@query("refusals", """
SELECT 'negative counts' AS what, CASE WHEN count(*) FILTER (l_orderkey - 1000 < 0) > 0 THEN 'counts must be non-negative' ELSE '' END AS said FROM lineitem
UNION ALL SELECT 'no negative counts', '' UNION ALL
SELECT 'violations', CASE WHEN count(*) FILTER (l_orderkey - 1000 < 0 AND l_suppkey % 9 <> 0) > 0 THEN 'schema violation: wordcount_negative' ELSE '' END FROM lineitem
UNION ALL SELECT 'no violations', '' UNION ALL
SELECT 'early days', CASE WHEN count(*) FILTER (o_orderdate < DATE '2000-01-01') > 0 THEN 'is before the corpus start' ELSE '' END FROM orders
UNION ALL SELECT 'early days, lenient', ''""")
def refusals(spark, d):
    """What is refused, and that the same rows pass without what is wrong with them: each check runs over its whole table."""
    li = _t(spark, d, "lineitem").select(F.year("l_shipdate").alias("year"), F.col("l_suppkey").alias("e"), (F.col("l_orderkey") - 1000).alias("c"))
    text = F.when(F.col("l_suppkey") % 9 == 0, "x").otherwise((F.col("l_orderkey") - 1000).cast("string"))
    raw = lambda w: _t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("url"), *[F.lit("1").alias(c) for c in ("year", "month", "date")], w.alias("wordcount"))
    day = _t(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))
    said = {
        "negative counts": refused(concentration_of_counts(li, ["year"], "e")),
        "no negative counts": refused(concentration_of_counts(li.withColumn("c", F.abs("c")), ["year"], "e")),
        "violations": refused(G.validate(raw(text))),
        "no violations": refused(G.validate(raw(F.when(~text.startswith("-"), text)))),
        "early days": refused(day.select(X.era_of("day"))),
        "early days, lenient": refused(day.select(X.era_of("day", strict=False))),
    }
    return spark.createDataFrame(list(said.items()), "what string, said string")


def _deterministic_model():
    """A stand-in for a language model: a sentence's first two capitalized words, if `said` follows them at once."""
    pattern = re.compile(r"(?:^|(?<=[.!?] ))([A-Z][a-z]+ [A-Z][a-z]+) said\b")

    def extract(text: str) -> list[dict]:
        ends = [m.end() for m in re.finditer(r"[.!?] ", text)]
        return [{"sentence_index": sum(e <= m.start() for e in ends), "char_start": m.start(1), "char_end": m.end(1), "source_span": m[1], "entity_type": "PERSON", "cue_verb": "say", "pattern_id": "subj_cue", "sentence_text": m[0]} for m in pattern.finditer(text)]

    return extract


@query("attributions_by_model", C.within("WITH " + C.SEGMENTS) + r""",
m AS (SELECT seg_id, string_split_regex(text, '[.!?] [A-Z][a-z]+ [A-Z][a-z]+ said\b') AS g, regexp_extract_all(text, '[.!?] ([A-Z][a-z]+ [A-Z][a-z]+) said\b') AS r0, regexp_extract_all(text, '[.!?] ([A-Z][a-z]+ [A-Z][a-z]+) said\b', 1) AS r1 FROM corpus)
SELECT seg_id, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(r0[1:i - 1], lambda x: length(x))), 0) + 2)::INT AS char_start, r1[i] AS source_span, 'say' AS cue_verb FROM m, unnest(range(1, len(r0) + 1)) AS u(i)""")
def attributions_by_model(spark, d):
    """The model hook over all segments, with a model that is a fixed rule, so that SQL can tell what it finds."""
    return extract_with_model(_keep(spark, d), "seg_id", "text", _deterministic_model).select("seg_id", "char_start", "source_span", "cue_verb")


# --- the corpus of labelled segments, through the stages from a scanned row to the yearly tables ---


def _segments(spark, d) -> DataFrame:
    return G.validate(C.raw_segments(spark, d))


def _keep(spark, d) -> DataFrame:
    """Segments under their number, for rows to be told apart."""
    return C.raw_segments(spark, d).select("seg_id", "text")


WITH_SEGMENTS = "WITH " + C.within(C.SEGMENTS)
HOST_SQL = "CASE show_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.SHOW_HOSTS.items()) + " END"


@query("provenance", WITH_SEGMENTS + f" SELECT url, uid, show_code, {HOST_SQL} AS host, air_date, era_id, year, 'Evening' AS headline, length(text) AS n FROM corpus")
def provenance(spark, d):
    return P.provenance(_segments(spark, d)).select("url", "uid", "show_code", "host", "air_date", "era_id", "year", "headline", F.length("text").cast("bigint").alias("n"))


@query("segment_coverage", WITH_SEGMENTS + " SELECT year, count(*) AS n_segments FROM corpus WHERE year IS NOT NULL GROUP BY 1")
def segment_coverage(spark, d):
    return S.coverage(P.provenance(_segments(spark, d)))


@query("between_days", C.within("WITH " + C.SEGMENTS, "WHERE air_date BETWEEN DATE '2004-03-01' AND DATE '2013-08-31'") + " SELECT url, air_date FROM corpus")
def between_days(spark, d):
    return P.provenance(P.between_days(_segments(spark, d), "2004-03-01", "2013-08-31")).select("url", "air_date")


TURNS_SQL, WHO_SQL, CITED_SQL = (C.within(x) for x in (C.TURNS, C.WHO, C.CITED))


@query("parse_turns", TURNS_SQL + " SELECT seg_id, turn_index, char_start, char_end, speaker_raw, role_raw, name_norm, staff_flag FROM turns")
def turns_parsed(spark, d):
    return parse_turns(_keep(spark, d)).drop("source_mode")


@query("clip_mode", TURNS_SQL + " SELECT seg_id, turn_index, source_mode FROM turns")
def clip_mode(spark, d):
    return parse_turns(_keep(spark, d)).select("seg_id", "turn_index", "source_mode")


_KINDS = f"regexp_extract_all(text, '{L.CLIP_MARKER}', 1)"


@query("clip_spans", WITH_SEGMENTS + f" SELECT seg_id, len(list_filter(range(1, len({_KINDS}) + 1), lambda i: {_KINDS}[i] = 'BEGIN' AND coalesce({_KINDS}[i + 1], 'END') = 'END'))::INT AS n_spans FROM corpus")
def spans(spark, d):
    return _keep(spark, d).select("seg_id", F.size(clip_spans("text")).alias("n_spans"))


@query("turn_roster", TURNS_SQL + " SELECT name_norm, staff_flag, count(*) AS n FROM turns GROUP BY 1, 2")
def turn_roster(spark, d):
    return parse_turns(_keep(spark, d)).groupBy("name_norm", "staff_flag").agg(F.count("*").alias("n"))


@query("names_on_air", TURNS_SQL + " SELECT seg_id, string_agg(DISTINCT name_norm, ',' ORDER BY name_norm) AS names FROM turns GROUP BY 1")
def on_air(spark, d):
    return _keep(spark, d).select("seg_id", F.array_join(F.array_sort(names_on_air("text")), ",").alias("names")).where("names <> ''")


@query("build_turns", WHO_SQL + " SELECT url, turn_index, char_start, char_end, speaker_raw, name_norm, staff_flag, source_mode, canonical_id, office, party, is_president, air_date FROM who JOIN (SELECT seg_id, url FROM corpus) USING (seg_id)")
def built_turns(spark, d):
    return P.build_turns(_segments(spark, d)).select("url", "turn_index", "char_start", "char_end", "speaker_raw", "name_norm", "staff_flag", "source_mode", "canonical_id", "office", "party", "is_president", "air_date")


def _table_files(spark) -> dict[str, DataFrame]:
    """Eras, presidents and offices as files that are read at run time."""
    path = tables.scratch(spark, "lookup")
    spark.createDataFrame(list(L.ERAS), "era_id string, first date").write.csv(f"{path}/eras", header=True)
    _presidents(spark).write.csv(f"{path}/presidents", header=True)
    spark.createDataFrame(list(L.OFFICES), "keyword string, office string").coalesce(1).write.csv(f"{path}/offices", header=True)
    return {
        "eras": spark.read.csv(f"{path}/eras", header=True, schema="era_id string, first date"),
        "presidents": spark.read.csv(f"{path}/presidents", header=True, schema="ord int, person string, first date, after date"),
        "offices": G.read_lexicon(spark, f"{path}/offices", ["keyword", "office"]),
    }


@query("build_turns_tables", WHO_SQL + " SELECT url, turn_index, canonical_id, office, party, is_president, era_id FROM who JOIN (SELECT seg_id, url, era_id FROM corpus) USING (seg_id)")
def built_turns_by_tables(spark, d):
    """build_turns with eras, presidents and offices from tables."""
    return P.build_turns(_segments(spark, d), **_table_files(spark)).select("url", "turn_index", "canonical_id", "office", "party", "is_president", "era_id")


def _speakers_sql(flags: str, mode: str, base: str = "") -> str:
    where = f"staff_flag IN ({flags}) AND year IS NOT NULL AND canonical_id <> '' AND NOT starts_with(canonical_id, 'ambiguous:')" + (f" AND source_mode = '{mode}'" if mode else "")
    label = ("external" if flags == "'guest'" else "all") + (f"-{mode}" if mode else "")
    counts = (base or WHO_SQL).strip() + f" SELECT year, canonical_id AS e, count(*) AS c FROM who WHERE {where} GROUP BY 1, 2"
    return f"SELECT year, 'speakers' AS measure, '{label}' AS variant, * EXCLUDE (year) FROM ({_metrics_sql(counts, 'year')})"


def _cited_sql(kind: str, base: str = "") -> str:
    counts = (base or CITED_SQL).strip() + f" SELECT year, canonical_id AS e, count(DISTINCT url) AS c FROM cited WHERE entity_type = '{kind}' AND year IS NOT NULL AND canonical_id <> '' AND NOT starts_with(canonical_id, 'ambiguous:') GROUP BY 1, 2"
    return f"SELECT year, 'attributions' AS measure, '{kind.lower()}' AS variant, * EXCLUDE (year) FROM ({_metrics_sql(counts, 'year')})"


def _speakers(variant: str, mode: str):
    return lambda spark, d: _round(P.annual_hhi_speakers(P.count_turns(_segments(spark, d)), variant, mode), *RATIOS)


for _variant, _flags in (("external", "'guest'"), ("all", "'guest', 'staff'")):
    for _mode in ("all", "live", "clip"):
        query(f"annual_speakers_{_variant}_{_mode}", _speakers_sql(_flags, "" if _mode == "all" else _mode))(_speakers(_variant, _mode))


@query("build_attributions", CITED_SQL + " SELECT url, source_span, char_start, char_start + length(source_span)::INT AS char_end, cue_verb, pattern_id, sentence_index, entity_type, canonical_id, year FROM cited")
def built_attributions(spark, d):
    return P.build_attributions(_segments(spark, d)).select("url", "source_span", "char_start", "char_end", "cue_verb", "pattern_id", "sentence_index", "entity_type", "canonical_id", "year")


@query("annual_attributions_person", _cited_sql("PERSON"))
def annual_attributions_person(spark, d):
    return _round(P.annual_hhi_attributions(P.build_attributions(_segments(spark, d))), *RATIOS)


@query("annual_attributions_org", _cited_sql("ORG"))
def annual_attributions_org(spark, d):
    return _round(P.annual_hhi_attributions(P.build_attributions(_segments(spark, d)), "ORG"), *RATIOS)


def _all_sql(where: str = "") -> str:
    who, cited = C.within(C.WHO, where), C.within(C.CITED, where)
    parts = [_speakers_sql("'guest'", "", who), _speakers_sql("'guest', 'staff'", "", who), _cited_sql("PERSON", cited), _cited_sql("ORG", cited)]
    return " UNION ALL ".join(f"SELECT * FROM ({x})" for x in parts)


@query("annual_series_union", _all_sql())
def annual_series_union(spark, d):
    s = _segments(spark, d)
    return _round(P.annual_all(P.count_turns(s), P.build_attributions(s)), *RATIOS)


@query("pilot_series", _all_sql("WHERE air_date BETWEEN DATE '2006-01-01' AND DATE '2016-06-30'"))
def pilot_series(spark, d):
    return _round(P.pilot(_segments(spark, d), "2006-01-01", "2016-06-30")["series"], *RATIOS)


#: Guest turns by mode, each also under `all`.
AGG_SQL = WHO_SQL + """,
own AS (SELECT year, source_mode AS m, canonical_id, is_president, office, coalesce(party, 'none') AS party FROM who WHERE staff_flag = 'guest' AND year IS NOT NULL AND canonical_id <> '' AND NOT starts_with(canonical_id, 'ambiguous:')),
agg AS (SELECT year, m AS mode, canonical_id, is_president, office, party FROM own UNION ALL SELECT year, 'all', canonical_id, is_president, office, party FROM own)"""


@query("trend_hhi", "SELECT *, 'external-' || mode AS variant FROM (" + _metrics_sql(AGG_SQL.strip() + " SELECT year, mode, canonical_id AS e, count(*) AS c FROM agg GROUP BY 1, 2, 3", "year, mode") + ")")
def trend_hhi(spark, d):
    return _round(P.trend_tables(P.count_turns(_segments(spark, d)))["hhi"], *RATIOS)


@query("trend_top_sources", AGG_SQL + """, c AS (SELECT mode, year, canonical_id, count(*) AS c FROM agg GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY mode, year ORDER BY c DESC, canonical_id) AS rk, sum(c) OVER (PARTITION BY mode, year) AS s FROM c)
SELECT mode, year, rk::INT AS "rank", canonical_id, c AS n_turns, round(c / s::DOUBLE, 9) AS share FROM r WHERE rk <= 15""")
def trend_top_sources(spark, d):
    return _round(P.trend_tables(P.count_turns(_segments(spark, d)))["top_sources"], "share")


_SHARE = lambda c: f"count(*) FILTER ({c}) / count(*)::DOUBLE"
_OFFICES = sorted({o for _, o in L.OFFICES})


@query("office_share", AGG_SQL + f" SELECT mode, year, count(*) AS n_guest_turns, round(1 - {_SHARE(chr(34) + 'office' + chr(34) + chr(32) + '= ' + chr(39) * 2)}, 9) AS office_coverage, round({_SHARE('office IN (' + ', '.join(chr(39) + o + chr(39) for o in L.EXECUTIVE) + ')')}, 9) AS executive_share, " + ", ".join(f"round(nullif({_SHARE(f'office = {chr(39)}{o}{chr(39)}')}, 0), 9) AS {o}_share" for o in _OFFICES) + " FROM agg GROUP BY 1, 2")
def office_share(spark, d):
    return _round(P.trend_tables(P.count_turns(_segments(spark, d)))["office_share"], "office_coverage", "executive_share", *[f"{o}_share" for o in _OFFICES])


@query("party_share", AGG_SQL + " SELECT mode, year, count(*) AS n_guest_turns, " + ", ".join(f"round({_SHARE(f'party = {chr(39)}{p}{chr(39)}')}, 9) AS {p}_share" for p in "RDI") + f", round(1 - {_SHARE(f'party = {chr(39)}none{chr(39)}')}, 9) AS party_coverage FROM agg GROUP BY 1, 2")
def party_share(spark, d):
    return _round(P.trend_tables(P.count_turns(_segments(spark, d)))["party_share"], "R_share", "D_share", "I_share", "party_coverage")


@query("president_share", AGG_SQL + """, wp AS (SELECT mode, year, canonical_id, count(*) AS c FROM agg WHERE is_president GROUP BY 1, 2, 3),
pr AS (SELECT mode, year, max(struct_pack(c := c, i := canonical_id)).i AS president_id FROM wp GROUP BY 1, 2)
SELECT agg.mode, agg.year, count(*) FILTER (is_president) AS n_president_turns, count(*) AS n_guest_turns, any_value(president_id) AS president_id, round(count(*) FILTER (is_president) / count(*)::DOUBLE, 9) AS president_share
FROM agg LEFT JOIN pr ON agg.mode = pr.mode AND agg.year = pr.year GROUP BY 1, 2""")
def president_share(spark, d):
    return _round(P.trend_tables(P.count_turns(_segments(spark, d)))["president_share"], "president_share")


@query("csv_scan", WITH_SEGMENTS + " SELECT url, year, length(text) AS n FROM corpus")
def csv_scan(spark, d):
    """Segments written as compressed CSV in the scratch folder and scanned from there."""
    return P.provenance(G.validate(G.read_csv(spark, _as_csv(spark, d, _files(spark, d))))).select("url", "year", F.length("text").cast("bigint").alias("n"))


def _files(spark, d) -> int:
    """How many files the segments go to: a file is one task's work, so it holds some 1,000 segments, however many there are."""
    return max(3, -(-_t(spark, d, "conversations").select("conv_id").distinct().count() // 1000))


def _as_csv(spark, d, files: int) -> str:
    path = tables.scratch(spark, "segments")
    names = {G.internal(c): c for c in G.RAW}
    raw = C.raw_segments(spark, d).repartition(files, "seg_id").select(*[F.col(k).alias(v) for k, v in names.items()])
    raw.write.csv(path, header=True, quote='"', escape='"', compression="gzip")
    return f"{path}/*.csv.gz"


@query("incremental_series", _speakers_sql("'guest'", ""))
def incremental_series(spark, d):
    """The yearly series from kept counts: first over some files and one that goes later, then over the whole set of files."""
    path, state = tables.scratch(spark, "files"), tables.scratch(spark, "state")
    names = {G.internal(c): c for c in G.RAW}
    raw, old = C.raw_segments(spark, d), F.pmod(F.col("seg_id"), F.lit(3))
    for folder, rows in (("stale", raw.where(old == 1).withColumn("text", F.concat(F.lit("JOHN STALE, GUEST: "), "text"))), ("a", raw.where(old == 0)), ("b", raw.where(old > 0))):
        rows.repartition(max(2, _files(spark, d) // 3), "seg_id").select(*[F.col(k).alias(v) for k, v in names.items()]).write.csv(f"{path}/{folder}", header=True, quote='"', escape='"')
    I.update(spark, state, f"{path}/{{stale,a}}/*.csv")
    I.update(spark, state, f"{path}/{{a,b}}/*.csv")
    return _round(P.annual_hhi_speakers(I.turns(spark, state)), *RATIOS)


@query("stream_turns", WHO_SQL + " SELECT year, source_mode AS mode, CASE n WHEN 'jane doe' THEN 'doe, jane' ELSE n END AS canonical_id, count(*) AS n FROM who WHERE staff_flag = 'guest' AND year IS NOT NULL GROUP BY 1, 2, 3")
def stream_turns(spark, d):
    """The counts of a stream over the segment files, a third of them at a time, once all are read."""
    from ..streaming import turn_counts as T

    files = _files(spark, d)
    names = spark.createDataFrame([("jane doe", "doe, jane")], "name string, canonical_id string")
    return T.run_available(T.count_turns(T.read_stream(spark, _as_csv(spark, d, files), -(-files // 3)), names))


@query("stream_resolved", WHO_SQL + " SELECT year, source_mode AS mode, canonical_id, count(*) AS n FROM who WHERE staff_flag = 'guest' AND year IS NOT NULL AND canonical_id <> '' GROUP BY 1, 2, 3")
def stream_resolved(spark, d):
    """A stream over the segment files, a third of them at a time, with surnames resolved by what has come so far and corrected
    later."""
    from ..streaming import resolved_counts as R
    from ..streaming import turn_counts as T

    files = _files(spark, d)
    return R.run_available(T.read_stream(spark, _as_csv(spark, d, files), -(-files // 3)))


@query("series_round_trip", "SELECT year, measure, variant, hhi, n_distinct, n_events FROM (" + _speakers_sql("'guest'", "") + ")")
def series_round_trip(spark, d):
    """The series written as one sorted CSV and read again."""
    path = tables.scratch(spark, "series")
    G.write_csv(P.annual_hhi_speakers(P.count_turns(_segments(spark, d))), path, ["year"])
    return _round(G.read_series(spark, path), "hhi").select("year", "measure", "variant", "hhi", "n_distinct", "n_events")


@query("turns_by_year_files", WHO_SQL + " SELECT year, count(*) AS n FROM who WHERE year IS NOT NULL GROUP BY 1")
def turns_by_year_files(spark, d):
    """Turns written as Parquet by year; the year comes back from the folders' names."""
    path = tables.scratch(spark, "turns")
    G.write_parquet(P.build_turns(_segments(spark, d)).where("year is not null"), path, ["year"])
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"))


@query("lexicon_scan", f"SELECT c_custkey, {OFFICE_SQL.format(r='role')} AS office FROM {ROLES_SQL}")
def lexicon_scan(spark, d):
    """Offices by a lexicon scanned from a file with comments: the first keyword in file order that a role holds."""
    path = tables.scratch(spark, "lexicon")
    lines = ["# keyword and office", "keyword,office", *[f" {w.upper()} , {o}" for w, o in L.OFFICES]]
    spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.text(path)
    words = G.read_lexicon(spark, path, ["keyword", "office"])
    hit = first_match(_roles(spark, d), "role", words, "keyword", out="ord")
    return hit.join(words.select("ord", "office"), "ord", "left").select("c_custkey", F.coalesce("office", F.lit("")).alias("office"))


@query("lexicon_terms", r"""
WITH dw AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
w AS (SELECT DISTINCT w FROM dw WHERE length(w) >= 8),
lex AS (SELECT w AS keyword, row_number() OVER (ORDER BY md5(w)) - 1 AS ord FROM w WHERE length(w) = 8),
hit AS (SELECT w, min(struct_pack(ord := ord, keyword := keyword)) AS h FROM (SELECT w, substring(w, i, 8) AS s FROM w, unnest(range(1, length(w) - 6)) AS u(i)) JOIN lex ON s = keyword GROUP BY 1),
best AS (SELECT doc_id, min(h) AS h FROM dw JOIN hit USING (w) GROUP BY 1)
SELECT doc_id, h.ord AS ord, h.keyword AS keyword FROM documents LEFT JOIN best USING (doc_id)""")
def lexicon_terms(spark, d):
    """A lexicon of all words of eight letters (in the order of a digest): the first of them that a document holds, in a word or
    across words."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    seen = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("keyword")).where("length(keyword) = 8").distinct()
    path = tables.scratch(spark, "lexicon")
    seen.repartition(1).sortWithinPartitions(F.md5("keyword")).write.csv(path, header=True)
    words = G.read_lexicon(spark, path, ["keyword"])
    return first_match(docs, "text", words, "keyword", out="ord").join(words, "ord", "left").select("doc_id", "ord", "keyword")


@query("stratified_sample_counts", "SELECT lang, least(count(*), 50) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1")
def stratified_sample_counts(spark, d):
    return stratified_sample(_t(spark, d, "documents").select("doc_id", "lang"), ["lang"], 50, "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query("stratified_sample_rows", """
SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7:' || doc_id), doc_id) AS r FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL) WHERE r <= 5""")
def stratified_sample_rows(spark, d):
    return stratified_sample(_t(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 5, "doc_id", 7)


@query("yearly_sample", """
SELECT o_orderkey, year FROM (SELECT o_orderkey, year(o_orderdate)::INT AS year, row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY md5('20250611:' || o_orderkey), o_orderkey) AS r FROM orders) WHERE r <= 500""")
def yearly(spark, d):
    return yearly_sample(_orders(spark, d).select("o_orderkey", "year"), key="o_orderkey")


@query("prf_scores", """
WITH c AS (SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn FROM labels)
SELECT round(tp / (tp + fp)::DOUBLE, 9) AS "precision", round(tp / (tp + fn)::DOUBLE, 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""")
def prf_scores(spark, d):
    n = lambda c: F.count_if(F.expr(c))
    c = _t(spark, d, "labels").agg(n("quality = 0 and toxic = 1").alias("tp"), n("quality = 1 and toxic = 1").alias("fp"), n("quality = 0 and toxic = 0").alias("fn"))
    return _round(c.select(X.prf("tp", "fp", "fn").alias("s")).select("s.*"), "precision", "recall", "f1")


def _bootstrap_sql(rows: str, by: str, draws: int) -> str:
    """lo and hi of the mean of x over resamples of rows (by, x, key)."""
    times = " + ".join(f"(u >= {limit})::INT" for limit in U.POISSON_LIMITS)
    return f"""WITH r AS ({rows}), d AS (SELECT {by}, x, {D.base_sql("'0|' || key")} AS b, i AS draw FROM r, range({draws}) AS t(i)),
u AS (SELECT *, {D.uniform_sql('b', 'draw')} AS u FROM d), w AS (SELECT {by}, draw, sum(w) AS n, sum(w * x) AS s FROM (SELECT *, {times} AS w FROM u) GROUP BY ALL)
SELECT {by}, round(quantile_cont(s / n, 0.025), 6) AS lo, round(quantile_cont(s / n, 0.975), 6) AS hi FROM w WHERE n > 0 GROUP BY ALL"""


@query("bootstrap_ci", _bootstrap_sql(f"SELECT 'orders' AS k, hhi AS x, 'orders|' || year AS key FROM ({_metrics_sql(ORDERS_BY_YEAR, 'year')})", "k", 1000))
def bootstrap_ci(spark, d):
    year = concentration(_orders(spark, d), ["year"], "o_custkey").select("year", F.round("hhi", 9).alias("hhi"), F.lit("orders").alias("k"))
    return _round(U.bootstrap_ci(year, ["k"], "hhi", ["year"]), "lo", "hi", digits=6)


@query("bootstrap_prices", _bootstrap_sql("SELECT o_orderpriority, o_totalprice AS x, o_orderpriority || '|' || o_orderkey AS key FROM orders", "o_orderpriority", 200))
def bootstrap_prices(spark, d):
    """The mean price per priority, resampled over all orders."""
    return _round(U.bootstrap_ci(_t(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", ["o_orderkey"], 200), "lo", "hi", digits=6)


def _simulate_sql(counts: str, by: str, recall: float, precision: float, draws: int) -> str:
    """The error-adjusted HHI of counts (by, e, c): the distribution of a true count as a sum over how many events are true."""
    lam = (1 - recall) / recall
    return f"""WITH c AS MATERIALIZED ({counts}), n AS (SELECT DISTINCT c FROM c),
k AS (SELECT c, k, exp(lgamma(c + 1) - lgamma(k + 1) - lgamma(c - k + 1) + k * ln({precision}) + (c - k) * ln({1 - precision})) AS w FROM n, unnest(range(0, c + 1)) AS u(k)),
p AS (SELECT c, k + m AS t, sum(w * CASE WHEN k = 0 THEN (m = 0)::INT ELSE exp(m * ln(k * {lam}) - k * {lam} - lgamma(m + 1)) END) AS p FROM k, unnest(range(0, 3 * c + 60)) AS u(m) GROUP BY 1, 2),
q AS (SELECT c, t, sum(p) OVER (PARTITION BY c ORDER BY t) / sum(p) OVER (PARTITION BY c) AS upto FROM p),
v AS MATERIALIZED (SELECT c, i, min(t) AS t FROM (SELECT c, t, coalesce(lag(upto) OVER (PARTITION BY c ORDER BY t), 0) AS since, upto FROM q) AS q, unnest(range(ceil(since * {U.VALUES} - 0.5)::BIGINT, least({U.VALUES}, ceil(upto * {U.VALUES} - 0.5)::BIGINT + 1))) AS u(i) WHERE upto >= (i + 0.5) / {U.VALUES} GROUP BY 1, 2),
d AS (SELECT {by}, c, {D.base_sql(f"'0|' || {by} || '|' || e")} AS b, i AS draw FROM c, range({draws}) AS t(i)),
s AS (SELECT {by}, draw, sum(t)::DOUBLE AS one, sum(t * t)::DOUBLE AS two FROM (SELECT {by}, c, draw, {D.uniform_sql('b', 'draw')} // {D.SIZE // U.VALUES} AS i FROM d) JOIN v USING (c, i) GROUP BY 1, 2),
h AS (SELECT {by}, two / (one * one) AS h FROM s WHERE one > 0)
SELECT {by}, round(quantile_cont(h, 0.5), 9) AS median, round(quantile_cont(h, 0.025), 9) AS lo, round(quantile_cont(h, 0.975), 9) AS hi FROM h GROUP BY 1"""


@query("simulate_hhi_ci", _simulate_sql(ORDERS_BY_YEAR, "year", 0.7, 0.9, 1000))
def simulate_hhi_ci(spark, d):
    ends = U.simulate_hhi_ci(market_counts(_orders(spark, d), ["year"], "o_custkey"), ["year"], "o_custkey", 0.7, 0.9)
    return _round(ends, "median", "lo", "hi")


_PARTS = ("year(l_shipdate) + CASE WHEN l_linenumber = 7 THEN 1000 ELSE 0 END", "l_linenumber * 2", "l_suppkey % 40", "l_orderkey - 1000")


def _dirty(spark, d) -> DataFrame:
    """Order lines as scanned rows: numbers as text, some out of range, some unreadable, with blanks around them."""
    text = [F.concat(F.lit(" "), F.expr(p).cast("string"), F.when(F.expr("l_suppkey % 9 = 0"), "x").otherwise(" ")).alias(n) for p, n in zip(_PARTS, ("year", "month", "date", "wordcount"))]
    return G.coerce(_t(spark, d, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("url"), *text))


def _coerced_sql() -> str:
    whole = lambda p, lo, hi: f"CASE WHEN l_suppkey % 9 <> 0 AND {p} BETWEEN {lo} AND {hi} THEN ({p})::INT END"
    ranges = [f"{whole(p, *G.RANGES[n])} AS {n}" for p, n in zip(_PARTS, ("year", "month", "date"))]
    return f"SELECT l_orderkey || '-' || l_linenumber AS url, {', '.join(ranges)}, CASE WHEN l_suppkey % 9 <> 0 THEN ({_PARTS[3]})::BIGINT END AS wordcount FROM lineitem"


@query("coerce_schema", _coerced_sql())
def coerce_schema(spark, d):
    return _dirty(spark, d)


@query("quarantine", f"SELECT url, 'wordcount_negative' AS violations FROM ({_coerced_sql()}) WHERE wordcount < 0")
def quarantine(spark, d):
    return G.quarantine(_dirty(spark, d))[1].select("url", F.array_join("violations", ",").alias("violations"))


@query("face_validity", CITED_SQL + f""", c AS (SELECT year, canonical_id, count(*) AS c FROM cited WHERE entity_type = 'PERSON' AND year IS NOT NULL GROUP BY 1, 2),
t AS (SELECT year, canonical_id FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY c DESC, canonical_id) AS rk FROM c) WHERE rk <= 2),
y AS (SELECT year, {PRES_SQL.format(d='make_date(year, 7, 1)')} AS expected, list(canonical_id) AS l, string_agg(canonical_id, ',' ORDER BY canonical_id) AS top FROM t WHERE year BETWEEN 2001 AND 2025 GROUP BY 1)
SELECT year, expected, list_contains(l, expected) AS ok, top FROM y""")
def face_validity(spark, d):
    cited = P.build_attributions(_segments(spark, d))
    return S.face_validity(cited, P.expected_presidents(cited), 2)


#: The two tables are the same file at every scale.
_FILES = "'/root/testdata/sf0.01/region.parquet', '/root/testdata/sf0.01/nation.parquet'"


@query("manifest", f"SELECT string_split(filename, '/')[-1] AS filename, size, sha256(content) AS sha256 FROM read_blob([{_FILES}])")
def manifest(spark, d):
    return G.manifest(spark, d, "{region,nation}.parquet")
