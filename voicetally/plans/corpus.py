"""A corpus of raw segments made of `conversations` alike in Spark and in SQL, and the SQL of what the stages make of it.

Each turn gets a label (people with offices and parties, two of one surname, aliases, a president), every third stands in
clip markers that some segments leave open or repeat, and most turns credit a source. Segments have urls, some no uid, and
some impossible dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import clauses as A

LABELS = (
    "ANN COOPER, CNN HOST", "SENATOR JANE DOE, (D-NY)", "COOPER", "UNIDENTIFIED MALE", "BARACK OBAMA, PRESIDENT OF THE UNITED STATES",
    "JOHN SMITH, REPUBLICAN STRATEGIST", "MARY SMITH, GOVERNOR (I-ME)", "SMITH", "GEORGE BUSH, U.S. HOUSE CANDIDATE",
)
CITES = (". Joe Biden said the plan works.", ". According to Barack Obama, reform is needed.", '. "It works," said Hillary Clinton today.', ". The White House said it would respond.", ". John Smith said no.", ". George Bush was also asked.", ". Joe Biden and Barack Obama say so.", '. "No," said White House spokesman Jay Carney.', ". Mary Smith of Maine was accused by George Bush.", ". The Department of State, which knew it, has not responded.", ". In Washington, Sen. John McCain later warned of it. It was Smith's idea.")
SHOWS = ("acd", "lkl", "tsr", "xyz")


def _at(values, i: str):
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.expr(f"cast({i} as int) + 1"))


def raw_segments(spark: SparkSession, d: str) -> DataFrame:
    """The columns of a scanned file, all as text, and seg_id."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    clip = F.expr("turn % 3 = 1")
    end = F.when(clip & F.expr("conv_id % 7 <> 0"), " (END VIDEO CLIP)").otherwise("")
    line = F.concat(F.when(clip, "(BEGIN VIDEO CLIP) ").otherwise(""), _at(LABELS, "(2 * conv_id + turn) % 9"), F.lit(": "), "text", _at(CITES, f"(conv_id + 2 * turn) % {len(CITES)}"), end)
    # dealt out by number, so that small tables are parsed by all cores too
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = c.select("conv_id", "turn", line.alias("line")).repartition(parts, "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("q"))
    year = F.expr("if(conv_id % 13 = 5, 3007, 2000 + conv_id % 26)").cast("string")
    month, day = F.expr("1 + conv_id % 12").cast("string"), F.expr("if(conv_id % 11 = 3, 31, 1 + conv_id % 28)").cast("string")
    uid = F.concat(_at(SHOWS, "conv_id % 4"), F.lit("."), F.expr("lpad(cast(conv_id % 7 as string), 2, '0')"))
    url = F.concat(F.lit("http://x.example/"), year, F.lit("."), F.lpad(month, 2, "0"), F.lit("."), F.lpad(day, 2, "0"), F.lit("/"), uid, F.lit(".html"))
    empty = F.lit("")
    return s.select(
        F.col("conv_id").alias("seg_id"), url.alias("url"), F.lit("NET").alias("channel_name"), F.lit("Evening").alias("program_name"), F.when(F.expr("conv_id % 3 = 0"), "").otherwise(uid).alias("uid"), empty.alias("duration"),
        year.alias("year"), month.alias("month"), day.alias("date"), F.lit("20:00").alias("time"), F.lit("ET").alias("timezone"), F.lit("p").alias("path"), F.expr("if(conv_id % 10 = 7, '', cast(conv_id as string))").alias("wordcount"), F.lit("News").alias("subhead"),
        F.array_join(F.transform("q", lambda x: x["line"]), "\n").alias("text"),
    )


def quoted(x: str) -> str:
    return x.replace("'", "''")


def _pick(values, i: str) -> str:
    return f"CASE {i} " + " ".join(f"WHEN {k} THEN '{quoted(v)}'" for k, v in enumerate(values)) + " END"


PRES = "CASE " + " ".join(f"WHEN {{d}} >= DATE '{a}'" + (f" AND {{d}} < DATE '{z}'" if z else "") + f" THEN '{w}'" for w, _, a, z in L.PRESIDENTS) + " END"
ERA = "CASE " + " ".join(f"WHEN {{d}} >= DATE '{a}' THEN '{e}'" for e, a in reversed(L.ERAS)) + " END"
OFFICE = "CASE " + " ".join(f"WHEN contains(lower(coalesce({{r}}, '')), '{w}') THEN '{o}'" for w, o in L.OFFICES) + " ELSE '' END"
PARTY = "CASE WHEN regexp_matches(coalesce({r}, ''), '(?i)(?:^|[\\s(])([rdi])-[a-z]{{2,}}') THEN upper(regexp_extract({r}, '(?i)(?:^|[\\s(])([rdi])-[a-z]{{2,}}', 1)) " + " ".join(f"WHEN contains(lower(coalesce({{r}}, '')), '{w}') THEN '{p}'" for w, p in L.PARTY_WORDS) + " END"
NONPERSON = "(" + " OR ".join(f"lower(trim({{n}})) = '{t}' OR starts_with(lower(trim({{n}})), '{t} ')" for t in L.NONPERSON) + ")"
FLAG = "CASE WHEN " + NONPERSON + " THEN 'nonperson' WHEN coalesce({r}, '') = '' THEN 'unknown' WHEN " + " OR ".join(f"contains(lower({{r}}), '{w}')" for w in L.STAFF_WORDS) + " THEN 'staff' ELSE 'guest' END"
_ONE_TITLE = "^(?:(?:" + "|".join(L.TITLES_TWO_WORDS) + r")(?:\s+|$)|(?:" + "|".join(L.TITLES) + r")\s+)"


def normalized(x: str, titles: int = 3) -> str:
    """SQL of a name's normal form, with up to so many titles removed."""
    x = "trim(regexp_replace(regexp_replace(regexp_replace(string_split(lower({n}), ',')[1], '\\([^)]*\\)', ' ', 'g'), '[.,;:\"]+', ' ', 'g'), '\\s+', ' ', 'g'))".format(n=x)
    for _ in range(titles):
        x = f"regexp_replace({x}, '{_ONE_TITLE}', '')"
    return x


#: Segments with provenance, as the stages make them; {where} limits them by air_date.
SEGMENTS = f"""
raw AS (SELECT conv_id AS seg_id, (CASE WHEN conv_id % 13 = 5 THEN 3007 ELSE 2000 + conv_id % 26 END)::VARCHAR AS y, (1 + conv_id % 12)::VARCHAR AS m,
   (CASE WHEN conv_id % 11 = 3 THEN 31 ELSE 1 + conv_id % 28 END)::VARCHAR AS dd, {_pick(SHOWS, 'conv_id % 4')} || '.' || lpad((conv_id % 7)::VARCHAR, 2, '0') AS code, string_agg(line, chr(10) ORDER BY turn) AS text FROM
 (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '(BEGIN VIDEO CLIP) ' ELSE '' END || {_pick(LABELS, '(2 * conv_id + turn) % 9')} || ': ' || text || {_pick(CITES, f'(conv_id + 2 * turn) % {len(CITES)}')} ||
   CASE WHEN turn % 3 = 1 AND conv_id % 7 <> 0 THEN ' (END VIDEO CLIP)' ELSE '' END AS line FROM conversations) GROUP BY conv_id),
dated AS (SELECT *, 'http://x.example/' || y || '.' || lpad(m, 2, '0') || '.' || lpad(dd, 2, '0') || '/' || code || '.html' AS url, CASE WHEN y::INT BETWEEN 1999 AND 2026 THEN try_cast(y || '-' || lpad(m, 2, '0') || '-' || lpad(dd, 2, '0') AS DATE) END AS air_date FROM raw),
corpus AS (SELECT *, year(air_date)::INT AS year, code AS uid, string_split(code, '.')[1] AS show_code, {ERA.format(d='air_date')} AS era_id FROM dated {{where}})"""
_LABEL = quoted(L.LABEL)
_MARKER = quoted(L.CLIP_MARKER)
_BOUNDARY = ", ".join("chr(10)" if b == "\n" else "''''" if b == "'" else f"'{b}'" for b in L.LABEL_BOUNDARY)
#: Turns: labels located by the lengths of gaps and matches, boundaries, rosters, clips (by the markers around a label), utterances.
TURNS = f"""
WITH {SEGMENTS},
p AS (SELECT *, string_split_regex(text, '{_LABEL}') AS g, regexp_extract_all(text, '{_LABEL}') AS mm, regexp_extract_all(text, '{_LABEL}', 1) AS nm, regexp_extract_all(text, '{_LABEL}', 2) AS rl FROM corpus),
u AS (SELECT seg_id, year, air_date, text, nm[i] AS nm, rl[i] AS rl, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(mm[1:i - 1], lambda x: length(x))), 0) AS a, length(mm[i]) AS lm
      FROM p, unnest(range(1, len(mm) + 1)) AS r(i)),
v AS (SELECT *, rtrim(substring(text, 1, a::BIGINT), chr(32) || chr(9)) AS before FROM u),
k AS (SELECT seg_id, year, air_date, text, a::INT AS a, (a + lm)::INT AS z, trim(regexp_replace(nm, '\\s+', ' ', 'g')) AS nm, CASE WHEN rl <> '' THEN trim(regexp_replace(rl, '\\s+', ' ', 'g')) END AS rl,
             row_number() OVER (PARTITION BY seg_id ORDER BY a) - 1 AS turn_index
      FROM v WHERE before = '' OR right(before, 1) IN ({_BOUNDARY})),
f AS (SELECT *, lower(nm) AS norm, string_split(lower(nm), ' ')[-1] AS sn, {FLAG.format(r="rl", n="nm")} AS flag, coalesce(lead(a) OVER (PARTITION BY seg_id ORDER BY a), length(text)) AS e FROM k),
ro AS (SELECT seg_id, sn, arg_min(norm, turn_index) AS r_norm, arg_min(flag, turn_index) AS r_flag FROM f WHERE rl IS NOT NULL AND flag IN ('staff', 'guest') GROUP BY 1, 2),
x AS (SELECT f.*, substring(text, z + 1, greatest(e - z, 0)::BIGINT) AS raw, r_norm, r_flag, regexp_extract_all(substring(text, 1, a::BIGINT), '{_MARKER}', 1)[-1] AS last_marker,
             regexp_extract_all(substring(text, a::BIGINT + 1), '{_MARKER}', 1)[1] AS next_marker FROM f LEFT JOIN ro USING (seg_id, sn)),
turns AS (SELECT seg_id, year, air_date, turn_index::INT AS turn_index, (z + length(raw) - length(regexp_replace(raw, '^\\s+', '')))::INT AS char_start,
   (z + length(raw) - length(regexp_replace(raw, '^\\s+', '')) + length(regexp_replace(regexp_replace(raw, '^\\s+', ''), '\\s+$', '')))::INT AS char_end,
   nm AS speaker_raw, rl AS role_raw, CASE WHEN flag = 'unknown' THEN coalesce(r_norm, norm) ELSE norm END AS name_norm,
   CASE WHEN flag = 'unknown' THEN coalesce(r_flag, flag) ELSE flag END AS staff_flag,
   CASE WHEN last_marker = 'BEGIN' AND coalesce(next_marker, 'END') = 'END' THEN 'clip' ELSE 'live' END AS source_mode
   FROM x)"""
_ALIAS = "CASE {n} " + " ".join(f"WHEN '{' '.join(k.replace('.', ' ').split())}' THEN '{v}'" for k, v in L.ALIASES.items()) + " END"


def resolved(table: str, name: str, out: str) -> str:
    """CTEs that add canonical_id to `table`, over its whole as the scope."""
    return f"""
{out}_n AS (SELECT *, {normalized(name)} AS n FROM {table}),
{out}_a AS (SELECT *, {_ALIAS.format(n='n')} AS alias FROM {out}_n),
{out}_f AS (SELECT string_split(n, ' ')[-1] AS sn2, count(DISTINCT n) AS many, min(n) AS one FROM {out}_a WHERE contains(n, ' ') AND alias IS NULL GROUP BY 1),
{out} AS (SELECT a.*, CASE WHEN n = '' THEN '' WHEN alias IS NOT NULL THEN alias WHEN contains(n, ' ') THEN n WHEN many = 1 THEN one WHEN many > 1 THEN 'ambiguous:' || n ELSE n END AS canonical_id
   FROM {out}_a a LEFT JOIN {out}_f f ON a.n = f.sn2 AND NOT contains(a.n, ' '))"""


WHO = TURNS + "," + resolved("turns", "name_norm", "who0") + f""",
who AS (SELECT *, {OFFICE.format(r='role_raw')} AS office, {PARTY.format(r='role_raw')} AS party, coalesce(canonical_id = {PRES.format(d='air_date')}, false) AS is_president FROM who0)"""
_ORGS = ", ".join(f"'{w}'" for w in A.ORG_WORDS)
_TOKEN, _GRAMMAR = quoted(A.TOKEN), quoted(A.GRAMMAR)
_SIZE = {g: f"length(coalesce(r{A.GROUPS.index(g) + 1}[i], ''))" for g in A.GROUPS}
#: Credited sources: tokens with their places and types, the grammar over the string of types, and names and verbs by token.
CITED = WHO + f""",
tg AS (SELECT *, string_split_regex(text, '{_TOKEN}') AS g, regexp_extract_all(text, '{_TOKEN}') AS w FROM corpus),
tw AS (SELECT seg_id, i, length(g[i]) AS gap, w[i] AS w, (sum(length(g[i]) + length(w[i])) OVER (PARTITION BY seg_id ORDER BY i))::INT AS z FROM tg, unnest(range(1, len(w) + 1)) AS r(i)),
tt AS (SELECT *, {A.type_sql('w')} AS k FROM tw),
tk AS (SELECT seg_id, i - 1 AS i, w, k, z - length(w) AS a, z, (sum(b) OVER (PARTITION BY seg_id ORDER BY i))::INT AS sentence FROM
  (SELECT *, (i > 1 AND gap > 0 AND lag(k) OVER (PARTITION BY seg_id ORDER BY i) = 'S')::INT AS b FROM tt)),
cg AS (SELECT seg_id, string_split_regex(kinds, '{_GRAMMAR}') AS g, {", ".join(f"regexp_extract_all(kinds, '{_GRAMMAR}', {i}) AS r{i}" for i in range(len(A.GROUPS) + 1))} FROM (SELECT seg_id, string_agg(k, '' ORDER BY i) AS kinds FROM tk GROUP BY 1)),
ch AS (SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(r0[1:i - 1], lambda x: length(x))), 0) AS a, coalesce(r2[i], '') AS n1, coalesce(r6[i], '') AS n2, coalesce(r8[i], '') || coalesce(r12[i], '') AS n3 FROM cg, unnest(range(1, len(r0) + 1)) AS r(i)),
ci AS (SELECT seg_id, (a + CASE WHEN n1 <> '' THEN {_SIZE['to']} WHEN n2 <> '' THEN {_SIZE['quote']} + 1 + {_SIZE['lead2']} ELSE {_SIZE['lead3']} + {_SIZE['lead4']} END)::BIGINT AS f, length(n1 || n2 || n3) AS n,
   CASE WHEN n1 <> '' THEN NULL WHEN n2 <> '' THEN a + {_SIZE['quote']} ELSE a + length(r0[i]) - 1 END::BIGINT AS v FROM ch WHERE n1 || n2 || n3 <> ''),
ct AS (SELECT c.seg_id, url, year, air_date, f.a::INT AS char_start, substring(text, f.a::BIGINT + 1, (l.z - f.a)::BIGINT) AS source_span, f.sentence AS sentence_index, CASE WHEN v IS NULL THEN 'according_to' ELSE 'subj_cue' END AS pattern_id,
   CASE WHEN v IS NULL THEN 'according to' ELSE CASE w.w {" ".join(f"WHEN '{f}' THEN '{v}'" for f, v in A.LEMMA.items())} END END AS cue_verb,
   CASE WHEN starts_with(lower(source_span), 'the ') OR list_has_any(string_split(lower(source_span), ' '), [{_ORGS}]) THEN 'ORG' ELSE 'PERSON' END AS entity_type
   FROM ci c JOIN corpus USING (seg_id) JOIN tk f ON f.seg_id = c.seg_id AND f.i = c.f JOIN tk l ON l.seg_id = c.seg_id AND l.i = c.f + c.n - 1 LEFT JOIN tk w ON w.seg_id = c.seg_id AND w.i = c.v),
cited0 AS (SELECT * FROM ct WHERE NOT EXISTS (SELECT 1 FROM turns WHERE turns.seg_id = ct.seg_id AND turns.name_norm = lower(ct.source_span))),""" + resolved("cited0", "source_span", "cited")


def within(sql: str, where: str = "") -> str:
    """Any of the texts above, over the segments that `where` keeps."""
    return sql.replace("{where}", where)
