"""The operators' results in SQL (DuckDB), where SQL can express them: plain statements of the contracts, by brute force."""

from __future__ import annotations

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def _words(pattern: str, lower: bool) -> str:
    text = "coalesce(text, '')"
    return f"regexp_extract_all({_LOWER.format(x=text) if lower else text}, '{pattern}')"


DECONTAMINATION = f"""
WITH dw AS (SELECT doc_id, {_words(_ALNUM, True)} AS w FROM documents),
bw AS (SELECT item_id, {_words(_ALNUM, True)} AS w FROM benchmark),
bl AS (SELECT item_id, w, least(10, len(w)) AS k FROM bw WHERE len(w) > 0),
bwin AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bl, unnest(range(1, len(w) - k + 2)) AS u(i)),
ks AS (SELECT DISTINCT k FROM bwin),
dwin AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM dw, ks, unnest(range(1, greatest(len(w) - k + 2, 1))) AS u(i)),
hit AS (SELECT d.doc_id, d.i, d.k, b.item_id FROM dwin d JOIN bwin b ON d.k = b.k AND d.g = b.g),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) AS u(p) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE dw AS (SELECT doc_id, {_words(_SPACED, True)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM dw, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id
FROM (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1) c LEFT JOIN n USING (doc_id)
"""

SUBSTRINGS = f"""
WITH dw AS (SELECT doc_id, {_words(_SPACED, False)} AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS g FROM dw, unnest(range(1, greatest(len(w) - 33, 1))) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, p FROM rep, unnest(range(i, i + 35)) AS u(p)),
tok AS (SELECT doc_id, p, w[p] AS x FROM dw, unnest(range(1, len(w) + 1)) AS u(p)),
k AS (SELECT t.doc_id, count(*) AS kept, string_agg(x, ' ' ORDER BY t.p) AS s FROM tok t ANTI JOIN gone g ON t.doc_id = g.doc_id AND t.p = g.p GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM dw LEFT JOIN k USING (doc_id)
"""
