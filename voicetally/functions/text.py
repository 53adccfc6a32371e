"""Column functions over names, roles, urls and dates. Every one is a plain Catalyst expression."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

WS = r"(?U)\s+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c) -> Column:
    """White space collapsed to single spaces and cut at both ends."""
    return F.trim(F.regexp_replace(_col(c), WS, " "))


def surname(name) -> Column:
    return F.element_at(F.split(_col(name), " "), -1)


def strip_titles(name) -> Column:
    """Leading titles removed: two-word titles always, one-word titles while a word follows."""
    two, one = "|".join(L.TITLES_TWO_WORDS), "|".join(sorted(L.TITLES, key=len, reverse=True))
    return F.regexp_replace(_col(name), rf"^(?:(?:{two})(?:\s+|$)|(?:{one})\s+(?=\S))*+", "")


def normalize_name(raw) -> Column:
    """A name's canonical form: lower case, up to the first comma, without parentheses, punctuation and leading titles."""
    s = F.substring_index(F.lower(F.coalesce(_col(raw), F.lit(""))), ",", 1)
    s = F.regexp_replace(F.regexp_replace(s, r"\([^)]*\)", " "), r'[.,;:"]+', " ")
    return strip_titles(squeeze(s))


def is_nonperson(name) -> Column:
    n = F.lower(F.trim(_col(name)))
    return functools.reduce(lambda a, b: a | b, [n == t for t in L.NONPERSON] + [n.startswith(t + " ") for t in L.NONPERSON])


def classify_role(role, name) -> Column:
    """nonperson, unknown (no role), staff (a staff word occurs in the role) or guest."""
    r = F.lower(F.coalesce(_col(role), F.lit("")))
    staff = functools.reduce(lambda a, b: a | b, [r.contains(w) for w in L.STAFF_WORDS])
    return F.when(is_nonperson(name), "nonperson").when(r == "", "unknown").when(staff, "staff").otherwise("guest")


def classify_office(role) -> Column:
    """Office of the first keyword, in the lexicon's order, that occurs in the role; else the empty string."""
    r = F.lower(F.coalesce(_col(role), F.lit("")))
    out = F.when(F.lit(False), F.lit(""))
    for word, office in L.OFFICES:
        out = out.when(r.contains(word), office)
    return out.otherwise("")


def parse_party(role) -> Column:
    """R, D or I: by a tag such as (R-TX), else by a party word; null if neither occurs."""
    r = F.coalesce(_col(role), F.lit(""))
    tag = F.upper(F.regexp_extract(r, L.PARTY_TAG, 1))
    out = F.when(tag != "", tag)
    for word, party in L.PARTY_WORDS:
        out = out.when(F.lower(r).contains(word), party)
    return out


def air_date(year, month, day) -> Column:
    """The date of three numbers, null if a part is missing or the day does not exist."""
    y, m, d = _col(year), _col(month), _col(day)
    whole = y.isNotNull() & m.isNotNull() & d.isNotNull()
    return F.when(whole, F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), m.cast("string"), d.cast("string")).try_cast("date"))


def url_date(url) -> Column:
    """The date written as YYYY.MM.DD in a url; null if none is or it does not exist."""
    return F.replace(F.regexp_extract(F.coalesce(_col(url), F.lit("")), f"({L.URL_DATE})", 1), F.lit("."), F.lit("-")).try_cast("date")


def effective_uid(uid, url) -> Column:
    """The uid, or where it is empty the url's last path part without .html."""
    u, l = F.coalesce(_col(uid), F.lit("")), F.coalesce(_col(url), F.lit(""))
    slug = F.element_at(F.split(F.regexp_replace(l, "/+$", ""), "/"), -1)
    return F.when((u == "") & (l != ""), F.regexp_replace(slug, r"\.html$", "")).otherwise(u)


def show_code(uid) -> Column:
    u = F.lower(squeeze(_col(uid)))
    code = F.split(u, r"\.")[0]
    return F.when(code != "", code)


def segment_index(uid) -> Column:
    parts = F.split(F.lower(squeeze(_col(uid))), r"\.")
    last = F.element_at(parts, -1)
    return F.when((F.size(parts) > 1) & last.rlike("^[0-9]+$"), last.try_cast("int"))


def host_of(code) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in L.SHOW_HOSTS.items():
        out = out.when(_col(code) == k, v)
    return out


def era_of(day, strict: bool = True) -> Column:
    """The latest corpus format that began by the day. Days before the first raise an error, or give null if not strict."""
    d = _col(day)
    out = F.when(d.isNull(), F.lit(None).cast("string"))
    for era, first in reversed(L.ERAS):
        out = out.when(d >= F.lit(first), era)
    return out.otherwise(F.raise_error(F.concat(d.cast("string"), F.lit(" is before the corpus start"))).cast("string") if strict else F.lit(None))


def president_on(day) -> Column:
    d = _col(day)
    out = F.when(F.lit(False), F.lit(""))
    for who, _, first, after in L.PRESIDENTS:
        out = out.when((d >= F.lit(first)) & (F.lit(True) if after is None else d < F.lit(after)), who)
    return out


def is_sitting_president(canonical_id, day) -> Column:
    return F.coalesce(F.lower(F.trim(_col(canonical_id))) == president_on(day), F.lit(False))


def is_named(canonical_id) -> Column:
    """Whether an id stands for one known individual."""
    c = F.coalesce(_col(canonical_id), F.lit(""))
    return (c != "") & ~c.startswith("ambiguous:")


def prf(tp, fp, fn) -> Column:
    """struct(precision, recall, f1); 0 where a denominator is 0."""
    t = _col(tp).cast("double")
    p = F.coalesce(F.try_divide(t, t + _col(fp)), F.lit(0.0))
    r = F.coalesce(F.try_divide(t, t + _col(fn)), F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))
