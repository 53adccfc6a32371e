"""Stages from segments to yearly tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as X
from ..operators import attribution as A
from ..operators import shares as S
from ..operators.concentration import annual, concentration
from ..operators.lexicon import first_match
from ..operators.lookups import asof_lookup, interval_lookup
from ..operators.resolve import resolve_mentions
from ..operators.turns import names_on_air, parse_turns
from ..sources.tables import discard, stored

PROVENANCE = ("uid", "url", "path", "channel_name", "program_name", "headline", "subhead", "show_code", "host", "air_date", "time", "timezone", "era_id", "year")


def provenance(segments: DataFrame, strict: bool = True, eras: DataFrame | None = None) -> DataFrame:
    """PROVENANCE and text of coerced segments; year is the air date's, so an impossible day has none.

    eras: a table (era_id, first) in place of the fixed one; days before its first raise an error, or give null if not strict.
    """
    d = segments.withColumn("uid", X.effective_uid("uid", "url")).withColumn("air_date", X.air_date("year", "month", "date"))
    d = d.withColumns({"show_code": X.show_code("uid"), "headline": F.col("program_name"), "year": F.year("air_date")})
    if eras is None:
        d = d.withColumn("era_id", X.era_of("air_date", strict))
    else:
        d = asof_lookup(d, "air_date", eras, "first", ["era_id"])
        early = F.raise_error(F.concat(F.col("air_date").cast("string"), F.lit(" is before the corpus start"))).cast("string")
        d = d.withColumn("era_id", F.when(F.col("air_date").isNotNull() & F.col("era_id").isNull(), early).otherwise(F.col("era_id"))) if strict else d
    return d.withColumn("host", X.host_of("show_code")).select(*PROVENANCE, "text")


def offices_of(turns: DataFrame, offices: DataFrame | None = None) -> DataFrame:
    """turns with `office`: by the fixed lexicon, or by a table (keyword, office, ord) as read_lexicon() gives it."""
    if offices is None:
        return turns.withColumn("office", X.classify_office("role_raw"))
    hit = first_match(turns, "role_raw", offices, "keyword", out="_office_ord")
    named = offices.select(F.col("ord").alias("_ord"), "office")
    return hit.join(named, F.col("_office_ord") == F.col("_ord"), "left").drop("_office_ord", "_ord").withColumn("office", F.coalesce("office", F.lit("")))


def presidents_of(turns: DataFrame, presidents: DataFrame | None = None) -> DataFrame:
    """turns with `sitting`: who was president on the air date, by the fixed table or by one (person, first, after, ord)."""
    if presidents is None:
        return turns.withColumn("sitting", X.president_on("air_date"))
    return interval_lookup(turns, "air_date", presidents, "first", "after", ["person"], order="ord").withColumnRenamed("person", "sitting")


def build_turns(segments: DataFrame, scope: Sequence[str] = (), aliases: Mapping[str, str] | None = None, strict: bool = True, eras: DataFrame | None = None, presidents: DataFrame | None = None, offices: DataFrame | None = None) -> DataFrame:
    """Speaker turns with provenance, canonical ids (resolved within scope), office, party and the president flag. Parsed turns
    are stored, since resolution reads them twice. Eras, presidents and offices may come from tables of any size."""
    turns, _ = stored(parse_turns(provenance(segments, strict, eras)), "turns")
    who = presidents_of(offices_of(resolve_mentions(turns, "name_norm", scope, aliases), offices), presidents)
    sits = F.coalesce(F.lower(F.trim("canonical_id")) == F.col("sitting"), F.lit(False))
    return who.withColumns({"party": X.parse_party("role_raw"), "is_president": sits}).drop("sitting")


def counted(turns: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Parsed turns counted (n) by all that the yearly tables ask for."""
    t = turns.withColumns({"office": X.classify_office("role_raw"), "party": X.parse_party("role_raw"), "sitting": X.president_on("air_date")})
    return t.groupBy(*dict.fromkeys((*scope, "year", "sitting", "name_norm", "staff_flag", "source_mode", "office", "party"))).agg(F.count("*").alias("n"))


def resolved_counts(counts: DataFrame, scope: Sequence[str] = (), aliases: Mapping[str, str] | None = None) -> DataFrame:
    who = resolve_mentions(counts, "name_norm", scope, aliases)
    return who.withColumn("is_president", F.coalesce(F.col("canonical_id") == F.col("sitting"), F.lit(False)))


def count_turns(segments: DataFrame, scope: Sequence[str] = (), aliases: Mapping[str, str] | None = None, strict: bool = True) -> DataFrame:
    """Turns as build_turns() gives them, but counted before names are resolved. Counts are stored before resolution, which reads
    them twice, and after it, for all tables that are made of them; so texts are parsed once, and only counts are shuffled."""
    t = parse_turns(provenance(segments, strict), keep=tuple(dict.fromkeys(("year", "air_date", *scope))))
    counts, path = stored(counted(t, scope), "turn-counts")
    who, _ = stored(resolved_counts(counts, scope, aliases), "turn-counts-resolved")
    discard(segments.sparkSession, path)
    return who


def build_attributions(segments: DataFrame, scope: Sequence[str] = (), aliases: Mapping[str, str] | None = None, strict: bool = True) -> DataFrame:
    """Credited sources with provenance, without those on air in their segment. They are stored before resolution and after it."""
    p = provenance(segments, strict).withColumn("_on_air", names_on_air("text"))
    cited, path = stored(A.extract_attributions(p, exclude="_on_air"), "citations")
    who, _ = stored(resolve_mentions(cited, "source_span", scope, aliases), "citations-resolved")
    discard(segments.sparkSession, path)
    return who


def annual_hhi_speakers(turns: DataFrame, variant: str = "external", mode: str = "all") -> DataFrame:
    """The yearly series of turns: rows, or counts in a column n."""
    flags = ["guest"] if variant == "external" else ["guest", "staff"]
    t = turns.where(F.col("staff_flag").isin(flags) & X.is_named("canonical_id"))
    t = t if mode == "all" else t.where(F.col("source_mode") == mode)
    return annual(t, "speakers", variant if mode == "all" else f"{variant}-{mode}", weight=F.col("n") if "n" in t.columns else None)


def annual_hhi_attributions(cited: DataFrame, entity_type: str = "PERSON") -> DataFrame:
    c = cited.where((F.col("entity_type") == entity_type) & X.is_named("canonical_id")).dropDuplicates(["canonical_id", "url", "year"])
    return annual(c, "attributions", entity_type.lower())


def annual_all(turns: DataFrame, cited: DataFrame) -> DataFrame:
    parts = [annual_hhi_speakers(turns, v) for v in ("external", "all")] + [annual_hhi_attributions(cited, t) for t in ("PERSON", "ORG")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def trend_tables(turns: DataFrame) -> dict[str, DataFrame]:
    """The five yearly tables, all from one aggregate of counts as count_turns() stores them."""
    agg = S.turn_aggregate(turns)
    names = agg.groupBy("year", "mode", "canonical_id").agg(F.sum("n").alias("c"))
    by_mode = concentration(names, ["year", "mode"], "canonical_id", F.col("c"))
    return {
        "hhi": by_mode.withColumn("variant", F.concat(F.lit("external-"), F.col("mode"))),
        "top_sources": S.top_sources(names, ["mode", "year"], "canonical_id"),
        "president_share": S.president_share(agg),
        "office_share": S.office_share(agg, [o for _, o in L.OFFICES]),
        "party_share": S.party_share(agg),
    }


def between_days(segments: DataFrame, first: str, last: str) -> DataFrame:
    """Segments of the days first to last, both included; segments without a real date are left out."""
    day = X.air_date("year", "month", "date")
    return segments.where(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def expected_presidents(df: DataFrame, first: int = 2001, last: int = 2025) -> DataFrame:
    """(year, expected): who was president in the middle of each year."""
    y = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return y.withColumn("expected", X.president_on(F.make_date("year", F.lit(7), F.lit(1))))


def pilot(segments: DataFrame, first: str, last: str) -> dict[str, DataFrame]:
    """Counted turns, citations, their series and the face-validity report of a window of days."""
    s = between_days(segments, first, last)
    turns, cited = count_turns(s), build_attributions(s)
    return {"turns": turns, "attributions": cited, "series": annual_all(turns, cited), "face_validity": S.face_validity(cited, expected_presidents(cited))}
