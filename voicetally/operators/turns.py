"""Speaker turns: labels with exact offsets, rosters, clip spans and utterances, all in Catalyst expressions.

A label that matches at a wrong place is dropped after matching and still uses up its text. Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.arrays import let, prefix_sums, running_max
from ..functions.text import classify_role, squeeze, surname

LABEL = "(?U)" + L.LABEL
TURN = ("turn_index", "char_start", "char_end", "speaker_raw", "role_raw", "name_norm", "staff_flag", "source_mode")


def located(text: Column, pattern: str, *groups: str) -> Column:
    """All matches of a pattern: start a, end z, the text between it and the match before (gap), the match itself (m), and what
    its groups found under their names. Ends are summed up along the text by doubling; the rest goes by place."""
    lit = F.lit(pattern)
    parts = F.struct(F.split(text, pattern, -1).alias("gap"), *[F.regexp_extract_all(text, lit, F.lit(i)).alias(f"g{i}") for i in range(len(groups) + 1)])

    def rows(x: Column, z: Column) -> Column:
        def row(m: Column, i: Column) -> Column:
            end = F.get(z, i).cast("int")
            found = [F.get(x[f"g{k}"], i).alias(name) for k, name in enumerate(groups, 1)]
            return F.struct((end - F.length(m)).alias("a"), end.alias("z"), F.get(x["gap"], i).alias("gap"), m.alias("m"), *found)

        return F.transform(x["g0"], row)

    def ends(x: Column) -> Column:
        return prefix_sums(F.zip_with(F.slice(x["gap"], F.lit(1), F.size(x["g0"])), x["g0"], lambda g, m: F.length(g) + F.length(m)))

    return let(parts, lambda x: let(ends(x), lambda z: rows(x, z)))


def _placed(found: Column) -> Column:
    """For each found label whether it has a boundary before it."""

    def ok(x: Column, i: Column) -> Column:
        before = F.rtrim(F.concat(F.coalesce(F.get(found, i - 1)["m"], F.lit("")), x["gap"]), F.lit(" \t"))
        return (before == "") | F.right(before, F.lit(1)).isin(*L.LABEL_BOUNDARY)

    return F.transform(found, ok)


def _labels(text: str) -> Column:
    """All labels with a boundary before them: start, end, name and role."""
    return let(located(F.col(text), LABEL, "name", "role"), lambda found: let(_placed(found), lambda ok: F.filter(found, lambda x, i: F.get(ok, i))))


def clip_spans(text: str) -> Column:
    """Spans between clip markers: a second BEGIN moves the start, an END without a start counts nothing, and a clip left
    open runs to the end of the text. So every BEGIN that no other BEGIN follows next gives a span."""

    def spans(markers: Column) -> Column:
        each = F.transform(markers, lambda x, i: F.struct(x["z"].alias("lo"), F.coalesce(F.get(markers, i + 1)["a"], F.length(text)).alias("hi"), ((x["kind"] == "BEGIN") & ~F.coalesce(F.get(markers, i + 1)["kind"] == "BEGIN", F.lit(False))).alias("ok")))
        return F.transform(F.filter(each, lambda x: x["ok"]), lambda x: F.struct(x["lo"], x["hi"]))

    return let(located(F.col(text), L.CLIP_MARKER, "kind"), spans)


def _named(x: Column) -> Column:
    name, role = squeeze(x["name"]), F.when(x["role"] != "", squeeze(x["role"]))
    return F.struct(x["a"].alias("a"), x["z"].alias("z"), name.alias("name"), role.alias("role"), F.lower(name).alias("norm"), classify_role(role, name).alias("flag"))


def _known(labels: Column) -> Column:
    """For each label, whom it stands for if it has no role: the first of its surname who is introduced with one. Labels are
    sorted by surname, introductions first, so that each finds its answer at the head of its run."""

    def one(x: Column, i: Column) -> Column:
        full = x["role"].isNotNull() & x["flag"].isin("staff", "guest")
        return F.struct(surname(x["norm"]).alias("sn"), F.when(full, 0).otherwise(1).alias("k"), i.alias("i"), x["norm"].alias("norm"), x["flag"].alias("flag"))

    def heads(e: Column) -> Column:
        return running_max(F.transform(e, lambda y, i: F.when(F.get(e, i - 1)["sn"] == y["sn"], 0).otherwise(i)))

    def answer(e: Column, h: Column) -> Column:
        def each(y: Column, i: Column) -> Column:
            head = F.get(e, F.get(h, i).cast("int"))
            hit = (y["flag"] == "unknown") & (head["k"] == 0)
            return F.struct(y["i"].alias("i"), F.when(hit, head["norm"]).alias("norm"), F.when(hit, head["flag"]).alias("flag"))

        return F.array_sort(F.transform(e, each))

    return let(F.array_sort(F.transform(labels, one)), lambda e: let(heads(e), lambda h: answer(e, h)))


def _in_clip(labels: Column, spans: Column) -> Column:
    """For each label whether it starts inside a span: starts of both are merged by place, and each label looks at the last span
    that began."""

    def flags(e: Column) -> Column:
        last = running_max(F.transform(e, lambda y: F.when(y["k"] == 0, y["i"] + 1).otherwise(0)))
        each = F.zip_with(e, last, lambda y, j: F.struct(y["k"].alias("k"), F.coalesce(y["p"] < F.get(spans, (j - 1).cast("int"))["hi"], F.lit(False)).alias("in")))
        return F.transform(F.filter(each, lambda y: y["k"] == 1), lambda y: y["in"])

    event = lambda p, k, i: F.struct(p.alias("p"), F.lit(k).alias("k"), i.alias("i"))
    merged = F.concat(F.transform(spans, lambda s, i: event(s["lo"], 0, i)), F.transform(labels, lambda x, i: event(x["a"], 1, i)))
    return F.when(F.size(spans) == 0, F.transform(labels, lambda x: F.lit(False))).otherwise(let(F.array_sort(merged), flags))


def names_on_air(text: str) -> Column:
    """The names (as in name_norm) of a text's turns."""
    every = let(F.transform(_labels(text), _named), lambda q: F.zip_with(q, _known(q), lambda x, k: F.coalesce(k["norm"], x["norm"])))
    return F.array_distinct(every)


def parse_turns(segments: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None, utterance: bool = False) -> DataFrame:
    """One row per turn: the segment's columns (all but the text, or `keep`) and TURN. Segments without turns vanish.

    A segment's turns are finished in one array before they become rows, so no row carries the text or the other turns, and time
    and memory are in proportion to the text (times the logarithm of the number of turns). What is said stands between two
    labels: labels in the text are replaced by a separator of their own, a digest of the text, and the text is split at it.
    """
    cols = list(keep) if keep is not None else [c for c in segments.columns if c != text]
    d = segments.select(*cols, F.coalesce(F.col(text), F.lit("")).alias("_t")).where(F.col("_t").contains(":"))
    d = d.select(*cols, "_t", located(F.col("_t"), LABEL, "name", "role").alias("_m"))
    d = d.withColumns({"_ok": _placed(F.col("_m")), "_s": F.concat(F.lit("\u0000"), F.md5("_t"))})
    until = F.zip_with("_m", "_ok", lambda x, ok: F.concat(x["gap"], F.when(ok, F.col("_s")).otherwise(x["m"])))
    rest = F.substring(F.col("_t"), F.coalesce(F.get("_m", F.size("_m") - 1)["z"], F.lit(0)) + 1, F.length("_t"))
    said = F.split(F.concat(F.array_join(until, ""), rest), F.col("_s"), F.lit(-1))
    kept = F.filter(F.col("_m"), lambda x, i: F.get("_ok", i))
    d = d.select(*cols, F.transform(kept, _named).alias("_q"), F.slice(said, F.lit(2), F.size(said)).alias("_u"), clip_spans("_t").alias("_c"))
    d = d.select(*cols, F.arrays_zip(F.col("_q").alias("q"), F.col("_u").alias("u"), _known(F.col("_q")).alias("k"), _in_clip(F.col("_q"), F.col("_c")).alias("c")).alias("_z"))

    def turn(y: Column) -> Column:
        q, k = y["q"], y["k"]
        left = F.regexp_replace(y["u"], r"^(?U)\s+", "")
        u = F.regexp_replace(left, r"(?U)\s+$", "")
        start = q["z"] + F.length(y["u"]) - F.length(left)
        out = [start.alias("char_start"), (start + F.length(u)).alias("char_end"), q["name"].alias("speaker_raw"), q["role"].alias("role_raw")]
        out += [F.coalesce(k["norm"], q["norm"]).alias("name_norm"), F.coalesce(k["flag"], q["flag"]).alias("staff_flag"), F.when(y["c"], "clip").otherwise("live").alias("source_mode")]
        return F.struct(*out, *([u.alias("utterance")] if utterance else []))

    # an outer generator: before an inner one Spark puts a filter that works the whole array out a second time
    rows = d.select(*cols, F.posexplode_outer(F.transform("_z", turn)).alias("turn_index", "_y")).where("turn_index is not null")
    return rows.select(*cols, "turn_index", *[F.col(f"_y.{c}").alias(c) for c in TURN[1:]], *([F.col("_y.utterance").alias("utterance")] if utterance else []))
