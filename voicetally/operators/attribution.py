"""Credited sources in running text: a clause chunker in Catalyst expressions, and a hook for a language model.

A source is the subject of a verb of saying, in either order and in the passive too, or the name after `according to`. As in a
dependency parse, the head of several subjects is credited, names after a preposition are not (so no agent after `by`), and
titles and possessives are not part of a name. The chunker knows no meanings: it is an approximation of such a parse.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze
from .clauses import LEMMA, ORG_WORDS, credits

SCHEMA = "sentence_index int, char_start int, char_end int, source_span string, entity_type string, cue_verb string, pattern_id string, sentence_text string"


def lemma_of(form: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LEMMA.items() for x in pair]), form)


def entity_type(span: Column) -> Column:
    low = F.lower(span)
    words = F.split(F.regexp_replace(low, r"^the\s+", ""), r"\s+")
    return F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in ORG_WORDS])) | low.startswith("the "), "ORG").otherwise("PERSON")


def extract_attributions(segments: DataFrame, text: str = "text", exclude: str | None = None) -> DataFrame:
    """One row per credited source with offsets into the text. exclude: a column with the names on air, which are dropped; it is
    not kept. Nothing is shuffled: matches do not overlap, so a span counts once, and names on air are of the same row. A row's
    sources are found in one array before they become rows, which do not carry the text.
    """
    cols = [c for c in segments.columns if c not in (text, exclude)]
    found = credits(F.coalesce(F.col(text), F.lit("")))
    d = segments.select(*cols, found.alias("_f"), *([F.transform(exclude, lambda c: F.lower(squeeze(c))).alias("_x")] if exclude else []))
    if exclude:
        on_air = lambda h: F.coalesce(F.array_contains("_x", F.lower(squeeze(h["source_span"]))), F.lit(False))
        d = d.select(*cols, F.filter("_f", lambda h: ~on_air(h)).alias("_f"))
    x = F.col("_h")
    cue = F.when(x["pattern_id"] == "according_to", "according to").otherwise(lemma_of(x["verb"]))
    # an outer generator: before an inner one Spark puts a filter that works the whole array out a second time
    return d.select(*cols, F.explode_outer("_f").alias("_h")).where("_h is not null").select(
        *cols, x["sentence_index"].alias("sentence_index"), x["char_start"].alias("char_start"), x["char_end"].alias("char_end"), x["source_span"].alias("source_span"),
        entity_type(x["source_span"]).alias("entity_type"), cue.alias("cue_verb"), x["pattern_id"].alias("pattern_id"), x["sentence_text"].alias("sentence_text"),
    )


def extract_with_model(segments: DataFrame, key: str, text: str, load: Callable[[], Callable[[str], list[dict]]]) -> DataFrame:
    """The same rows by a language model. load is called once per task and gives a function from a text to attributions."""
    types = dict(segments.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for pdf in batches:
            rows = [{key: k, **a} for k, t in zip(pdf[key], pdf[text]) if t and t.strip() for a in model(t)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return segments.select(key, text).mapInPandas(run, f"{key} {types[key]}, {SCHEMA}")
