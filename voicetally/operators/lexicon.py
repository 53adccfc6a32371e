"""First match of a keyword lexicon in texts, by an Aho-Corasick automaton.

The automaton holds all keywords, and a text is read once whatever their number. Of the keywords that occur in a text the first
in the lexicon's order decides. A lexicon of any size works: it is taken in pieces of bounded size, and a text that one piece
has decided is not read again for later ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of keywords in one automaton (some hundred bytes each, at worst).
PIECE_CHARS = 4_000_000


class FirstMatch:
    """An automaton over (keyword, rank), made once per worker: the smallest rank among the keywords in a text."""

    def __init__(self, keywords: Sequence[str], ranks: Sequence[int]):
        self.keywords, self.ranks = keywords, ranks

    def __getstate__(self):
        return {"keywords": self.keywords, "ranks": self.ranks}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for word, rank in zip(self.keywords, self.ranks):
            if word not in a or a.get(word) > rank:
                a.add_word(word, rank)
        a.make_automaton()
        return a

    def __call__(self, text: str) -> int | None:
        least = None
        for _, rank in self.automaton.iter(text):
            if least is None or rank < least:
                least = rank
        return least


def pieces(words: DataFrame, keyword: str, order: str, chars: int = PIECE_CHARS) -> Iterator[tuple[list[str], list[int]]]:
    """The lexicon's keywords by rank, in pieces of at most so many characters (or one keyword), from the first on."""
    known = words.where((F.col(keyword) != "") & F.col(order).isNotNull()).select(F.col(keyword).alias("w"), F.col(order).cast("long").alias("r")).groupBy("w").agg(F.min("r").alias("r"))
    held, ranks, size = [], [], 0
    for row in known.orderBy("r").toLocalIterator(prefetchPartitions=False):
        if held and size + len(row["w"]) > chars:
            yield held, ranks
            held, ranks, size = [], [], 0
        held.append(row["w"])
        ranks.append(row["r"])
        size += len(row["w"])
    if held:
        yield held, ranks


def first_match(df: DataFrame, text: str, words: DataFrame, keyword: str, order: str = "ord", out: str = "match", chars: int = PIECE_CHARS) -> DataFrame:
    """df with a column `out`: the smallest `order` among the keywords that occur in the lower-cased text, null if none does.

    words: (keyword, order), keywords in lower case; equal keywords count with their smallest order, and empty ones not at all.
    Null texts have no match. All columns of df stay, whatever their names.
    """
    spark = df.sparkSession
    low, rank = (next(f"_{stem}{i}" for i in range(len(df.columns) + 1) if f"_{stem}{i}" not in {c.lower() for c in df.columns}) for stem in ("low", "rank"))
    d = df.withColumn(low, F.lower(F.col(text).cast("string"))).withColumn(rank, F.lit(None).cast("long"))
    at, schema = (len(df.columns), len(df.columns) + 1), d.schema
    for held, ranks in pieces(words, keyword, order, chars):
        known = spark.sparkContext.broadcast(FirstMatch(held, ranks))

        def run(batches, known=known):
            find = known.value
            for b in batches:
                done = b.column(at[1]).to_pylist()
                hits = [r if r is not None or t is None else find(t) for t, r in zip(b.column(at[0]).to_pylist(), done)]
                yield b.set_column(at[1], b.schema.field(at[1]), pa.array(hits, pa.int64()))

        d = d.mapInArrow(run, schema)
    return d.select(*[F.col(f"`{c}`") for c in df.columns], F.col(rank).alias(out))
