"""Language identification by bit-sliced Bloom filters over byte n-grams.

Training counts 4-byte n-grams per language (letters lower-cased in ASCII, all else a space). A language's filter holds the
n-grams whose relative frequency in it is at least `share` of the largest over all languages. The filters are sliced by
bit: one cell array, bit l of a cell belonging to language l, so the AND of an n-gram's cells is the set of all languages
whose filter has it. A text's n-grams are looked up, hits are counted per language, each count is corrected by its
filter's false-positive rate, and the largest decides. There are eight cells and more for each n-gram of the richest language,
however many these are, with a 64-bit word for every 64 languages. Cells of more than `MAX_BYTES` are split into slices by a
hash of the n-gram: a slice's cells are sent to the tasks at a time, and texts are read once for each slice.

Null text or text without a letter is `und` with score 0; rows without a language are predicted, not learned from; ties go
to the first language by name; a text of letters without any n-gram is such a tie.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import binary_rows, cell_values, materialize, text_chunks

LEAST_LOG2 = 16
#: Size of the cells that are broadcast at once.
MAX_BYTES = 1 << 28
#: Multipliers of the three probes; odd and under 2**31, so that a product with a 32-bit n-gram is a positive long.
PROBES = (0x5851F42D, 0x2545F491, 0x1B873593)
SPREAD = 0x3C6EF373
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def _letters() -> np.ndarray:
    t = np.full(256, 0x20, np.uint8)
    t[0x61:0x7B] = np.arange(0x61, 0x7B)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    t[0x80:] = np.arange(0x80, 0x100)
    return t


def _grams(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, text) over all texts; none holds two spaces in a row, so none spans two texts or punctuated words."""
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    # two spaces around every text
    data = np.full(len(raw) + 2 * (n + 1), 0x20, np.uint8)
    lens = np.diff(off)
    doc = np.repeat(np.arange(n, dtype=np.int32), lens)
    data[np.arange(len(raw)) + 2 * (doc + 1)] = table[raw]
    own = np.full(len(data), -1, np.int32)
    own[np.arange(len(raw)) + 2 * (doc + 1)] = doc
    sp = data == 0x20
    double = sp[:-1] & sp[1:]
    ok = ~(double[:-2] | double[1:-1] | double[2:])
    at = np.flatnonzero(ok)
    g = data[at].astype(np.uint32)
    for j in (1, 2, 3):
        g = (g << np.uint32(8)) | data[at + j]
    return g, own[at + 1]


def slice_of(grams: np.ndarray, slices: int) -> np.ndarray:
    """An n-gram's slice, by other bits of a product than its cells."""
    return ((grams.astype(np.uint64) * np.uint64(SPREAD) & np.uint64(0xFFFFFFFF)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def learn(rows: DataFrame, share: float = 0.3, least: int = 2, max_bytes: int | None = None) -> tuple[list[str], int, int, Callable[[int], np.ndarray]]:
    """(languages by name, log2 of a slice's cells, slices, function from a slice to its bit masks by word and cell) from text and
    lang of the training rows."""
    table = _letters()

    def count(batches):
        names: list[str] = []
        held, size = [], 0

        def merged():
            code, inv = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(inv, np.concatenate([n for _, n in held])).astype(np.int64)

        for b in text_chunks(batches, "text"):
            g, doc = _grams(b.column(0), table)
            langs = b.column(1).to_pylist()
            names += [x for x in dict.fromkeys(langs) if x not in names]
            index = np.array([names.index(x) for x in langs], np.uint64)
            held.append(np.unique(g.astype(np.uint64) | (index[doc] << np.uint64(32)), return_counts=True))
            size += len(held[-1][0])
            if size > 2_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 1_000_000:
                    yield _counts(*held[0], names)
                    held, size = [], 0
        if held:
            yield _counts(*merged(), names)

    n = rows.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    n = materialize(n, "lang-grams")
    total = n.groupBy("lang").agg(F.sum("n").alias("total"))
    langs = sorted(r["lang"] for r in total.select("lang").collect())
    if not langs:
        return [], LEAST_LOG2, 1, lambda _: np.zeros((1, 1 << LEAST_LOG2), np.uint64)
    place = rows.sparkSession.createDataFrame(list(enumerate(langs)), "place int, lang string")
    rel = n.join(F.broadcast(total), "lang").withColumn("rel", F.col("n") / F.col("total"))
    most = rel.groupBy("gram").agg(F.max("rel").alias("most"))
    kept = rel.where(F.col("n") >= least).join(most, "gram").where(F.col("rel") >= share * F.col("most"))
    kept = materialize(kept.join(F.broadcast(place), "lang").select("gram", "place"), "lang-kept")
    richest = kept.groupBy("place").count().agg(F.max("count")).first()[0] or 0
    words = -(-len(langs) // 64)
    log2 = max(LEAST_LOG2, (8 * richest).bit_length())
    room = max(LEAST_LOG2, ((MAX_BYTES if max_bytes is None else max_bytes) // (8 * words)).bit_length() - 1)
    slices = 1 << max(0, log2 - room)
    log2 = min(log2, room)

    def cells_of(k: int) -> np.ndarray:
        own = kept.where(f"(((gram * {SPREAD}L) & 4294967295L) * {slices}L) >> 32 = {k}") if slices > 1 else kept
        cells = F.array(*[F.expr(f"((gram * {a}L) & 4294967295L) >> {32 - log2}") for a in PROBES])
        bits = own.select(F.explode(cells).alias("cell"), F.expr("place div 64").alias("word"), F.expr("shiftleft(1L, place % 64)").alias("mask"))
        table_rows = bits.groupBy("word", "cell").agg(F.bit_or("mask").alias("mask")).toArrow()
        out = np.zeros((words, 1 << log2), np.uint64)
        out[table_rows.column(0).to_numpy(), table_rows.column(1).to_numpy()] = table_rows.column(2).to_numpy().view(np.uint64)
        return out

    return langs, log2, slices, cells_of


def _counts(code, n, names):
    return pa.RecordBatch.from_arrays([pa.array(names).take(pa.array((code >> np.uint64(32)).astype(np.int64))), pa.array((code & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


def languages_of(grams: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """By word and n-gram the mask of all languages whose filter has it."""
    g, log2 = grams.astype(np.uint64), cells.shape[1].bit_length() - 1
    out = np.full((len(cells), len(g)), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in PROBES:
        out &= cells[:, ((g * np.uint64(a)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - log2)]
    return out


def has(masks: np.ndarray, place: int) -> np.ndarray:
    """Which of the masks (by word) have the language of this place."""
    return (masks[place // 64] >> np.uint64(place % 64) & np.uint64(1)).astype(bool)


def identify(docs: DataFrame, held_out, share: float = 0.3, max_bytes: int | None = None) -> DataFrame:
    """All documents' languages, by filters learned from those that are not held out (a boolean column expression)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text", "lang")
    langs, _, slices, cells_of = learn(rows.where("not held_out and lang is not null and text is not null"), share, max_bytes=max_bytes)
    out = rows.select("doc_id", "held_out", "text", F.lit(None).cast("binary").alias("real"))
    for k in range(slices):
        out = _counted(out, langs, cells_of(k), k, slices)
    return _decided(out, langs)


def _counted(rows: DataFrame, langs: list[str], cells: np.ndarray, k: int, slices: int) -> DataFrame:
    """Rows with a slice's hits per language, less those that its filters give falsely, added to what they have."""
    known = rows.sparkSession.sparkContext.broadcast(cells)

    def count(batches):
        cells, table = known.value, _letters()
        false_rate = np.array([float(has(cells, i).mean()) ** len(PROBES) for i in range(len(langs))])
        for b in text_chunks(batches, "text"):
            n = b.num_rows
            g, doc = _grams(b.column(2), table)
            if slices > 1:
                own = slice_of(g, slices) == k
                g, doc = g[own], doc[own]
            masks = languages_of(g, cells)
            seen = np.bincount(doc, minlength=n)
            hits = np.stack([np.bincount(doc[has(masks, i)], minlength=n) for i in range(len(langs))] or [np.zeros(n, np.int64)], axis=1)
            real = (hits - seen[:, None] * false_rate) / (1 - false_rate) if langs else hits.astype(float)
            if k:
                real = real + cell_values(b.column(3), np.float64)[0].reshape(real.shape)
            yield b.set_column(3, "real", binary_rows(real.ravel(), np.arange(n + 1) * real.shape[1])).set_column(2, "text", b.column(2).cast(pa.string()))

    return rows.mapInArrow(count, rows.schema)


def _decided(rows: DataFrame, langs: list[str]) -> DataFrame:
    def predict(batches):
        ascii_letter = np.zeros(256, bool)
        ascii_letter[0x41:0x5B] = ascii_letter[0x61:0x7B] = True
        for b in text_chunks(batches, "text"):
            text, n = b.column(2), b.num_rows
            real = np.maximum(cell_values(b.column(3), np.float64)[0].reshape(n, -1), 0)
            best = real.argmax(axis=1)
            top = real[np.arange(n), best]
            second = np.sort(real, axis=1)[:, -2] if len(langs) > 1 else np.zeros(n)
            score = np.where(top + second > 0, top / np.maximum(top + second, 1e-12), 1 / max(1, len(langs)))
            off = np.frombuffer(text.buffers()[1], np.int64, n + 1 + text.offset)[text.offset :]
            raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
            letters = np.concatenate([[0], np.cumsum(ascii_letter[raw])])[off - off[0]]
            none = np.flatnonzero(np.diff(letters) == 0)
            und = np.zeros(n, bool)
            und[none] = [not any(ch.isalpha() for ch in text[int(i)].as_py()) for i in none]
            und |= not langs
            names = [langs[k] if langs and not u else "und" for k, u in zip(best.tolist(), und.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names), pa.array(np.where(und, 0.0, np.clip(score, 0, 1)))], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predict, RESULT)
