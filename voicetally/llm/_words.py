"""Word scanning and n-gram hashing over whole Arrow text columns, vectorised with numpy.

Words are found on UTF-8 bytes: all separators used here are ASCII, so bytes and code points agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def _lower(table: np.ndarray) -> np.ndarray:
    table[0x41:0x5B] += 0x20
    return table


def space_words(lower: bool) -> np.ndarray:
    """Byte map for words [^\\x20\\x09-\\x0D]+; 0 marks a separator (byte 0 itself stands for 256 - 1, unused in UTF-8)."""
    t = np.arange(256, dtype=np.uint8)
    t[0] = 0xFF
    t = _lower(t) if lower else t
    t[SPACES] = 0
    return t


def alnum_words() -> np.ndarray:
    """Byte map for lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+."""
    t = _lower(np.arange(256, dtype=np.uint8))
    keep = np.zeros(256, bool)
    keep[0x30:0x3A] = keep[0x41:0x5B] = keep[0x61:0x7B] = keep[0x80:] = True
    t[~keep] = 0
    return t


_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_POW = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if len(_POW) < n:
        size = 1 << max(8, n.bit_length())
        _POW = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _P, np.uint64)]), dtype=np.uint64)
    return _POW


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the result may be used."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of several texts in a row: hash of each, byte span of each, and where each text's words begin."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    at: np.ndarray  # len = texts + 1
    data: np.ndarray  # the texts' bytes, not mapped

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def scan(texts: pa.Array, table: np.ndarray, hashes: bool = True) -> Words:
    """texts: large_string without nulls."""
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64, n + 1 + texts.offset)[texts.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if n else np.zeros(0, np.uint8)
    off = off - off[0]
    mapped = table[raw]
    isw = mapped != 0
    first, last = isw.copy(), isw.copy()
    first[1:] &= ~isw[:-1]
    last[:-1] &= ~isw[1:]
    full = off[:-1] < off[1:]
    b, e = off[:-1][full], off[1:][full] - 1
    first[b] = isw[b]
    last[e] = isw[e]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(start, off)
    if not hashes or not len(start):
        return Words(np.zeros(len(start), np.uint64), start, end, at, raw)
    lens = end - start
    begin = np.cumsum(lens) - lens
    local = np.arange(int(lens.sum()), dtype=np.int32) - np.repeat(begin.astype(np.int32), lens)
    part = mapped[isw].astype(np.uint64)
    part *= _powers(int(lens.max()))[local]
    h = np.add.reduceat(part, begin)
    return Words(mix(h + lens.astype(np.uint64) * _Q), start, end, at, raw)


def _shifted(a: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full(len(a), fill, a.dtype)
    if by < len(a):
        out[: len(a) - by] = a[by:]
    return out


def ngram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k items from each position on (beyond the end they count as 0): doubling, so log k passes."""
    have, size, power = h, 1, int(_Q)
    total, done, scale = None, 0, 1
    while True:
        if k & size:
            piece = _shifted(have, done, 0) * np.uint64(scale) if done else have
            total = piece if total is None else total + piece
            done += size
            scale = scale * power % 2**64
        if size * 2 > k:
            return mix(total + np.uint64(k))
        have = have + np.uint64(power) * _shifted(have, size, 0)
        size, power = size * 2, power * power % 2**64


def sliding(a: np.ndarray, w: int, op, fill) -> np.ndarray:
    """op (np.minimum or np.maximum) over a[i:i+w]; beyond the end, fill."""
    have, size = a, 1
    while size * 2 <= w:
        have = op(have, _shifted(have, size, fill))
        size *= 2
    return op(have, _shifted(have, w - size, fill)) if size < w else have


def valid(at: np.ndarray, k: int) -> np.ndarray:
    """True where the k items from a position on lie in one text."""
    out = np.ones(int(at[-1]), bool)
    for j in range(1, min(k, len(out) + 1)):
        x = at[1:] - j
        out[x[x >= at[:-1]]] = False
    return out


TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def winnow(gram: np.ndarray, ok: np.ndarray, at: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: the least k-gram hash of each w consecutive k-grams of one text.

    Returns (selected, least, whole): the positions whose k-gram is the least of some window; each window's least value;
    which positions begin a whole window. Ties select every equal position, which keeps the guarantee.
    """
    g = np.where(ok, np.minimum(gram, TOP - np.uint64(1)), TOP)
    last = np.zeros(len(ok), bool)
    whole = ok & _shifted(ok, w - 1, False)
    if w > 1:  # the k-gram w-1 on must be of the same text
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        whole &= _shifted(doc, w - 1, -1) == doc
    least = sliding(g, w, np.minimum, TOP)
    m = np.where(whole, least, np.uint64(0))
    back = sliding(m[::-1], w, np.maximum, np.uint64(0))[::-1]
    last = ok & (back == g)
    return last, least, whole
