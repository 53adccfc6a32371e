"""Suffix automata of word sequences, matching statistics of a text against them, and how often what matched occurs."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import repeat

import numpy as np


class SuffixAutomaton:
    """All substrings of a set of word sequences (words as 64-bit hashes), and at how many places each stands.

    A state's first transition is kept in two lists, further ones in a dict, as nearly all states have one.
    """

    def __init__(self, sequences: Iterable[np.ndarray], places: Iterable[int] | None = None):
        """places: how often each sequence stands in all (1 by default)."""
        self.first: list[int | None] = [None]
        self.to = [0]
        self.more: dict[tuple[int, int], int] = {}
        self.link, self.length = [-1], [0]
        self.branches: list[list[int]] = [[]]
        ends: list[tuple[int, int]] = []
        for seq, n in zip(sequences, repeat(1) if places is None else places):
            last = 0
            for w in seq.tolist():
                last = self._extend(last, w)
                ends.append((last, n))
        del self.branches
        # a state's substrings end where its own prefixes do, and where those of the states that link to it do
        self.count = [0] * len(self.length)
        for state, n in ends:
            self.count[state] += n
        for state in np.argsort(np.array(self.length), kind="stable")[:0:-1].tolist():
            self.count[self.link[state]] += self.count[state]

    def step(self, state: int, w: int) -> int | None:
        return self.to[state] if self.first[state] == w else self.more.get((state, w))

    def _put(self, state: int, w: int, target: int) -> None:
        if self.first[state] is None or self.first[state] == w:
            self.first[state], self.to[state] = w, target
        else:
            if (state, w) not in self.more:
                self.branches[state].append(w)
            self.more[state, w] = target

    def _new(self, length: int, link: int) -> int:
        for column, x in ((self.first, None), (self.to, 0), (self.link, link), (self.length, length), (self.branches, [])):
            column.append(x)
        return len(self.length) - 1

    def _clone(self, q: int, length: int) -> int:
        c = self._new(length, self.link[q])
        self.first[c], self.to[c] = self.first[q], self.to[q]
        for w in self.branches[q]:
            self._put(c, w, self.more[q, w])
        self.link[q] = c
        return c

    def _redirect(self, p: int, w: int, old: int, new: int) -> None:
        while p != -1 and self.step(p, w) == old:
            self._put(p, w, new)
            p = self.link[p]

    def _extend(self, last: int, w: int) -> int:
        q = self.step(last, w)
        if q is not None:  # the sequence so far is known from another
            if self.length[q] == self.length[last] + 1:
                return q
            c = self._clone(q, self.length[last] + 1)
            self._redirect(last, w, q, c)
            return c
        new, p = self._new(self.length[last] + 1, 0), last
        while p != -1 and self.step(p, w) is None:
            self._put(p, w, new)
            p = self.link[p]
        if p != -1:
            q = self.step(p, w)
            if self.length[q] == self.length[p] + 1:
                self.link[new] = q
            else:
                c = self._clone(q, self.length[p] + 1)
                self._redirect(p, w, q, c)
                self.link[new] = c
        return new

    def statistics(self, words: np.ndarray) -> np.ndarray:
        """Per word the length of the longest known sequence that ends with it."""
        out, state, have = np.zeros(len(words), np.int64), 0, 0
        first, to, more, link, length = self.first, self.to, self.more, self.link, self.length
        for i, w in enumerate(words.tolist()):
            while True:
                t = to[state] if first[state] == w else more.get((state, w))
                if t is not None:
                    state, have = t, have + 1
                    break
                if not state:
                    have = 0
                    break
                state = link[state]
                have = length[state]
            out[i] = have
        return out

    def places(self, words: np.ndarray, window: int) -> np.ndarray:
        """Per word at how many places the `window` words stand that end with it; 0 where fewer match."""
        out, state, have = np.zeros(len(words), np.int64), 0, 0
        first, to, more, link, length, count = self.first, self.to, self.more, self.link, self.length, self.count
        for i, w in enumerate(words.tolist()):
            while True:
                t = to[state] if first[state] == w else more.get((state, w))
                if t is not None:
                    state, have = t, have + 1
                    break
                if not state:
                    have = 0
                    break
                state = link[state]
                have = length[state]
            if have >= window:
                # the shortest state that still has the last `window` words
                while length[link[state]] >= window:
                    state = link[state]
                    have = length[state]
                out[i] = count[state]
        return out
