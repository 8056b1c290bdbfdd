"""Suffix automata over sequences of hashable symbols."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence


class SuffixAutomaton:
    """All factors of the sequences added so far; each sequence stands for itself.

    States and transitions are at most twice and three times the added symbols.
    """

    __slots__ = ("_next", "_link", "_length", "_last", "_separator")

    def __init__(self) -> None:
        self._next: list[dict] = [{}]
        self._link = [-1]
        self._length = [0]
        self._last = 0
        self._separator = 0

    def add(self, symbols: Iterable) -> None:
        """Append a sequence behind a separator that occurs nowhere else."""
        self._separator += 1
        self._extend(("end", self._separator))
        for symbol in symbols:
            self._extend(symbol)

    def _extend(self, symbol) -> None:
        nexts, link, length = self._next, self._link, self._length
        state, p = len(nexts), self._last
        nexts.append({})
        link.append(0)
        length.append(length[p] + 1)
        while p >= 0 and symbol not in nexts[p]:
            nexts[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = nexts[p][symbol]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                clone = len(nexts)
                nexts.append(nexts[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(symbol) == q:
                    nexts[p][symbol] = clone
                    p = link[p]
                link[q] = link[state] = clone
        self._last = state

    def matching(self, symbols: Sequence) -> Iterator[int]:
        """Matching statistics: for each position the length of the longest
        factor of the added sequences that ends there."""
        nexts, link, length = self._next, self._link, self._length
        state = matched = 0
        for symbol in symbols:
            while state and symbol not in nexts[state]:
                state = link[state]
                matched = length[state]
            if symbol in nexts[state]:
                state = nexts[state][symbol]
                matched += 1
            else:
                matched = 0
            yield matched
