"""Generalised suffix automaton over sequences of any symbols."""

from __future__ import annotations


class SuffixAutomaton:
    """States of all substrings of the added sequences, their arrows and suffix links."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.length: list[int] = [0]

    def _state(self, length: int, arrows: dict, link: int) -> int:
        self.next.append(arrows)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, symbol) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence) -> None:
        last = 0
        for symbol in sequence:
            known = self.next[last].get(symbol)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, known, symbol)
                continue
            state, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
            last = state

    def state_of(self, sequence) -> int:
        state = 0
        for symbol in sequence:
            state = self.next[state][symbol]
        return state
