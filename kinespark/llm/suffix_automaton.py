"""The suffix automaton of several sequences, for the operators that stream documents for matching statistics."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator


class SuffixAutomaton:
    """The generalised suffix automaton of the sequences added; state 0 is the start."""

    def __init__(self) -> None:
        self.next: list[dict[Hashable, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, after: dict[Hashable, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word: Hashable) -> int:
        """The state of the longest match at p and word, which stands within q."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, sequence: Iterable[Hashable]) -> list[int]:
        """Adds a sequence; the state of each of its beginnings (the whole beginning is the state's longest string)."""
        last, states = 0, []
        for word in sequence:
            if (q := self.next[last].get(word)) is not None:
                last = self._split(last, q, word)
                states.append(last)
                continue
            state, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = state
                p = self.link[p]
            if p >= 0:
                self.link[state] = self._split(p, self.next[p][word], word)
            last = state
            states.append(last)
        return states

    def walk(self, sequence: Iterable[Hashable]) -> Iterator[tuple[int, int]]:
        """At each word, the state and length of the longest match that ends there."""
        state = size = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if (q := self.next[state].get(word)) is not None:
                state = q
                size += 1
            else:
                size = 0
            yield state, size

    def matches(self, sequence: Iterable[Hashable]) -> list[int]:
        """At each word, the number of words up to it that stand together somewhere in the automaton's sequences."""
        return [size for _, size in self.walk(sequence)]
