"""Suffix automata of several sequences: every run of symbols that occurs in any of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any


class SuffixAutomaton:
    """States are classes of runs that end at the same places; 0 is the empty run."""

    def __init__(self) -> None:
        self.next: list[dict[Any, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, entry: Sequence) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for c in entry:
            old = nxt[last].get(c)
            if old is not None:
                last = old if length[old] == length[last] + 1 else self._clone(last, old, c)
                continue
            new = len(link)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
            last = new

    def _clone(self, p: int, q: int, c: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def matching_lengths(self, sequence: Sequence) -> Iterator[int]:
        """Per position: length of the longest run ending there that the automaton has."""
        state = size = 0
        for c in sequence:
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                size += 1
            yield size


class EntryAutomaton(SuffixAutomaton):
    """The automaton of a vocabulary, which knows the entries that end in each state."""

    def __init__(self, entries: dict[str, int]) -> None:
        super().__init__()
        for entry in entries:
            self.add(entry)
        held: dict[int, list[tuple[int, int]]] = {}
        for entry, number in entries.items():
            state = 0
            for c in entry:
                state = self.next[state][c]
            held.setdefault(state, []).append((len(entry), number))
        #: Per state: (length, entry) of all entries that can end there, longest first.
        self.ending: list[list[tuple[int, int]]] = [[]] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above = self.ending[self.link[s]]
            self.ending[s] = sorted(held[s], reverse=True) + above if s in held else above
