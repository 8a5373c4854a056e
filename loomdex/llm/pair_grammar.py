"""Grammar compression of id sequences by frequent pairs, as numpy arrays inside a task.

In every round all frequent pairs of neighbours are replaced by new symbols, the most
frequent first where pairs overlap. A symbol stands for two older ones; its expansion
length is kept, so that any range of ids is decoded from the symbols that cover it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MIN_PAIRS = 4               # a pair is frequent if it stands at so many places of a shard
LEAST_GAIN = 1 / 16         # rounds end when one shortens the sequence by less
_MAGIC = np.frombuffer(b"PAIRGRM1", "<u8")


def _chosen(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places to replace, number of the rule at each place, pair of each rule)."""
    bits = len(pairs).bit_length()
    if int(pairs.max()).bit_length() + bits < 64:   # sort values faster than places
        ordered = np.sort(pairs << bits | np.arange(len(pairs)))
        order = ordered & ((1 << bits) - 1)
        ordered >>= bits
    else:
        order = np.argsort(pairs)
        ordered = pairs[order]
    first = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
    counts = np.diff(np.concatenate([first, [len(ordered)]]))
    often = np.flatnonzero(counts >= MIN_PAIRS)
    none = len(often)
    if not none:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    known = ordered[first[often]]
    by_rank = np.lexsort((known, -counts[often]))
    rank = np.full(len(first), none, np.int32)
    rank[often[by_rank]] = np.arange(none)
    ranks = np.full(len(pairs) + 2, none, np.int32)
    ranks[order + 1] = np.repeat(rank, counts)
    here, before, after = ranks[1:-1], ranks[:-2], ranks[2:]
    places = np.flatnonzero((here < none) & (before >= here) & (after >= here))
    # Neighbours of one rank are a run of one symbol: there every other pair is taken.
    inside = np.flatnonzero(before[places] == here[places])
    if len(inside):
        begins = np.flatnonzero(here != before)
        within = places[inside]
        odd = (within - begins[np.searchsorted(begins, within, "right") - 1]) % 2 == 1
        places = np.delete(places, inside[odd])
    used = np.bincount(here[places], minlength=none) >= MIN_PAIRS - 1
    places = places[used[here[places]]]
    return places, (np.cumsum(used) - 1)[here[places]], known[by_rank][used]


@dataclass
class Grammar:
    """A sequence of symbols; those from ``base`` on stand for pairs of older symbols."""

    base: int
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray         # expansion length of every rule
    symbols: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray) -> Grammar:
        """Replace frequent pairs until a round gains too little."""
        symbols = ids.astype(np.int64)
        base = int(symbols.max()) + 1 if len(symbols) else 0
        rules = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        lengths = np.ones(0, np.int64)
        while len(symbols) > 1:
            width = (base + len(lengths)).bit_length()
            places, numbers, pairs = _chosen(symbols[:-1] << width | symbols[1:])
            if len(places) < max(1, LEAST_GAIN * len(symbols)):
                break
            sizes = np.ones((2, len(pairs)), np.int64)
            halves = pairs >> width, pairs & ((1 << width) - 1)
            for side, part in enumerate(halves):
                older = part >= base
                sizes[side, older] = lengths[part[older] - base]
            symbols[places] = base + len(lengths) + numbers
            stays = np.ones(len(symbols), bool)
            stays[places + 1] = False
            symbols = symbols[stays]
            lengths = np.concatenate([lengths, sizes.sum(0)])
            rules.append(halves)
        left, right = (np.concatenate([r[side] for r in rules]) for side in (0, 1))
        return cls(base, left, right, lengths, symbols)

    def to_bytes(self) -> bytes:
        """Little-endian: mark, base, rules, symbols (u64); left, right, lengths, symbols (u32)."""
        head = np.array([_MAGIC[0], self.base, len(self.left), len(self.symbols)], "<u8")
        return head.tobytes() + b"".join(
            part.astype("<u4").tobytes() for part in (self.left, self.right, self.lengths, self.symbols))

    @classmethod
    def from_bytes(cls, content: bytes) -> Grammar:
        mark, base, rules, symbols = np.frombuffer(content, "<u8", 4).tolist()
        if mark != int(_MAGIC[0]) or len(content) != 32 + 4 * (3 * rules + symbols):
            raise ValueError("these bytes are no shard of token ids")
        body = np.frombuffer(content, "<u4", offset=32).astype(np.int64)
        return cls(base, *np.split(body, [rules, 2 * rules, 3 * rules]))

    def _sizes(self) -> np.ndarray:
        sizes = np.ones(len(self.symbols), np.int64)
        made = self.symbols >= self.base
        sizes[made] = self.lengths[self.symbols[made] - self.base]
        return sizes

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from ``start`` up to ``end``; only symbols that cover them are expanded."""
        ends = np.cumsum(self._sizes())
        total = int(ends[-1]) if len(ends) else 0
        end = total if end is None else min(end, total)
        if start >= end:
            return np.zeros(0, np.uint32)
        low = int(np.searchsorted(ends, start, "right"))
        high = int(np.searchsorted(ends, end, "left")) + 1
        skipped = int(ends[low - 1]) if low else 0
        part = self.symbols[low:high]
        while (made := part >= self.base).any():
            wider = np.repeat(part, 1 + made)
            places = np.flatnonzero(made) + np.arange(int(made.sum()))
            numbers = part[made] - self.base
            wider[places], wider[places + 1] = self.left[numbers], self.right[numbers]
            part = wider
        return part[start - skipped:end - skipped].astype(np.uint32)
