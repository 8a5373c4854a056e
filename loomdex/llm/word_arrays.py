"""Words and shingles of many texts at once, as numpy arrays inside a task.

A word is a run of bytes other than blank, tab, LF, VT, FF and CR. All of these
separators are ASCII, so words of UTF-8 text can be found on its bytes. Hashes are
64 bits wide and depend on nothing but the bytes.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE_WORDS = 5
SLICE_BYTES = 1 << 19       # texts are hashed in slices of about this many bytes
_BASE = 0x9E3779B97F4A7C15 | 1

_LETTERS = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit multipliers that are the same everywhere."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
                 + np.uint64(seed)) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def worker_cached(key: Any, make: Callable[[], Any]) -> Any:
    """A value made once per Python worker, although functions travel by value."""
    store = sys.__dict__.setdefault("_loomdex_worker_values", {})
    if key not in store:
        store[key] = make()
    return store[key]


def memory_returned() -> None:
    """Give freed memory back to the system: a worker keeps it while it waits for its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, for n positions at least."""
    held = worker_cached("powers", dict)
    if held.get("n", 0) < n:
        size = max(n, SLICE_BYTES + (1 << 17))
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        held.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return held["up"], held["down"]


class Words:
    """The words of a list of texts: byte ranges and hashes, and their rows' ranges."""

    def __init__(
        self, texts: list[str | None], lower: bool = False, letters: bool = False,
    ) -> None:
        """``lower``: A-Z count as a-z. ``letters``: case is ignored wholly, and every ASCII
        character but letters and digits separates words."""
        if letters:
            texts = [(t or "").lower() for t in texts]
        parts = [(t or "").encode("utf-8", "replace") for t in texts]
        joined = b" ".join([*parts, b""])
        data = np.frombuffer(joined, np.uint8)
        if lower:
            data = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
        self.data, self.bytes = data, data.tobytes() if lower else joined
        lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.row_starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        if letters:
            inside = _LETTERS[data]
        else:
            inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        #: Words of row i are first[i] up to first[i + 1].
        self.first = np.searchsorted(self.starts, self.row_starts)
        self.counts = np.diff(self.first)
        up, down = _powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        raw = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        self.hashes = mixed(raw + (self.ends - self.starts).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.bytes[self.starts[i]:self.ends[i]]

    def ranges(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the word ranges first up to end (not included)."""
        up, down = _powers(len(self.hashes) + 1)
        sums = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(mixed(self.hashes + np.uint64(5)) * up[: len(self.hashes)], out=sums[1:])
        return mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))

    def windows(self, size: int, seed: int = 0) -> np.ndarray:
        """Hash of the window that starts at each word; the last ones run past their row."""
        total = len(self.hashes)
        out = np.zeros(total, np.uint64)
        for j, c in enumerate(_constants(size, seed + size)):
            out[: max(0, total - j)] += self.hashes[j:] * c
        return mixed(out)

    def row_windows(self, row: int, windows: np.ndarray, size: int) -> np.ndarray:
        """The windows that lie within a row."""
        a, b = self.first[row], self.first[row + 1]
        return windows[a:max(a, b - size + 1)]

    def shingles(self, row: int, windows: np.ndarray) -> np.ndarray:
        """Sorted distinct shingles of a row; fewer words count as one shingle."""
        a, b = self.first[row], self.first[row + 1]
        if a == b:
            return windows[:0]
        if b - a < SHINGLE_WORDS:
            mult = _constants(SHINGLE_WORDS, 77)[: b - a]
            return mixed(np.array([(self.hashes[a:b] * mult).sum(dtype=np.uint64)
                                   + np.uint64(b - a)], np.uint64))
        return np.unique(windows[a:b - SHINGLE_WORDS + 1])


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES,
           ) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Pieces of the batches with about ``most`` bytes of text each, and their texts."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().tolist()
        start = size = 0
        for i, n in enumerate(sizes):
            size += n
            if size >= most or i + 1 == len(sizes):
                piece = batch.slice(start, i + 1 - start)
                yield piece, piece.column(text).to_pylist()
                start, size = i + 1, 0
    batch = piece = None
    memory_returned()
