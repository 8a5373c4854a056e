"""Hashed word and character n-gram features of whole texts, as dense rows."""

from __future__ import annotations

import numpy as np

from loomdex.llm.word_arrays import Words, mixed

CHARACTER_SIZES = (2, 4)


def _columns(hashes: np.ndarray, width: int) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % width


def hashed_rows(words: Words, word_width: int, character_width: int) -> np.ndarray:
    """Per text: damped counts of its words, word pairs and character n-grams.

    Each of the two blocks has unit length, or is zero where a text has no such items.
    Case and punctuation count. Characters are taken as UTF-8 bytes.
    """
    rows = len(words.counts)
    of_word = np.repeat(np.arange(rows), words.counts)
    flat = np.zeros(rows * word_width, np.float32)
    flat += np.bincount(of_word * word_width + _columns(words.hashes, word_width),
                        minlength=len(flat))
    if len(words.hashes) > 1:
        same = of_word[1:] == of_word[:-1]
        pairs = mixed(words.hashes[:-1] * np.uint64(3) + words.hashes[1:])[same]
        flat += np.bincount(of_word[:-1][same] * word_width + _columns(pairs, word_width),
                            minlength=len(flat))
    blocks = [flat.reshape(rows, word_width)]
    lengths = np.diff(words.row_starts)
    of_byte = np.repeat(np.arange(rows), lengths)
    data = words.data.astype(np.uint64)
    flat = np.zeros(rows * character_width, np.float32)
    for size in CHARACTER_SIZES:
        if len(data) < size:
            continue
        key = np.zeros(len(data) - size + 1, np.uint64)
        for j in range(size):
            key = key * np.uint64(257) + data[j:len(data) - size + 1 + j]
        own = of_byte[: len(key)] == of_byte[size - 1:]
        flat += np.bincount(
            of_byte[: len(key)][own] * character_width
            + _columns(mixed(key + np.uint64(size)), character_width)[own], minlength=len(flat))
    blocks.append(flat.reshape(rows, character_width))
    out = np.log1p(np.concatenate(blocks, 1))
    for a, b in ((0, word_width), (word_width, word_width + character_width)):
        norm = np.linalg.norm(out[:, a:b], axis=1, keepdims=True)
        out[:, a:b] /= np.where(norm > 0, norm, 1)
    out[words.counts == 0] = 0
    return out


def shape_rows(words: Words) -> np.ndarray:
    """Per text, shares in [0, 1]: capitals, digits, ASCII symbols, repeated words, repeated
    neighbours, vertical bars, and a damped word count."""
    rows = len(words.counts)
    d = words.data
    kinds = [(d >= 65) & (d <= 90), (d >= 48) & (d <= 57),
             ((d >= 33) & (d <= 47)) | ((d >= 58) & (d <= 64)) | (d >= 91) & (d <= 96)
             | ((d >= 123) & (d <= 126)), d == 124]
    size = np.maximum(np.diff(words.row_starts) - 1, 1)
    per_text = [np.add.reduceat(k.astype(np.int64), words.row_starts[:-1]) / size for k in kinds]
    of_word = np.repeat(np.arange(rows), words.counts)
    n = np.maximum(words.counts, 1)
    h = words.hashes
    order = np.lexsort((h, of_word))
    again = (h[order][1:] == h[order][:-1]) & (of_word[order][1:] == of_word[order][:-1])
    repeated = np.bincount(of_word[order][1:][again], minlength=rows) / n
    beside = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    neighbours = np.bincount(of_word[1:][beside], minlength=rows) / n
    return np.stack([*per_text, repeated, neighbours,
                     np.log1p(words.counts) / 12], 1).astype(np.float32)
