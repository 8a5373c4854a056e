"""Vectors: the offline hashed embedder, cosine, and sign sketches."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# An embedder turns a list of texts into one row of a matrix per text.
Embedder = Callable[[Sequence[str]], np.ndarray]

HASH_BUCKETS = 1024
KNOWN_TERMS = 1 << 16       # terms whose bucket a worker remembers, whatever the corpus holds
_WORD = re.compile(r"[a-z]+")


def hash_bucket(term: Column, buckets: int = HASH_BUCKETS) -> Column:
    """Bucket of a term: the first seven hex digits of its MD5, modulo the size."""
    return (F.conv(F.substring(F.md5(term), 1, 7), 16, 10).cast("long") % buckets).cast("int")


def terms(text: Column) -> Column:
    """All lower-case a-z runs of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


class _Buckets(dict):
    """Bucket per term, filled on first use. A cache, not a vocabulary: it starts
    anew when it holds KNOWN_TERMS terms. Terms of one bucket share its number."""

    def __init__(self, size: int):
        super().__init__()
        self.numbers = list(range(size))

    def __missing__(self, term: str) -> int:
        if len(self) >= KNOWN_TERMS:
            self.clear()
        at = self.numbers[int(hashlib.md5(term.encode()).hexdigest()[:7], 16) % len(self.numbers)]
        self[term] = at
        return at


def hashed_embedder(buckets: int = HASH_BUCKETS) -> Embedder:
    """Term counts per hash bucket. Counts are whole numbers, so dot products are exact."""
    bucket_of = None

    def embed(texts: Sequence[str]) -> np.ndarray:
        nonlocal bucket_of
        if bucket_of is None:  # made in the worker, so that no cache is shipped
            bucket_of = _Buckets(buckets)
        counts = np.zeros((len(texts), buckets), dtype=np.float32)
        for row, text in enumerate(texts):
            found = list(map(bucket_of.__getitem__, _WORD.findall(text.lower())))
            if found:
                counts[row] = np.bincount(found, minlength=buckets)
        return counts

    return embed


def dot(left: Column, right: Column) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(left: Column, right: Column) -> Column:
    norms = F.sqrt(dot(left, left) * dot(right, right))
    return F.when(norms > 0, dot(left, right) / norms)


def score_of(cosine_value: Column) -> Column:
    """Cosine mapped to 0..1, order-preserving."""
    return (F.lit(1.0) + cosine_value) / F.lit(2.0)


def sign_sketcher(dimension: int, bits: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """Signs of fixed random projections, packed to ``bits / 8`` bytes per vector."""
    planes = np.random.default_rng(seed).standard_normal((dimension, bits))

    def sketch(matrix: np.ndarray) -> np.ndarray:
        return np.packbits(matrix.astype(np.float64) @ planes >= 0, axis=1)

    return sketch
