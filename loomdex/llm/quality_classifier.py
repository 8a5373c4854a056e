"""Document quality by votes of labelled neighbours in a latent-semantic space.

Hashed terms of a bounded, labelled sample are weighted by rarity and reduced by a
truncated singular value decomposition. The labelled vectors are broadcast; every
document is compared with all of them in exact blocked cosine products, and its
nearest neighbours vote with weights that grow with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomdex.llm.labelled_rows import MAX_LABELLED, fitted
from loomdex.llm.text_features import hashed_rows, shape_rows
from loomdex.llm.word_arrays import Words, slices

TERM_COLUMNS = 1024         # hashed columns of words, and as many of character n-grams
DIMENSIONS = 32
NEIGHBOURS = 40
SIMILARITY_POWER = 4
_ROUNDS = 6                 # power iterations of the decomposition


def _terms(words: Words) -> np.ndarray:
    return np.concatenate([hashed_rows(words, TERM_COLUMNS, TERM_COLUMNS), shape_rows(words)], 1)


@dataclass
class NeighbourModel:
    centre: np.ndarray          # of the weighted terms
    projection: np.ndarray      # terms -> latent space
    vectors: np.ndarray         # of the labelled documents, unit length
    quality: np.ndarray

    def parts(self) -> tuple[np.ndarray, ...]:
        """Plain arrays: a broadcast of the class would need this package in the workers."""
        return self.centre, self.projection, self.vectors, self.quality

    def latent(self, terms: np.ndarray) -> np.ndarray:
        out = (terms - self.centre) @ self.projection
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """Weighted share of neighbours with label 1; 0.5 where nothing was labelled.

        All neighbours as near as the last of the NEIGHBOURS vote, so ties need no order.
        """
        n = len(self.quality)
        if n == 0:
            return np.full(len(terms), 0.5)
        cosine = self.latent(terms) @ self.vectors.T
        k = min(NEIGHBOURS, n)
        last = np.partition(cosine, n - k, axis=1)[:, n - k, None]
        weight = np.where(cosine >= last, np.maximum(cosine, 0), 0).astype(np.float64)
        weight = weight**SIMILARITY_POWER + 1e-12 * (cosine >= last)
        return np.clip(weight @ self.quality / weight.sum(1), 0.0, 1.0)


def _decomposed(rows: np.ndarray, dimensions: int) -> np.ndarray:
    """Right singular vectors of the largest singular values, by power iteration."""
    width = min(dimensions + 8, *rows.shape)
    basis = np.random.default_rng(7).standard_normal((rows.shape[1], width)).astype(np.float32)
    for _ in range(_ROUNDS):
        basis, _r = np.linalg.qr(rows.T @ (rows @ basis))
    _u, _s, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ turn.T)[:, :dimensions]


def _fit(terms: np.ndarray, quality: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(terms):
        none = np.zeros((0, DIMENSIONS), np.float32)
        return (np.zeros(terms.shape[1], np.float32),
                np.zeros((terms.shape[1], DIMENSIONS), np.float32), none, quality)
    hashed = 2 * TERM_COLUMNS
    weight = np.log(1 / ((terms > 0).mean(0) + 1e-3))
    weight[hashed:] = 1 / (terms[:, hashed:].std(0) + 1e-6)
    weight = np.maximum(weight, 0).astype(np.float32)
    centre = terms.mean(0)
    centre[:hashed] = 0
    axes = _decomposed((terms - centre) * weight, DIMENSIONS)
    model = NeighbourModel(centre, (weight[:, None] * axes).astype(np.float32),
                           np.zeros((0, 0), np.float32), quality)
    model.vectors = model.latent(terms)
    return model.parts()


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> NeighbourModel:
    """Fit on at most ``max_labelled`` rows of ``labels`` (documentId, quality 0/1)."""
    return NeighbourModel(*fitted(documents, labels, _terms, _fit, max_labelled))


def score(documents: DataFrame, model: NeighbourModel) -> DataFrame:
    """documentId and score (0 to 1, higher: label 1 is likelier) of every whole text.

    ``documents``: document records (``documentId``, ``text``); other columns are ignored
    and no identifier, category or source enters the score. Null and empty texts are scored
    like a text without terms. Repeated rows stay; equal texts get equal scores.
    """
    rows = documents.select("documentId", "text")
    shared = documents.sparkSession.sparkContext.broadcast(model.parts())
    out = T.StructType([T.StructField("documentId", rows.schema["documentId"].dataType),
                        T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = NeighbourModel(*shared.value)
        for piece, texts in slices(batches, 1):
            for at in range(0, len(texts), 256):
                scores = model.score(_terms(Words(texts[at:at + 256])))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).slice(at, 256), pa.array(scores, pa.float64())],
                    names=["documentId", "score"])

    return rows.mapInArrow(run, out)
