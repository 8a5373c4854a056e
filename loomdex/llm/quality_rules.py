"""Quality rules: fixed limits on counts, and a calibrated logistic regression.

The regression works on hashed word and character n-grams, is fitted on a bounded
sample of labelled documents, is calibrated on folds it was not fitted on, and scores
every document in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomdex.llm.labelled_rows import MAX_LABELLED, fitted
from loomdex.llm.text_features import hashed_rows
from loomdex.llm.word_arrays import Words, slices

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
REPEAT_WINDOW = 8
MIN_PROBABILITY = 0.5       # documents whose calibrated probability is lower are rejected
NGRAM_COLUMNS = 1024        # hashed columns of word n-grams, and as many of characters
_STEPS, _RATE, _PENALTY = 400, 8.0, 1e-4
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _ngrams(words: Words) -> np.ndarray:
    return hashed_rows(words, NGRAM_COLUMNS, NGRAM_COLUMNS)


@dataclass
class LogisticModel:
    weights: np.ndarray
    bias: float
    slope: float        # calibration: sigmoid(slope * margin + shift)
    shift: float

    def parts(self) -> tuple:
        """Plain values: a broadcast of the class would need this package in the workers."""
        return self.weights, self.bias, self.slope, self.shift

    def probability(self, rows: np.ndarray) -> np.ndarray:
        margin = rows @ self.weights + self.bias
        return _sigmoid(self.slope * margin.astype(np.float64) + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _regression(rows: np.ndarray, quality: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias from the rows that are ``used``; both classes weigh the same."""
    share = np.clip(quality[used].mean(), 1e-6, 1 - 1e-6)
    each = used * np.where(quality == 1, 0.5 / share, 0.5 / (1 - share)) / used.sum()
    weights, speed = np.zeros(rows.shape[1], np.float32), np.zeros(rows.shape[1], np.float32)
    bias = bias_speed = 0.0
    for _ in range(_STEPS):
        error = ((_sigmoid(rows @ weights + bias) - quality) * each).astype(np.float32)
        speed = 0.9 * speed - _RATE * (rows.T @ error + _PENALTY * weights)
        bias_speed = 0.9 * bias_speed - _RATE * float(error.sum())
        weights, bias = weights + speed, bias + bias_speed
    return weights.astype(np.float32), bias


def _calibrated(margins: np.ndarray, quality: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits held-out margins, by Newton steps."""
    rows = np.stack([margins, np.ones(len(margins))], 1)
    ones = quality.sum()
    target = np.where(quality == 1, (ones + 1) / (ones + 2), 1 / (len(quality) - ones + 2))
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(rows @ at)
        hessian = (rows * (p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, rows.T @ (p - target) + 1e-3 * (at - [1.0, 0.0]))
        at = at - np.clip(step, -1, 1)
    return max(float(at[0]), 1e-3), float(at[1])


def _fit(rows: np.ndarray, quality: np.ndarray, fold: np.ndarray) -> tuple | None:
    if len(set(quality.tolist())) < 2:
        return None
    margins = np.zeros(len(quality))
    for f in range(5):
        out = fold == f
        if out.any() and len(set(quality[~out].tolist())) == 2:
            weights, bias = _regression(rows, quality, ~out)
            margins[out] = rows[out] @ weights + bias
    weights, bias = _regression(rows, quality, np.ones(len(quality), bool))
    return weights, bias, *_calibrated(margins, quality)


def fit(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> LogisticModel | None:
    """Fit on at most ``max_labelled`` rows of ``labels`` (documentId, quality 0/1).

    None where fewer than two classes are labelled; then only the fixed limits decide.
    """
    found = fitted(documents, labels, _ngrams, _fit, max_labelled)
    return found and LogisticModel(*found)


def signals(words: Words) -> dict[str, np.ndarray]:
    """Counts per text: words, their characters, symbols, repeated lines and words."""
    rows = len(words.counts)
    data, starts, ends = words.data, words.starts, words.ends
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])     # code points
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
    edges = words.row_starts
    in_words = np.concatenate([[0], np.cumsum(before[ends] - before[starts])])
    out = {
        "nWords": words.counts,
        "wordChars": np.diff(in_words[words.first]),
        "nSymbols": np.diff(symbols[edges]),
        "nDupLines": np.zeros(rows, np.int64),
        "nRepeatWords": np.zeros(rows, np.int64),
    }
    windows = words.windows(REPEAT_WINDOW)
    # Windows of the whole slice, numbered by row, so that one sort finds the repeated ones.
    inside = words.counts - REPEAT_WINDOW + 1
    kept = np.repeat(words.first[:-1] + np.maximum(inside, 0), words.counts)
    valid = np.flatnonzero(np.arange(len(windows)) < kept)
    of_row = np.repeat(np.arange(rows), words.counts)
    order = valid[np.lexsort((windows[valid], of_row[valid]))]
    same = (windows[order][1:] == windows[order][:-1]) & (of_row[order][1:] == of_row[order][:-1])
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    cover = np.zeros(len(windows) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, np.minimum(twice + REPEAT_WINDOW, len(windows)), -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    out["nRepeatWords"] = np.diff(covered[words.first])
    for i in range(rows):
        text = words.bytes[edges[i]:edges[i + 1] - 1]
        if b"\n" in text:
            lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\v\f\r")]
            out["nDupLines"][i] = len(lines) - len(set(lines))
    return out


def _verdicts(texts: list[str | None], model: LogisticModel | None):
    """Counts, base rule, probabilities (None without a model) and verdicts of texts."""
    words = Words(texts)
    found = signals(words)
    failed = ((found["nWords"] < MIN_WORDS) | (
        100 * found["nRepeatWords"] > MAX_REPEATED_PERCENT * found["nWords"]))
    if model is None:
        return found, failed, None, ~failed
    probability = model.probability(_ngrams(words))
    return found, failed, probability, ~failed & (probability >= MIN_PROBABILITY)


def judged(documents: DataFrame, model: LogisticModel | None) -> DataFrame:
    """Counts, base rule, probability and verdict of every whole document.

    ``documents``: document records (``documentId``, ``text``); other columns are ignored.
    Returns documentId, nWords, wordChars, nSymbols, nDupLines, nRepeatWords (long),
    baseFailed, probability (null without a model) and kept. Null and empty texts have no
    words and fail the base rule. Rows map to rows; equal texts get equal verdicts.
    """
    rows = documents.select("documentId", "text")
    shared = documents.sparkSession.sparkContext.broadcast(model and model.parts())
    counts = ("nWords", "wordChars", "nSymbols", "nDupLines", "nRepeatWords")
    out = T.StructType([
        T.StructField("documentId", rows.schema["documentId"].dataType),
        *[T.StructField(c, T.LongType()) for c in counts],
        T.StructField("baseFailed", T.BooleanType()), T.StructField("probability", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value and LogisticModel(*shared.value)
        for piece, texts in slices(batches, 1):
            found, failed, probability, kept = _verdicts(texts, model)
            if probability is None:
                probability = pa.nulls(len(texts), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), *[pa.array(found[c].astype(np.int64)) for c in counts],
                 pa.array(failed), pa.array(probability), pa.array(kept)], names=out.names)

    return rows.mapInArrow(run, out)


def kept(documents: DataFrame, model: LogisticModel | None) -> DataFrame:
    """The document rows, with all their columns, that ``judged`` keeps; nothing is shuffled."""
    shared = documents.sparkSession.sparkContext.broadcast(model and model.parts())
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value and LogisticModel(*shared.value)
        for piece, texts in slices(batches, place):
            yield piece.filter(pa.array(_verdicts(texts, model)[3]))

    return documents.mapInArrow(run, documents.schema)
