"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

Tokens are runs of alphanumeric characters and runs of symbols. Features are hashed
1-, 2- and 3-grams of tokens, and one feature for each distance 1 to 3 at which a
word repeats. A document's margin is a bias plus ``scale`` times the mean weight of
its features, so scoring is one sparse dot product over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from kpiloom.llm.common import RUNS, SPACED, labelled_sample, ngrams, per_text, text_parts, tokens

THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityParams:
    """``per_class`` and ``max_chars`` bound the training sample (rows and text length)."""

    bits: int = 18
    per_class: tuple[int, int] = (3000, 3000)
    max_chars: int = 20_000
    epochs: int = 3
    scale: float = 20.0
    alpha: float = 0.2
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    scale: float
    bits: int


def features(data: np.ndarray, offsets: np.ndarray, bits: int):
    """(bucket, token index, first index) of each stream of features of the texts."""
    shift = np.uint64(64 - bits)
    runs, _, _, first = tokens(data, offsets, RUNS)
    for n in (1, 2, 3):
        grams, at = ngrams(runs, first, n)
        yield (grams >> shift).astype(np.int64), at, first
    words, _, _, first = tokens(data, offsets, SPACED)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for lag in (1, 2, 3):
        at = np.flatnonzero((words[lag:] == words[:-lag]) & (text[lag:] == text[:-lag])) if len(words) > lag else np.empty(0, np.int64)
        yield np.full(len(at), lag, np.int64), at, first


def train(sample: pa.Table, params: QualityParams = QualityParams()) -> QualityModel:
    """Fit per-coordinate FTRL on a sample of columns text and label; an empty one gives 0.5 everywhere."""
    size = 1 << params.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    examples = []
    for text, label in zip(sample.column("text"), sample.column("label").to_pylist(), strict=True):
        raw = np.frombuffer(text.as_buffer(), np.uint8)
        found = np.concatenate([b for b, _, _ in features(raw, np.array([0, len(raw)]), params.bits)])
        where, counts = np.unique(found, return_counts=True)
        values = params.scale * counts / max(len(found), 1)
        examples.append((np.append(where, size).astype(np.int32), np.append(values, 1.0).astype(np.float32), label))
    l1 = np.full(size + 1, params.l1)
    l1[size] = 0.0

    def weights(at):
        zi = z[at]
        keep = np.abs(zi) > l1[at]
        return np.where(keep, -(zi - np.sign(zi) * l1[at]) / ((params.beta + np.sqrt(n[at])) / params.alpha + params.l2), 0.0)

    for _ in range(params.epochs):
        for at, x, y in examples:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / params.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    fitted = weights(np.arange(size + 1))
    return QualityModel(fitted[:size].astype(np.float32), float(fitted[size]), params.scale, params.bits)


def margins(model: QualityModel, column: pa.Array) -> np.ndarray:
    out = np.empty(len(column))
    for row, data, offsets in text_parts(column):
        total, count = 0.0, 0.0
        for where, at, first in features(data, offsets, model.bits):
            total = total + per_text(model.weights[where], at, first)
            count = count + np.diff(np.searchsorted(at, first))
        out[row : row + len(offsets) - 1] = model.bias + model.scale * total / np.maximum(count, 1)
    return out


def score(model: QualityModel, text: Column) -> Column:
    """Probability of label 1 for whole texts; a null or empty text gets the bias alone."""

    @arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(margins(model, column), -30, 30))))

    return run(text)


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    return train(labelled_sample(docs, labels, "quality", params.per_class, params.max_chars), params)


def classify(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """Append score and predicted to every document; columns of these names are replaced.

    Learning skips held-out documents; scoring reads the text only. Repeated rows
    are scored alike, an empty table gives an empty result.
    """
    model = fit(docs, labels, params)
    return docs.withColumn("score", score(model, F.col("text"))).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
