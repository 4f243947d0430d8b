"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the hashed embeddings of the word and of its first four
and six bytes. Filters one, two and three words wide run over the whole text, the largest response of each filter feeds a logistic output.
The decision threshold is calibrated by language. A score never sees the language
column: the language is guessed from the words, and the score is moved so that the
threshold of the guessed language becomes 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from kpiloom.llm.common import ALNUM, labelled_sample, lowered, mix, text_parts, tokens

THRESHOLD = 0.5


@dataclass(frozen=True)
class ToxicityParams:
    """``per_class`` and ``max_chars`` bound the training sample (rows and text length).

    Training makes ``epochs`` passes, and more over a small sample until it has made ``steps`` updates.
    """

    bits: int = 15
    dims: int = 8
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    per_class: tuple[int, int] = (6000, 2500)
    max_chars: int = 20_000
    epochs: int = 6
    steps: int = 600
    batch: int = 32
    rate: float = 0.01
    languages: int = 16
    seed: int = 7


@dataclass(frozen=True)
class ToxicityModel:
    embed: np.ndarray
    kernels: list[np.ndarray]
    offsets: list[np.ndarray]
    output: np.ndarray
    bias: float
    words_of: np.ndarray
    shift_of: np.ndarray
    bits: int
    gain: float = 1.0


PREFIXES = (4, 6)


def word_ids(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words, 3) of the word and its prefixes, and each text's first word."""
    hashes, _, _, first, *heads = tokens(lowered(data), offsets, ALNUM, PREFIXES)
    parts = [hashes, *[mix(h + np.uint64(k)) for k, h in enumerate(heads, 1)]]
    return np.stack([(h >> np.uint64(64 - bits)).astype(np.int32) for h in parts], axis=1), first


def _pooled(embed, kernels, biases, ids, first, argmax=False):
    """Largest rectified response of each filter in each text: (texts, filters), and its place if asked.

    Texts shorter than a filter are padded with zero vectors; a text without words responds 0.
    """
    texts = len(first) - 1
    widest = len(kernels[-1])
    counts = np.diff(first)
    # every text is followed by widest - 1 zero rows, so no window crosses into the next
    start = first[:-1] + np.arange(texts) * (widest - 1)
    place = np.arange(len(ids)) + np.repeat(np.arange(texts) * (widest - 1), counts)
    x = np.zeros((len(ids) + texts * (widest - 1) + widest, embed.shape[1]), np.float32)
    x[place] = embed[ids].sum(axis=1)
    pooled, places = [], []
    for kernel, bias in zip(kernels, biases, strict=True):
        flat = sum(x[k : k + len(x) - widest] @ kernel[k] for k in range(len(kernel)))
        out = np.zeros((texts, kernel.shape[2]), np.float32)
        at = np.full((texts, kernel.shape[2]), -1)
        some = np.flatnonzero(counts)
        if len(some):
            out[some] = np.maximum(np.maximum.reduceat(flat[place], first[some], axis=0) + bias, 0)
            if argmax:
                for t in some:
                    at[t] = start[t] + flat[start[t] : start[t] + counts[t]].argmax(axis=0)
        pooled.append(out)
        places.append(at)
    return np.hstack(pooled), places, x, place


def train(sample: pa.Table, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on columns text, lang and label by Adam; every fifth row only calibrates the thresholds."""
    rng = np.random.default_rng(params.seed)
    size = 1 << params.bits
    texts = sample.column("text").combine_chunks()
    labels = np.array(sample.column("label").to_pylist(), np.float32)
    langs = [x or "" for x in sample.column("lang").to_pylist()]
    ids = []
    for text in texts:
        raw = np.frombuffer(text.as_buffer(), np.uint8)
        ids.append(word_ids(raw, np.array([0, len(raw)]), params.bits)[0])
    fold = np.arange(len(texts)) % 5 == 0
    learn = np.flatnonzero(~fold)
    names = sorted(set(langs), key=lambda x: (-langs.count(x), x))[: params.languages] or [""]

    # document frequencies by class start the first dimensions at each bucket's log odds
    streams = 1 + len(PREFIXES)
    seen = np.zeros((streams, 2, size))
    spoken = np.zeros((len(names), size), np.float32)
    for i in learn:
        for k in range(streams):
            seen[k, int(labels[i]), np.unique(ids[i][:, k])] += 1
        if langs[i] in names:
            np.add.at(spoken[names.index(langs[i])], ids[i][:, 0], 1)
    totals = np.maximum([np.sum(labels[learn] == 0), np.sum(labels[learn] == 1)], 1)
    odds = np.log((seen[:, 1] + 1) / (totals[1] + 2)) - np.log((seen[:, 0] + 1) / (totals[0] + 2))
    odds[seen.sum(axis=1) < 4] = 0
    embed = rng.normal(0, 0.05, (size, params.dims)).astype(np.float32)
    embed[:, :streams] = np.clip(odds, -4, 4).T / 2
    kernels = [rng.normal(0, 0.3 / w, (w, params.dims, params.filters)).astype(np.float32) for w in params.widths]
    for kernel in kernels:
        kernel[:, :streams, : params.filters // 2] += 0.5 / len(kernel)
    biases = [np.zeros(params.filters, np.float32) for _ in params.widths]
    output = np.full(params.filters * len(kernels), 0.2, np.float32)
    bias = np.zeros(1, np.float32)
    dense = [*kernels, *biases, output, bias]
    first_m, second_m = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    slow = np.zeros_like(embed)
    step = 0
    for _ in range(max(params.epochs, -(-params.steps * params.batch // max(len(learn), 1)) if len(learn) else 0)):
        order = rng.permutation(learn)
        for at in range(0, len(order), params.batch):
            rows = order[at : at + params.batch]
            flat = np.concatenate([ids[i] for i in rows])
            first = np.concatenate([[0], np.cumsum([len(ids[i]) for i in rows])])
            pooled, places, x, place = _pooled(embed, kernels, biases, flat, first, argmax=True)
            p = 1 / (1 + np.exp(-np.clip(pooled @ output + bias[0], -30, 30)))
            error = (p - labels[rows]) / len(rows)
            back = np.outer(error, output).astype(np.float32) * (pooled > 0)
            grads, bias_grads = [], []
            dx = np.zeros_like(x)
            for k, kernel in enumerate(kernels):
                part = back[:, k * params.filters : (k + 1) * params.filters]
                grad = np.zeros_like(kernel)
                t, f = np.nonzero(part)
                pos, value = places[k][t, f], part[t, f]
                for j in range(len(kernel)):
                    np.add.at(grad[j].T, f, x[pos + j] * value[:, None])
                    np.add.at(dx, pos + j, kernel[j][:, f].T * value[:, None])
                grads.append(grad)
                bias_grads.append(part.sum(axis=0))
            step += 1
            moved = [*grads, *bias_grads, pooled.T @ error, np.array([error.sum()], np.float32)]
            for p_, g, m, v in zip(dense, moved, first_m, second_m, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p_ -= params.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            touched = np.flatnonzero(np.any(dx[place], axis=1))
            where, back_to = np.unique(flat[touched].reshape(-1), return_inverse=True)
            g = np.zeros((len(where), params.dims), np.float32)
            np.add.at(g, back_to, np.repeat(dx[place[touched]], streams, axis=0))
            slow[where] += g * g
            embed[where] -= 0.02 * g / (np.sqrt(slow[where]) + 1e-4)

    spread = np.log((spoken + 0.1) / (spoken.sum(axis=1, keepdims=True) + 0.1 * size)).T.astype(np.float32)
    model = ToxicityModel(embed, kernels, biases, output, float(bias[0]), spread, np.zeros(len(names), np.float32), params.bits)
    held = np.flatnonzero(fold)
    gain, shifts = 1.0, np.zeros(len(names), np.float32)
    if len(held):
        logits, _ = raw_logits(model, texts.take(pa.array(held)))
        mine = np.array([names.index(langs[i]) if langs[i] in names else -1 for i in held])
        gain, shifts = _calibrate(logits, labels[held], mine, len(names))
    return ToxicityModel(embed, kernels, biases, output, float(bias[0]), spread, shifts, params.bits, gain)


def _calibrate(logits: np.ndarray, labels: np.ndarray, group: np.ndarray, groups: int) -> tuple[float, np.ndarray]:
    """A common gain and a threshold for each language, by penalised logistic regression.

    A language with few rows keeps the common threshold: its own part is penalised.
    """
    x = np.zeros((len(logits), 2 + groups))
    x[:, 0], x[:, 1] = np.clip(logits, -12, 12), 1
    some = group >= 0
    x[np.flatnonzero(some), 2 + group[some]] = 1
    w = np.zeros(2 + groups)
    w[0] = 1.0
    prior = w.copy()
    penalty = np.array([0.5, 0.01, *[0.5] * groups])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + penalty * (w - prior)
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        w -= np.clip(np.linalg.solve(curve, slope), -2, 2)
    gain = max(float(w[0]), 0.1)
    return gain, np.clip(-(w[1] + w[2:]) / gain, -8, 8).astype(np.float32)


def raw_logits(model: ToxicityModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Uncalibrated logits and the index of the guessed language, for whole texts."""
    logits, spoken = np.empty(len(column)), np.zeros(len(column), np.int64)
    for row, data, offsets in text_parts(column):
        ids, first = word_ids(data, offsets, model.bits)
        n = len(offsets) - 1
        pooled = _long_pooled(model, ids) if n == 1 else _pooled(model.embed, model.kernels, model.offsets, ids, first)[0]
        logits[row : row + n] = pooled @ model.output + model.bias
        some = np.flatnonzero(np.diff(first))
        if len(some):
            sums = np.add.reduceat(model.words_of[ids[:, 0]], first[some], axis=0)
            spoken[row + some] = sums.argmax(axis=1)
    return logits, spoken


def _long_pooled(model: ToxicityModel, ids: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """One text of any length, in overlapping parts; the largest response is over all of it."""
    widest = len(model.kernels[-1])
    best = None
    for at in range(0, max(len(ids), 1), step):
        part = ids[at : at + step + widest - 1]
        out = _pooled(model.embed, model.kernels, model.offsets, part, np.array([0, len(part)]))[0]
        best = out if best is None else np.maximum(best, out)
    return best


def probabilities(model: ToxicityModel, column: pa.Array) -> np.ndarray:
    logits, spoken = raw_logits(model, column)
    return 1 / (1 + np.exp(-np.clip(model.gain * (logits - model.shift_of[spoken]), -30, 30)))


def score(model: ToxicityModel, text: Column) -> Column:
    """Calibrated probability of label 1 for whole texts; a null or empty text gets the bias alone."""

    @arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(probabilities(model, column))

    return run(text)


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    return train(labelled_sample(docs, labels, "toxic", params.per_class, params.max_chars), params)


def classify(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Append score and predicted to every document; columns of these names are replaced.

    Learning skips held-out documents; scoring reads the text only. Repeated rows
    are scored alike, an empty table gives an empty result.
    """
    model = fit(docs, labels, params)
    return docs.withColumn("score", score(model, F.col("text"))).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
