"""Language ID: a byte convolutional network with several widths and max pooling, trained in numpy.

A filter w bytes wide is a table of 256 values for each of its w places. Texts are
cut into windows of a fixed number of bytes; each filter's largest response in a
window feeds a softmax, and a text's prediction is that of the mean log
probabilities of all its windows, weighted by their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from kpiloom.llm.common import held_out, lowered, mix, text_parts

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageParams:
    """About ``per_language`` texts are learned from, ``max_chars`` characters of each at most, and
    at most ``languages`` languages, those with the most texts to learn from first; ties by name."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    per_language: int = 500
    max_chars: int = 20_000
    languages: int = 256
    crops: int = 6
    epochs: int = 8
    batch: int = 64
    rate: float = 0.02
    seed: int = 11


@dataclass(frozen=True)
class LanguageModel:
    names: list[str]
    tables: list[np.ndarray]  # by width: (width, 256, filters)
    biases: list[np.ndarray]
    output: np.ndarray
    bias: np.ndarray
    window: int


def _responses(tables: np.ndarray, windows: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Filter responses at every place of (n, window) bytes; places beyond a text are very low."""
    width = len(tables)
    flat = windows.reshape(-1)
    padded = np.concatenate([flat, np.zeros(width, np.uint8)])
    out = np.take(tables[0], flat, axis=0)
    for j in range(1, width):
        out += np.take(tables[j], padded[j : j + len(flat)], axis=0)
    out = out.reshape(*windows.shape, -1)
    places = np.arange(windows.shape[1])
    beyond = (places[None, :] > np.maximum(valid - width, 0)[:, None])
    if beyond[:-1, : windows.shape[1] - width + 1].any() or beyond[-1:, : windows.shape[1] - width + 1].any():
        out[beyond] = -1e9
        return out
    return out[:, : windows.shape[1] - width + 1]


def _forward(model: LanguageModel, windows: np.ndarray, valid: np.ndarray, places: bool = False):
    pooled, at = [], []
    for tables, bias in zip(model.tables, model.biases, strict=True):
        out = _responses(tables, windows, valid)
        if places:
            at.append(out.argmax(axis=1))
        pooled.append(np.maximum(out.max(axis=1) + bias, 0))
    x = np.hstack(pooled)
    z = x @ model.output + model.bias
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True)), x, at


def train(sample: pa.Table, params: LanguageParams = LanguageParams()) -> LanguageModel:
    """Fit on columns text and lang by Adam over windows and shorter crops of the texts."""
    rng = np.random.default_rng(params.seed)
    langs = sample.column("lang").to_pylist()
    counts = {x: langs.count(x) for x in set(langs)}
    names = sorted(counts, key=lambda x: (-counts[x], x))[: params.languages] or [UNKNOWN]
    rows, valid, target = [], [], []
    for text, lang in zip(sample.column("text").to_pylist(), langs, strict=True):
        raw = lowered(np.frombuffer(text.encode(), np.uint8))
        if lang not in names or not len(raw):
            continue
        for _ in range(params.crops):
            size = params.window if rng.random() < 0.6 else int(rng.integers(12, params.window))
            start = int(rng.integers(0, max(len(raw) - size, 0) + 1))
            piece = raw[start : start + size]
            rows.append(np.pad(piece, (0, params.window - len(piece))))
            valid.append(len(piece))
            target.append(names.index(lang))
    tables = [rng.normal(0, 0.5, (w, 256, params.filters)).astype(np.float32) for w in params.widths]
    biases = [np.zeros(params.filters, np.float32) for _ in params.widths]
    output = rng.normal(0, 0.1, (params.filters * len(tables), len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    model = LanguageModel(names, tables, biases, output, bias, params.window)
    if not rows:
        return model
    windows, valid, target = np.stack(rows), np.array(valid), np.array(target)
    weight = len(target) / (len(names) * np.bincount(target, minlength=len(names)).clip(1))
    dense = [*tables, *biases, output, bias]
    first_m, second_m = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    step = 0
    for _ in range(params.epochs):
        order = rng.permutation(len(windows))
        for start in range(0, len(order), params.batch):
            pick = order[start : start + params.batch]
            logp, x, at = _forward(model, windows[pick], valid[pick], places=True)
            error = np.exp(logp)
            error[np.arange(len(pick)), target[pick]] -= 1
            error *= (weight[target[pick]] / len(pick))[:, None].astype(np.float32)
            back = (error @ output.T) * (x > 0)
            padded = np.pad(windows[pick], ((0, 0), (0, max(params.widths))))
            grads, bias_grads = [], []
            for k, t in enumerate(tables):
                part = back[:, k * params.filters : (k + 1) * params.filters]
                grad = np.zeros_like(t)
                row = np.arange(len(pick))[:, None]
                for j in range(len(t)):
                    np.add.at(grad[j], (padded[row, at[k] + j], np.arange(params.filters)[None, :]), part)
                grads.append(grad)
                bias_grads.append(part.sum(axis=0))
            step += 1
            for p, g, m, v in zip(dense, [*grads, *bias_grads, x.T @ error, error.sum(axis=0)], first_m, second_m, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= params.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def log_probabilities(model: LanguageModel, column: pa.Array) -> np.ndarray:
    """Mean log probabilities (texts, languages) over all windows of each text, weighted by length."""
    out = np.zeros((len(column), len(model.names)))
    size = model.window
    for row, data, offsets in text_parts(column, 1 << 18):
        lengths = np.diff(offsets)
        cuts = -(-lengths // size)
        owner = np.repeat(np.arange(len(lengths)), cuts)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = offsets[owner] + nth * size
        valid = np.minimum(size, offsets[owner + 1] - start)
        body = np.concatenate([lowered(data), np.zeros(size, np.uint8)])
        places = np.arange(size)
        for at in range(0, len(owner), 512):
            some = slice(at, at + 512)
            windows = body[start[some, None] + places[None, :]]
            windows[places[None, :] >= valid[some, None]] = 0
            logp, _, _ = _forward(model, windows, valid[some])
            np.add.at(out, row + owner[some], logp * valid[some, None])
        out[row : row + len(lengths)] /= np.maximum(lengths, 1)[:, None]
    return out


def predict(model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred, score) of whole texts.

    A text that is null or has no letter is ``und`` with score 0. The score is the
    softmax of the mean log probabilities at the predicted language; ties go to the
    more frequent language.
    """

    @arrow_udf("struct<lang_pred:string,score:double>")
    def run(column: pa.Array) -> pa.Array:
        logp = log_probabilities(model, column)
        best = logp.argmax(axis=1)
        z = np.exp(logp - logp.max(axis=1, keepdims=True))
        names = pa.array(model.names).take(pa.array(best))
        score = pa.array(z[np.arange(len(best)), best] / z.sum(axis=1))
        return pa.StructArray.from_arrays([names, score], ["lang_pred", "score"])

    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return F.when(F.coalesce(text.rlike("\\p{L}"), F.lit(False)), run(text)).otherwise(nothing)


def _piece(doc_id: Column, text: Column, most: int) -> Column:
    """The text, or ``most`` characters of a longer one at a place taken from a hash of the id.

    If those hold no letter, they begin at the text's first letter instead.
    """
    drawn = F.substring(text, F.pmod(F.xxhash64(doc_id, F.lit(1)), F.length(text) - most + 1).cast("int") + 1, F.lit(most))
    lettered = F.when(drawn.rlike("\\p{L}"), drawn).otherwise(F.substring(text, F.regexp_instr(text, F.lit("\\p{L}")), F.lit(most)))
    return F.when(F.length(text) <= most, text).otherwise(lettered)


def sample(docs: DataFrame, params: LanguageParams = LanguageParams()) -> pa.Table:
    """About ``per_language`` learned-from texts of each language, chosen by a hash of the id.

    Rates are taken over the distinct ids that can be drawn. Of a longer text a piece
    of ``max_chars`` characters is learned from; of repeated ids the smallest piece.
    """
    usable = docs.where(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike("\\p{L}")
    ).select("doc_id", "lang", "text")
    counts = {
        r["lang"]: r["n"]
        for r in usable.groupBy("lang").agg(F.countDistinct("doc_id").alias("n"))
        .orderBy(F.desc("n"), "lang").limit(params.languages).collect()
    }
    if not counts:
        return usable.limit(0).toArrow()
    share = F.element_at(
        F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, params.per_language / n))]),
        F.col("lang"),
    )
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_000)) / 1e9
    known = usable.where(F.col("lang").isin(list(counts)))
    found = (
        known.where(draw < share)
        .groupBy("doc_id", "lang")
        .agg(F.min(_piece(F.col("doc_id"), F.col("text"), params.max_chars)).alias("text"))
        .toArrow()
    )
    keys = mix(found.column("doc_id").to_numpy().astype(np.uint64))
    return found.take(pa.array(np.lexsort((found.column("lang").to_numpy(zero_copy_only=False), keys))))


def fit(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel:
    return train(sample(docs, params), params)


def identify(docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """Append lang_pred and score to every document; columns of these names are replaced."""
    model = fit(docs, params)
    return (
        docs.withColumn("_found", predict(model, F.col("text")))
        .withColumns({"lang_pred": F.col("_found.lang_pred"), "score": F.col("_found.score")})
        .drop("_found")
    )
