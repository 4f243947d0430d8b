"""Benchmark decontamination: edit distance through random walks and bit-sampling LSH.

A window of as many words as a benchmark item is embedded by the CGK random walk:
the walk reads one word per step and moves on or stays by a random bit of (step,
word), so two windows at a small edit distance meet again after each edit and their
embeddings differ in few places. Buckets of a few sampled places, repeated over
several walks, bring close windows and items together; candidates are then checked
by their exact edit distance over words.

Only windows are embedded that can be close to an item at all: k edits leave at least
m - q + 1 - k q of an item's q-grams of words in place, on diagonals that spread over k
words at most, so a window with fewer shared q-grams there cannot pass the last check.
This drops no link.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from kpiloom.llm.common import hash_words, lowered, mix, ngrams, text_parts, tokens
from kpiloom.session import ship_package


@dataclass(frozen=True)
class DecontamParams:
    """A leak is a window within ``edits`` of an item's words (a fraction of its length).

    ``walks`` x ``rounds`` buckets of ``sampled`` places each; ``block`` items are
    held at a time, further ones need further passes over the documents.
    """

    edits: float = 0.2
    walks: int = 4
    rounds: int = 12
    sampled: int = 3
    block: int = 20_000
    seed: int = 5


class Items:
    """A block of benchmark items with their embeddings, bucketed; small enough to ship to tasks."""

    def __init__(self, ids: list[int], texts: list[str], params: DecontamParams):
        self.params = params
        words = [hash_words(t or "") for t in texts]
        kept = [k for k, w in enumerate(words) if len(w)]
        self.ids = np.array([ids[k] for k in kept], np.int64)
        self.words = [words[k] for k in kept]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.widest = int(self.sizes.max()) if len(self.sizes) else 0
        rng = np.random.default_rng(params.seed)
        self.keys = rng.integers(0, 1 << 63, (params.walks, 3 * self.widest + 1)).astype(np.uint64)
        self.places = rng.random((params.walks, params.rounds, params.sampled))
        edits = (params.edits * self.sizes).astype(np.int64)
        # three-word grams where enough of them must survive, else two, or the only word
        self.gram_size = np.where(self.sizes - 2 - 3 * edits >= 2, 3, np.minimum(self.sizes, 2))
        self.least = np.maximum(self.sizes - self.gram_size + 1 - self.gram_size * edits, 1)
        self.grams = {}
        for q in (1, 2, 3):
            own = np.flatnonzero(self.gram_size == q)
            found = [ngrams(self.words[k], np.array([0, self.sizes[k]]), q) for k in own]
            if not found:
                continue
            keys = np.concatenate([g for g, _ in found])
            order = np.argsort(keys, kind="stable")
            maybe = np.zeros(1 << 20, bool)
            maybe[(keys >> np.uint64(44)).astype(np.int64)] = True
            item = np.repeat(own, [len(g) for g, _ in found])
            self.grams[q] = (maybe, keys[order], item[order], np.concatenate([at for _, at in found])[order])
        if len(self.words):
            rows = np.zeros((len(self.words), self.widest), np.uint64)
            for k, w in enumerate(self.words):
                rows[k, : len(w)] = w
            keys = self.buckets(rows, self.sizes)
            flat = keys.reshape(-1)
            order = np.argsort(flat, kind="stable")
            self.bucket = flat[order]
            self.bucket_item = np.repeat(np.arange(len(self.words)), keys.shape[1])[order]

    def buckets(self, rows: np.ndarray, sizes: np.ndarray, step: int = 1 << 22) -> np.ndarray:
        """LSH keys (windows, walks x rounds) of padded windows of ``sizes`` words.

        About ``step`` places of embeddings are held at a time.
        """
        p = self.params
        n = len(rows)
        keys = np.empty((n, p.walks * p.rounds), np.uint64)
        lines = np.arange(n)
        longest = int(sizes.max())
        part = max(step // (3 * longest), 1)
        if n > part:
            for a in range(0, n, part):
                keys[a : a + part] = self.buckets(rows[a : a + part], sizes[a : a + part], step)
            return keys
        for walk in range(p.walks):
            # the sampled places of each window's embedding, which is three times its length
            places = (self.places[walk].reshape(-1)[None, :] * (3 * sizes)[:, None]).astype(np.int64)
            embedded = np.empty((3 * longest, n), np.uint64)
            here = np.zeros(n, np.int64)
            for step in range(3 * longest):
                word = np.where(here < sizes, rows[lines, np.minimum(here, longest - 1)], np.uint64(0))
                embedded[step] = word
                here += (mix(word ^ self.keys[walk, step]) >> np.uint64(63)).astype(np.int64)
            taken = embedded[places.T, lines[None, :]].T.reshape(n, p.rounds, p.sampled)
            key = np.zeros((n, p.rounds), np.uint64)
            for k in range(p.sampled):
                key = mix(key * np.uint64(31) + taken[:, :, k])
            base = np.uint64(walk * p.rounds) + np.arange(p.rounds, dtype=np.uint64)
            keys[:, walk * p.rounds : (walk + 1) * p.rounds] = mix(key + (sizes[:, None].astype(np.uint64) << np.uint64(32)) + base[None, :])
        return keys


def edit_alignment(pattern: np.ndarray, size: np.ndarray, text: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least word edits from each pattern to any stretch of its text, and where that stretch ends.

    Rows are padded; ``size`` and ``width`` are their lengths. Ties end earliest.
    """
    n, columns = text.shape
    steps = np.arange(columns + 1)
    row = np.zeros((n, columns + 1), np.int64)
    final = row.copy()
    for i in range(pattern.shape[1]):
        differ = (text != pattern[:, i : i + 1]).astype(np.int64)
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + differ)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        done = size == i + 1
        final[done] = row[done]
    final[steps[None, :] > width[:, None]] = 1 << 40
    end = final.argmin(axis=1)
    return final[np.arange(n), end], end


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry) for every entry of each row's range low to high."""
    size = high - low
    row = np.repeat(np.arange(len(low)), size)
    return row, low[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)


def _windows(items: Items, words: np.ndarray, first: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Distinct (text, start, size) of windows that share enough q-grams with an item.

    A gram that many items share meets them all, so about ``step`` shared grams are
    held at a time. A run of them is followed by those that a window beginning in it
    can reach: every window is whole in the run that has its first gram.
    """
    out = []
    for q, (maybe, keys, item_of, at_of) in items.grams.items():
        grams, at = ngrams(words, first, q)
        hit = np.flatnonzero(maybe[(grams >> np.uint64(44)).astype(np.int64)])
        grams, at = grams[hit], at[hit]
        low, high = np.searchsorted(keys, grams, side="left"), np.searchsorted(keys, grams, side="right")
        some = np.flatnonzero(high > low)
        low, high, at = low[some], high[some], at[some]
        upto = np.concatenate([[0], np.cumsum(high - low)])
        begin = 0
        while begin < len(at):
            end = max(int(np.searchsorted(upto, upto[begin] + step, side="right")) - 1, begin + 1)
            reach = int(np.searchsorted(at, at[end - 1] + 2 * items.widest, side="right"))
            row, entry = _expand(low[begin:reach], high[begin:reach])
            out.append(_close(items, first, at[begin:reach][row], item_of[entry], at_of[entry]))
            begin = end
    return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 3), np.int64)


def _close(items: Items, first: np.ndarray, at: np.ndarray, item: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Distinct (text, start, size) from grams at word ``at`` that an item has at its word ``own``."""
    text = np.searchsorted(first, at, side="right") - 1
    edits = (items.params.edits * items.sizes[item]).astype(np.int64)
    start = at - own
    # grams of one link lie on k + 1 diagonals: in two neighbouring bands of that width
    band = (start - first[text] + items.widest) // (edits + 1)
    key = (text * len(items.ids) + item) * np.int64(1 << 26) + band
    bands, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    after = np.append(np.where(bands[1:] == bands[:-1] + 1, counts[1:], 0), 0)
    before = np.append(0, np.where(bands[1:] == bands[:-1] + 1, counts[:-1], 0))
    enough = (counts + np.maximum(before, after))[back] >= items.least[item]
    text, item, start = text[enough], item[enough], start[enough]
    size = items.sizes[item]
    # the window that puts the shared gram where the item has it, kept inside the text
    start = np.clip(start, first[text], np.maximum(first[text + 1] - size, first[text]))
    return np.unique(np.stack([text, start, size], axis=1), axis=0)


def _matches(items: Items, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, first word, end word, edits) of the best stretch of each text for each item it leaks."""
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    windows = _windows(items, words, first)
    for a in range(0, len(windows), 8192):
        text, start, size = windows[a : a + 8192].T
        span = np.minimum(size, first[text + 1] - start)
        longest = int(size.max())
        column = np.arange(longest)
        inside = column[None, :] < span[:, None]
        body = np.where(inside, words[np.minimum(start[:, None] + column, len(words) - 1)], np.uint64(0))
        keys = items.buckets(body, size)
        flat = keys.reshape(-1)
        slot, entry = _expand(np.searchsorted(items.bucket, flat, side="left"), np.searchsorted(items.bucket, flat, side="right"))
        if not len(slot):
            continue
        pairs = np.unique(np.stack([slot // keys.shape[1], items.bucket_item[entry]], axis=1), axis=0)
        for b in range(0, len(pairs), 4096):
            window, item = pairs[b : b + 4096].T
            _verify(items, words, first, text[window], start[window], item, found)
    return [(t, i, *v) for (t, i), v in sorted(found.items())]


def _verify(items, words, first, text, start, item, found) -> None:
    size = items.sizes[item]
    most = (items.params.edits * size).astype(np.int64)
    begin = np.maximum(start - most, first[text])
    width = np.minimum(start + size + most, first[text + 1]) - begin
    body = np.zeros((len(text), int(width.max())), np.uint64)
    column = np.arange(body.shape[1])
    inside = column[None, :] < width[:, None]
    body[inside] = words[np.minimum(begin[:, None] + column, len(words) - 1)][inside]
    pattern = np.zeros((len(text), int(size.max())), np.uint64)
    for k, i in enumerate(item):
        pattern[k, : size[k]] = items.words[i]
    edits, end = edit_alignment(pattern, size, body, width)
    for k in np.flatnonzero(edits <= most):
        key = (int(text[k]), int(items.ids[item[k]]))
        stop = int(begin[k] + end[k] - first[text[k]])
        value = (max(stop - int(size[k]), 0), stop, int(edits[k]))
        old = found.get(key)
        if old is None or (value[2], value[0]) < (old[2], old[0]):
            found[key] = value


def leaks(text: Column, items: Items) -> Column:
    """array<struct<item_id, first_word, end_word, edits>> of whole texts; empty for a null text."""

    @arrow_udf("array<struct<item_id:long,first_word:long,end_word:long,edits:long>>")
    def run(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "first_word", "end_word", "edits")]))
        out = [[] for _ in range(len(column))]
        parts, owners, base = [], [0], 0
        for _, data, offsets in text_parts(column):
            hashes, _, _, first = tokens(lowered(data), offsets, None)
            parts.append(hashes)
            owners.extend((base + first[1:]).tolist())
            base += len(hashes)
        if base and len(items.ids):
            for t, item, low, high, edits in _matches(items, np.concatenate(parts), np.array(owners)):
                out[t].append({"item_id": item, "first_word": low, "end_word": high, "edits": edits})
        return pa.array(out, kind)

    return run(text)


def _blocks(benchmark: DataFrame, params: DecontamParams):
    """The benchmark in blocks of bounded size, read one block at a time in order of id."""
    # repeated items count once; the query set is read in blocks of ``block`` rows
    ordered = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    last = None
    while True:
        some = ordered
        if last is not None:
            item, text = F.col("item_id"), F.col("text")
            some = ordered.where((item > last[0]) | ((item == last[0]) & (text > F.lit(last[1]))))
        rows = some.orderBy("item_id", "text").limit(params.block).collect()
        if rows or last is None:
            yield Items([r[0] for r in rows], [r[1] for r in rows], params)
        if len(rows) < params.block:
            return
        last = (rows[-1][0], rows[-1][1])


def contamination(docs: DataFrame, benchmark: DataFrame, params: DecontamParams = DecontamParams()) -> DataFrame:
    """One row per document and benchmark item it holds: doc_id, item_id, first_word, end_word, edits.

    Words are runs of alphanumeric characters, A-Z and Latin-1 capitals lowered; in
    scripts without spaces (Chinese, Japanese, Thai, ...) every character is a word,
    and Unicode punctuation, symbols and spaces separate as ASCII ones do. A document holds an item if some stretch of its words is within a fifth of the
    item's words (rounded down; under five words: equal). The stretch with the
    fewest edits is reported, the earliest of equals. Null texts and ids of items
    and items without words match nothing; repeated rows match alike.
    """
    ship_package(docs.sparkSession)
    out = None
    for items in _blocks(benchmark, params):
        part = docs.select("doc_id", F.inline(leaks(F.col("text"), items)))
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: DecontamParams = DecontamParams()) -> DataFrame:
    """The documents that hold no benchmark item, with their columns."""
    ship_package(docs.sparkSession)
    for items in _blocks(benchmark, params):
        docs = docs.where(F.size(leaks(F.col("text"), items)) == 0)
    return docs
