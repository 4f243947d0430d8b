"""Helpers shared by the corpus operators: tables, Arrow text buffers, vectorised word hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.session import ship_package

FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for an operator's own columns: each with as many underscores before it as keep it apart."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """True for the fold no label is learned from; a null id is always held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], max_chars: int) -> pa.Table:
    """A bounded training sample of labelled documents: doc_id, text, lang (if there), label.

    At most ``per_class`` documents of class 0 and 1, those with the smallest hash of
    their id, from texts of 1 to ``max_chars`` characters outside the held-out fold.
    Null labels and ids are skipped; of repeated labels the largest counts, of
    repeated documents the smallest text. At most that many rows of ``max_chars``
    characters reach the driver.
    """
    wanted = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    size = F.length("text")
    known = docs.where(size.between(1, max_chars)).select("doc_id").distinct().join(wanted, "doc_id")
    order = F.xxhash64("doc_id")
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(order, "doc_id").limit(per_class[value])
        picked = part if picked is None else picked.unionByName(part)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = (
        docs.where(size.between(1, max_chars))
        .select("doc_id", "text", lang.alias("lang"))
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"), F.min("lang").alias("lang"))
    )
    found = rows.toArrow()
    keys = found.column("doc_id").cast(pa.int64()).to_numpy().astype(np.uint64)
    return found.take(pa.array(np.argsort(mix(keys), kind="stable")))


# ---------------------------------------------------------------- Arrow text

def text_parts(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive runs of rows as (first row, UTF-8 bytes, byte offsets from 0).

    A run has at most ``most`` bytes, or is one longer text. A null is empty.
    """
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32, column.offset + n + 1)[column.offset :].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, body[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


# ------------------------------------------------------------- word hashing

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; only tables of at most ``_PIECE`` entries or twice that are kept."""
    if len(_powers["up"]) >= n:
        return _powers["up"][:n], _powers["down"]
    size = 1 << int(n - 1).bit_length()
    found = {}
    for key, base in (("up", _BASE), ("down", _INVERSE)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        found[key] = np.multiply.accumulate(steps)
    if size <= 2 * _PIECE:
        _powers.update(found)
    return found["up"][:n], found["down"]


def classes(spaces: bytes = b" \t\n\x0b\x0c\r", symbols: str = "word") -> np.ndarray:
    """Class of each byte: 0 separates, 1 is in a word, 2 (``symbols="own"``) in a symbol run."""
    out = np.ones(256, np.uint8)
    if symbols == "word":
        out[list(spaces)] = 0
        return out
    for b in range(128):
        if not chr(b).isalnum():
            out[b] = 2 if symbols == "own" and b > 32 else 0
    return out


SPACED = classes()
ALNUM = classes(symbols="separate")
RUNS = classes(symbols="own")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the two-byte capitals of Latin-1 (C3 80 to C3 9E) in lower case."""
    out = _LOWER[data]
    if len(out) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    return out


# scripts written without spaces between words, by first and last code point
_UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x2E80, 0x2FDF),
    (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
    (0x4E00, 0xA4CF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x11700, 0x1174F),
    (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF),
)


@lru_cache(maxsize=1)
def _points() -> np.ndarray:
    """Class of each code point: 0 separates, 1 is in a word, 2 is a word of its own."""
    out = np.ones(0x110000, np.uint8)
    for low, high in _UNSPACED:
        out[low : high + 1] = 2
    for point in [*range(0x20000), *range(0xE0000, 0xE0200)]:
        # zero width spaces part words, joiners do not
        if unicodedata.category(chr(point))[0] in "PSZ" or 0x7F < point < 0xA0 or point in (0x200B, 0xFEFF):
            out[point] = 0
    out[:128] = ALNUM[:128]
    return out


def _wide(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of each byte by ``_points``, and where a character that is a word of its own begins."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(heads) or heads[0]:
        heads = np.append(0, heads)
    lead = data[heads].astype(np.int64)
    size = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    point = np.where(size == 1, lead, lead & (0xFF >> (size + 1)))
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        follow = data[np.minimum(heads[longer] + k, len(data) - 1)].astype(np.int64)
        point[longer] = point[longer] << 6 | follow & 0x3F
    kind = _points()[np.minimum(point, 0x10FFFF)]
    kind[(size == 1) & (lead >= 0x80)] = 1  # not UTF-8
    return np.repeat(kind, np.diff(np.append(heads, len(data)))), heads[kind == 2]


def tokens(
    data: np.ndarray, offsets: np.ndarray, kind: np.ndarray | None, prefixes: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, *tuple[np.ndarray, ...]]:
    """Runs of bytes of one class: hash, start, end, and per text the first run's index (n + 1 entries).

    A run never crosses the end of a text. Hashes of each run's first bytes follow
    for every length in ``prefixes``. Without ``kind`` the runs are alphanumeric in
    Unicode, and each character of a script without spaces is a run.
    """
    n = len(data)
    if not n:
        none = np.empty(0, np.uint64)
        return none, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64), *[none for _ in prefixes]
    if kind is not None:
        c, alone = kind[data], None
    elif data.max() < 0x80:
        c, alone = ALNUM[data], None
    else:
        c, alone = _wide(data)
    change = np.empty(n + 1, bool)
    change[0] = change[n] = True
    np.not_equal(c[1:], c[:-1], out=change[1:n])
    if alone is not None:
        change[alone] = True
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    keep = c[starts] != 0
    starts, ends = starts[keep], ends[keep]
    hashes, *heads = run_hashes(data, starts, [ends, *(np.minimum(starts + k, ends) for k in prefixes)])
    return hashes, starts, ends, np.searchsorted(starts, offsets), *heads


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: list[np.ndarray], piece: int = _PIECE) -> list[np.ndarray]:
    """64-bit hashes of the runs from ``starts`` to each of the arrays of ends. Different runs may share one.

    Runs are taken in pieces of about ``piece`` bytes, so a long text needs no more memory
    than its longest run; a hash does not depend on where its run lies.
    """
    out = [np.empty(len(starts), np.uint64) for _ in ends]
    bounds = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), piece)), len(starts))).tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        first, last = int(starts[a]), int(max(e[a:b].max() for e in ends))
        up, down = _powers_to(last - first)
        sums = np.empty(last - first + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        at = starts[a:b] - first
        for hashes, e in zip(out, ends, strict=True):
            hashes[a:b] = mix((sums[e[a:b] - first] - sums[at]) * down[at])
    return out


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive tokens within one text, and the index of each gram's first token."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = hashes[:count].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(_BASE) + hashes[k : k + count])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[:count] == text[n - 1 :])
    return out[at], at


def per_text(values: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` by text, where ``index`` holds the token each value belongs to."""
    bounds = np.searchsorted(index, first)
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def hash_words(text: str) -> np.ndarray:
    """Hashes of the lower-cased alphanumeric words of one text, by character in scripts without spaces."""
    data = lowered(np.frombuffer(text.encode(), np.uint8))
    return tokens(data, np.array([0, len(data)]), None)[0]


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes whose class is not 0: start, end, and per text the first run's index (n + 1 entries)."""
    inside = kind[data] != 0
    change = np.empty(len(data) + 1, bool)
    change[0], change[-1] = True, True
    np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    keep = inside[starts] if len(starts) else np.empty(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, offsets)


def distinct_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Index of each run of bytes among the distinct runs, and these; they are told apart by their bytes."""
    sizes = ends - starts
    upto = np.concatenate([[0], np.cumsum(sizes)])
    whole = len(starts) and upto[-1] == ends[-1] - starts[0]
    body = data[starts[0] : ends[-1]] if whole else data[ranges(starts, sizes)]
    buffers = [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))]
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


class Growing:
    """An array that is appended to."""

    def __init__(self, kind: type):
        self.data, self.size = np.empty(1 << 12, kind), 0

    def add(self, more: np.ndarray) -> None:
        while self.size + len(more) > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        self.data[self.size : self.size + len(more)] = more
        self.size += len(more)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each range in turn."""
    total = int(size.sum())
    shift = start - (np.cumsum(size) - size)
    return np.arange(total) + np.repeat(shift, size)
