"""Sequence packing by shortest-pack-first over the histogram of piece lengths.

Documents are tokenised and cut into pieces of at most one sequence. The plan is
made from the histogram alone: lengths are placed longest first, always into the
pattern with the most room left, by updating counts of packing patterns. Pieces of
one length are then numbered across the cluster and each finds its place in the
plan by that rank.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.common import SPACED, Growing, distinct_runs, ranges, run_hashes, spans, text_parts, unused
from kpiloom.session import ship_package
from kpiloom.sources.extracts import written


# letters that are their own normal form, then signs; the vocabulary splits between the two
_PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,;:!?|*$%&#]*)\Z")
# The normal form and split for which words of that shape have two parts at most.
_NORMAL_FORM = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
    ],
}
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


@dataclass(frozen=True)
class PackingParams:
    """``tokenizer`` is a file of the tokenizers library; the default is a public vocabulary.

    ``bucket`` is the number of rows numbered by one task; it decides which of the equal
    places a piece gets, not how many sequences there are. ``cache`` bounds the words whose
    ids a Python worker remembers.
    """

    length: int = 4096
    end: int = 2
    tokenizer: str | None = None
    bucket: int = 200_000
    cache: int = 600_000

    def path(self) -> str:
        if self.tokenizer is not None:
            return self.tokenizer
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of whole texts, with the ids of words kept between texts.

    The tokenizer never joins characters across ASCII white space, so a text's ids
    are those of its words in turn. A word is known by its bytes. Unknown words are
    encoded together, with a word of its own between them. Texts that hold ``<|``, with
    which this vocabulary's special tokens begin, are encoded whole.
    """

    def __init__(self, path: str, cache: int):
        # tasks share an executor's cores already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = "\x02"
        (self.mark_id,) = self.encode([self.mark])[0]
        # the same vocabulary and merges for words whose normal form and split are known
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        shape = json.loads(self.tokenizer.to_str())
        self.known_split = (shape["normalizer"], shape["pre_tokenizer"]) == (_NORMAL_FORM, _SPLIT)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.most = cache
        self.clear()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        """Forget all words; each is kept as its hash, its bytes and its ids."""
        self.count = 0
        self.keys = np.empty(self.most, np.uint64)
        self.word_at, self.word_size = np.empty(self.most, np.int64), np.empty(self.most, np.int32)
        self.at, self.sizes = np.empty(self.most, np.int64), np.empty(self.most, np.int32)
        self.bytes, self.ids = Growing(np.uint8), Growing(np.int32)
        # open addressing at a load of a half at most: 1 + the word's row, or 0
        self.slots = np.zeros(1 << (2 * self.most - 1).bit_length(), np.int32)

    def _slot(self, hashes: np.ndarray, probe: int) -> np.ndarray:
        return ((hashes + np.uint64(probe * (2 * probe + 1))) & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Row of each distinct word, -1 if it isn't known: of equal hashes the one with equal bytes."""
        row = np.full(len(hashes), -1, np.int64)
        todo, probe = np.arange(len(hashes)), 0
        while len(todo):
            seen = self.slots[self._slot(hashes[todo], probe)]
            used = seen > 0
            todo, seen = todo[used], seen[used].astype(np.int64) - 1
            hit = (self.keys[seen] == hashes[todo]) & (self.word_size[seen] == sizes[todo])
            at, known, size = np.flatnonzero(hit), seen[hit], sizes[todo[hit]]
            if len(at):
                differ = data[ranges(starts[todo[at]], size)] != self.bytes.data[ranges(self.word_at[known], size)]
                hit[at] = np.add.reduceat(differ, np.cumsum(size) - size) == 0
            row[todo[hit]] = seen[hit]
            todo, probe = todo[~hit], probe + 1
        return row

    def learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Add distinct unknown words; there must be room for them."""
        texts = [w.decode() for w in words]
        at, sizes = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        split = [_PLAIN.match(t) if self.known_split else None for t in texts]
        easy = [k for k, m in enumerate(split) if m]
        flat = self._easy([split[k] for k in easy], easy, at, sizes)
        rest = [k for k, m in enumerate(split) if not m]
        flat = self._others([texts[k] for k in rest], rest, flat, at, sizes)
        rows = slice(self.count, self.count + len(words))
        lengths = np.array([len(w) for w in words], np.int64)
        self.keys[rows], self.word_size[rows] = hashes, lengths
        self.word_at[rows] = self.bytes.size + np.cumsum(lengths) - lengths
        self.at[rows], self.sizes[rows] = at + self.ids.size, sizes
        self.bytes.add(np.frombuffer(b"".join(words), np.uint8))
        self.ids.add(flat)
        todo, probe = np.arange(self.count, self.count + len(words)), 0
        while len(todo):
            slot = self._slot(self.keys[todo], probe)
            free = self.slots[slot] == 0
            self.slots[slot[free]] = todo[free] + 1
            todo, probe = todo[self.slots[slot] != todo + 1], probe + 1
        self.count += len(words)

    def _easy(self, matches: list, rows: list[int], at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Small letters and a run of signs after them: two parts, each ending with a last token."""
        parts = np.array([2 if m[2] else 1 for m in matches], np.int64)
        pieces = [f"{m[1]} {m[2]}" for m in matches]
        lines = [" ".join(pieces[a : a + 256]) for a in range(0, len(pieces), 256)]
        found = [e.ids for e in self.plain.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.array([i for x in found for i in x], np.int32)
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != parts.sum():
            raise ValueError("this vocabulary does not mark the ends of words")
        upto = ends[np.cumsum(parts) - 1] if len(parts) else ends
        at[rows] = np.concatenate([[0], upto[:-1]]) if len(parts) else upto
        sizes[rows] = upto - at[rows]
        return flat

    def _others(self, texts: list[str], rows: list[int], flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Any words, through the whole tokenizer, told apart by the mark between them."""
        out, base = [flat], len(flat)
        lines = [[k for k in range(a, min(a + 256, len(texts))) if self.mark not in texts[k]] for a in range(0, len(texts), 256)]
        found = self.encode([f" {self.mark} ".join([*(texts[k] for k in line), ""]) for line in lines])
        for line, ids in zip(lines, found, strict=True):
            ids = np.array(ids, np.int32)
            ends = np.flatnonzero(ids == self.mark_id)
            if len(ends) != len(line):
                raise ValueError("the separating word is not a token of its own in this vocabulary")
            starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
            for k, a, b in zip(line, starts, ends, strict=True):
                at[rows[k]], sizes[rows[k]] = base + a, b - a
            out.append(ids)
            base += len(ids)
        for k, text in enumerate(texts):
            if self.mark in text:
                ids = np.array(self.encode([text])[0], np.int32)
                at[rows[k]], sizes[rows[k]] = base, len(ids)
                out.append(ids)
                base += len(ids)
        return np.concatenate(out)

    def rows(self, words: pa.Array) -> np.ndarray:
        """The row of each distinct word; unknown ones are learned. At most ``cache`` words at a time."""
        offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1)
        data = np.frombuffer(words.buffers()[2], np.uint8)
        starts, sizes = offsets[:-1], np.diff(offsets)
        (hashes,) = run_hashes(data[: offsets[-1]], starts, [offsets[1:]])
        row = self.find(hashes, data, starts, sizes)
        if self.count + (row < 0).sum() > self.most:
            self.clear()
            row[:] = -1
        fresh = np.flatnonzero(row < 0)
        if len(fresh):
            row[fresh] = np.arange(self.count, self.count + len(fresh))
            self.learn(words.take(pa.array(fresh)).to_pylist(), hashes[fresh])
        return row

    def _ids_of(self, code: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in turn, and how many each has."""
        if not len(code):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        if len(words) > self.most:  # only a long text of unlike words
            halves = []
            for part in (code[: len(code) // 2], code[len(code) // 2 :]):
                used, own = np.unique(part, return_inverse=True)
                halves.append(self._ids_of(own, pa.array(words.take(pa.array(used)).to_pylist(), pa.large_binary())))
            return tuple(np.concatenate(x) for x in zip(*halves, strict=True))
        row = self.rows(words)
        sizes = self.sizes[row][code].astype(np.int64)
        return self.ids.data[ranges(self.at[row][code], sizes)], sizes

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text of an Arrow column, in order."""
        for _, data, offsets in text_parts(column, 1 << 20):
            lower = data.copy()
            capital = (lower >= 65) & (lower <= 90)
            lower[capital] += 32
            starts, ends, first = spans(lower, offsets, SPACED)
            code, words = distinct_runs(lower, starts, ends)
            ids, sizes = self._ids_of(code, words)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            special = np.zeros(len(offsets) - 1, bool)
            raw = data.tobytes()
            if b"<|" in raw:
                special = np.array([b"<|" in raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            for k in range(len(offsets) - 1):
                if special[k]:
                    yield np.array(self.encode([raw[offsets[k] : offsets[k + 1]].decode()])[0], np.int32)
                else:
                    yield ids[upto[first[k]] : upto[first[k + 1]]]


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(path: str, cache: int) -> WordTokenizer:
    """One tokenizer for each worker process, kept between its tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path, cache)
    return _tokenizers[path]


def cut(docs: DataFrame, params: PackingParams = PackingParams(), keep_ids: bool = True) -> DataFrame:
    """Pieces of at most ``length`` tokens: doc_id, start, length, ids_crc32, doc_tokens and, on demand, ids.

    A document's ids end with ``end``; a null text is empty and gives that id alone.
    Every row is a document of its own, also with a repeated or null doc_id.
    """
    ship_package(docs.sparkSession)
    path = params.path()
    size, end, cache = params.length, params.end, params.cache

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, cache)
        for batch in batches:
            rows, start, length, crc, whole, kept = [], [], [], [], [], []
            for k, ids in enumerate(tokenizer.texts(batch.column(1))):
                ids = np.append(ids, end).astype("<u4")
                for a in range(0, len(ids), size):
                    piece = ids[a : a + size]
                    rows.append(k)
                    start.append(a)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    whole.append(len(ids))
                    if keep_ids:
                        kept.append(piece.astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, whole)]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                flat = np.concatenate(kept) if kept else np.empty(0, np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        pa.default_memory_pool().release_unused()  # an idle worker holds the tokenizer and its words only

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Plan:
    """Where the pieces of one length go, as ranges of their rank.

    Range k holds ranks from ``low[k]`` of length ``size[k]``: rank low + c belongs to
    sequence ``first[k]`` + c // ``times[k]``, at offset ``offset[k]`` + (c mod times) x size.
    """

    size: np.ndarray
    low: np.ndarray
    first: np.ndarray
    times: np.ndarray
    offset: np.ndarray
    sequences: int


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[int, dict[int, int]]]:
    """Packing patterns as (how many packs, {piece length: how many}), made from counts alone.

    Lengths are placed longest first. All packs with the most room left take as many
    pieces of the length as there are; a pattern that only some of its packs are
    needed for is split in two.
    """
    room: dict[int, list[tuple[int, dict[int, int]]]] = {}
    heap: list[int] = []

    def put(free: int, packs: int, pattern: dict[int, int]) -> None:
        if not room.get(free):
            room[free] = []
            heapq.heappush(heap, -free)
        room[free].append((packs, pattern))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            while heap and not room[-heap[0]]:
                heapq.heappop(heap)
            if not heap or -heap[0] < size:
                # equal packs of as many pieces as fit, one by one as the rule has it: one each first
                put(length - size, left, {size: 1})
                break
            free = -heap[0]
            packs, pattern = room[free].pop()
            used = min(packs, left)
            if packs > used:
                room[free].append((packs - used, pattern))
            put(free - size, used, {**pattern, size: pattern.get(size, 0) + 1})
            left -= used
    return [x for free in sorted(room) for x in room[free]]


def plan(histogram: dict[int, int], length: int) -> Plan:
    rows, taken, first = [], dict.fromkeys(histogram, 0), 0
    for packs, pattern in shortest_pack_first(histogram, length):
        offset = 0
        for size, times in sorted(pattern.items(), reverse=True):
            rows.append((size, taken[size], first, times, offset))
            taken[size] += packs * times
            offset += size * times
        first += packs
    assert taken == histogram
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return Plan(*table.T, sequences=first)


def pack(pieces: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """Append sequence_id and offset to pieces (columns doc_id, start, length, ids_crc32 at least).

    Pieces of one length are interchangeable, so any numbering of them is right; it
    is made by (length, hash bucket): a length that a third of all pieces share is
    numbered by many tasks. Pieces should come from a written table, as they are
    read twice. Other columns of ``pieces`` are kept, but for sequence_id and offset.
    """
    spark = pieces.sparkSession
    ship_package(spark)
    by_size = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    layout = plan(by_size, params.length)
    buckets = max(1, -(-sum(by_size.values()) // params.bucket))
    key = F.xxhash64("doc_id", "start", "ids_crc32")
    part, nth, start, at = unused(pieces.columns, "bucket", "nth", "before", "at")
    placed = pieces.withColumn(part, F.pmod(key, F.lit(buckets)))
    order = Window.partitionBy("length", part).orderBy("doc_id", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("length", part).agg(F.count("*").alias("n")).select(
        "length", part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start)
    )
    ranked = placed.withColumn(nth, F.row_number().over(order) - 1).join(offsets, ["length", part])
    span = np.int64(max([1, *by_size.values()]) + 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(layout.size * span + layout.low, size.to_numpy() * span + rank.to_numpy(), side="right") - 1
        nth = rank.to_numpy() - layout.low[k]
        return pd.DataFrame({
            "sequence_id": layout.first[k] + nth // layout.times[k],
            "offset": layout.offset[k] + nth % layout.times[k] * size.to_numpy(),
        })

    return (
        ranked.withColumn(at, place("length", F.col(nth) + F.col(start)))
        .withColumns({"sequence_id": F.col(f"{at}.sequence_id"), "offset": F.col(f"{at}.offset")})
        .drop(at, nth, start, part)
    )


def pack_documents(docs: DataFrame, params: PackingParams = PackingParams(), keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; the pieces are written once to the shared folder."""
    pieces = written(docs.sparkSession, "packing-pieces", cut(docs, params, keep_ids))
    return pack(pieces, params)


def sequences(packed: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """Training rows: sequence_id, ids (at most ``length``), used, padded_length.

    A sequence is padded to ``length`` unless it fills a power of two.
    """
    used = F.col("used")
    whole = F.size(F.filter(F.array(*[F.lit(1 << k) for k in range(params.length.bit_length())]), lambda p: p == used)) > 0
    return (
        packed.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("used"))
        .select(
            "sequence_id",
            F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"),
            "used",
            F.when(whole, used).otherwise(params.length).alias("padded_length"),
        )
    )


