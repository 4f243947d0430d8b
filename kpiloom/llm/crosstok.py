"""Alignment of the tokens of two vocabularies, and how often each pair of ids is linked.

Both tokenizers encode every text; byte offsets at which tokens of both end cut them
into groups, and tokens of a group are linked where their bytes overlap. An array made
once maps each id of A to the id of B with the same bytes. Links along it, which all
exact one-to-one groups are, are counted in vectors as long as the vocabulary, one for
each task. Only the other links become rows: a chunk of texts has each of its distinct
pairs once, with a count, and these are shuffled by pair, summed, and joined back.

Neither tokenizer joins characters across the end of a word before a blank or a line
break, so texts are cut there and distinct units are encoded once in a worker. Where
the vocabularies do not allow that, the texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.llm.common import Growing, distinct_runs, ranges, text_parts
from kpiloom.session import ship_package
from kpiloom.sources.extracts import written

_LISTS = {
    "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
    "digest": pa.string(), "n_units": pa.int64(), "pair_a": pa.int32(), "pair_b": pa.int32(), "pair_n": pa.int64(),
    "same_a": pa.int32(), "same_n": pa.int64(),
}
# long runs of small numbers: 32-bit, compressed, as they are written and shuffled
_RUNS = ("unit", "links_of", "link")
_NAMES = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
_CHUNKS = ", ".join(["chunk long", *(f"{k} array<{_NAMES[t]}>" for k, t in _LISTS.items()), *(f"{k} binary" for k in _RUNS)])
_BLANK_SIGN = "\u2581".encode()
_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@dataclass(frozen=True)
class AlignParams:
    """``a`` is a byte-level file of the tokenizers library, ``b`` a sentencepiece model with byte fallback.

    ``chunk`` is the bytes of text in one row of the written alignment (a longer text is
    a row of its own), ``cache`` the megabytes of aligned units a Python worker keeps.
    No result depends on either.
    """

    a: str | None = None
    b: str | None = None
    chunk: int = 1 << 22
    cache: int = 96

    def paths(self) -> tuple[str, str]:
        if self.a is not None and self.b is not None:
            return self.a, self.b
        import public_tokenizers

        return self.a or public_tokenizers.path("byte_bpe_50k.json"), self.b or public_tokenizers.path("piece_bpe_32k.model")


def _byte_of_letter() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones are themselves, others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where units begin: at each text, and at each blank or line break after a character that is neither
    white space nor ASCII control. No unit crosses a text; every text here has at least a byte."""
    at = np.flatnonzero((data == 0x20) | (data == 0x0A))
    at = at[at > 0]
    last = data[at - 1]
    solid = (last > 0x20) & (last < 0x7F)
    wide = np.flatnonzero(last >= 0x80)
    if len(wide):
        p = at[wide]
        one, two = data[np.maximum(p - 2, 0)], data[np.maximum(p - 3, 0)]
        # U+0085, U+00A0, U+1680, U+180E, U+2000 to U+207F and U+3000 hold all other white space
        blank = (one == 0xC2) & ((last[wide] == 0x85) | (last[wide] == 0xA0))
        blank |= (two == 0xE1) & ((one == 0x9A) | (one == 0xA0))
        blank |= (two == 0xE2) & ((one == 0x80) | (one == 0x81))
        blank |= (two == 0xE3) & (one == 0x80)
        solid[wide] = ~blank
    cut = np.zeros(len(data) + 1, bool)
    cut[at[solid]] = True
    cut[offsets[:-1]] = True
    return np.flatnonzero(cut[: len(data)])


class Aligner:
    """Both tokenizers, and what is known of units: token counts, groups as text, links."""

    def __init__(self, params: AlignParams):
        # tasks share an executor's cores already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        a, b = params.paths()
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letter = _byte_of_letter()
        vocabulary = self.a.get_vocab()
        a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            a_bytes[i] = bytes(letter[c] for c in piece) if all(c in letter for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        single = [self.b.is_byte(i) for i in range(len(pieces))]
        b_bytes = [
            bytes([int(p[3:5], 16)]) if s else p.replace("▁", " ").encode() for p, s in zip(pieces, single, strict=True)
        ]
        self.a_bytes, self.b_bytes = a_bytes, b_bytes
        # fallback bytes first, so that an ordinary piece takes precedence
        by_bytes = {x: i for i, x in sorted(enumerate(b_bytes), key=lambda p: not single[p[0]])}
        self.same = np.array([by_bytes.get(x, -1) if x else -1 for x in a_bytes], np.int64)
        self.a_size, self.b_size = (np.array([len(x) for x in all_bytes], np.int64) for all_bytes in (a_bytes, b_bytes))
        self.a_flat, self.b_flat = (np.frombuffer(b"".join(x), np.uint8) for x in (a_bytes, b_bytes))
        self.a_at, self.b_at = (np.cumsum(x) - x for x in (self.a_size, self.b_size))
        # every id in decimals with a byte after it for what separates it from the next
        names = [b"%d;" % i for i in range(max(len(a_bytes), len(b_bytes)))]
        self.name_size = np.array([len(x) for x in names], np.int64)
        self.name_at, self.name_flat = np.cumsum(self.name_size) - self.name_size, np.frombuffer(b"".join(names), np.uint8)
        self.blank = pieces.index("▁") if "▁" in pieces else -1
        self.cuts = self._may_cut(pieces)
        self.most = params.cache << 20
        self.clear()

    def _may_cut(self, pieces: list[str]) -> bool:
        """Whether both vocabularies never join characters across a unit's end."""
        inner = any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        plan = json.loads(self.a.to_str())
        split = plan["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        return bool(not inner and self.blank >= 0 and plain and plan["normalizer"] is None and self._prefixed())

    def _prefixed(self) -> bool:
        """Whether the model sets one blank before a text and changes no blanks itself."""
        probe = ["x", " x", "x  y ", "\nx"]
        return ["".join(self.b.id_to_piece(i) for i in self.b.encode(t)).replace("<0x0A>", "\n") for t in probe] == [
            "▁" + t.replace(" ", "▁") for t in probe
        ]

    def clear(self) -> None:
        self.row: dict[bytes, int] = {}
        self.text: list[bytes] = []
        self.held = 0
        self.n_a, self.n_b, self.n_groups, self.n_links, self.at = (Growing(np.int64) for _ in range(5))
        self.link_a, self.link_b = Growing(np.int32), Growing(np.int32)

    def _encode_b(self, units: list[str]) -> list[list[int]]:
        """Ids of units, which begin with a blank that the model adds itself, or with a line break."""
        found = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [
            ([self.blank] if len(u) == 1 else ids) if u[0] == " " else ids[1:] for u, ids in zip(units, found, strict=True)
        ]

    def _ids_alone(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids and counts by unit for A and B; a unit whose bytes either side does not give back has none."""
        texts = [u.decode() for u in units]
        found = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self._encode_b(texts)
        good = [
            b"".join([self.a_bytes[i] for i in x]) == u and b"".join([self.b_bytes[i] for i in y]) == u
            for u, x, y in zip(units, *found, strict=True)
        ]
        out = []
        for ids in found:
            ids = [x if ok else [] for x, ok in zip(ids, good, strict=True)]
            out += [np.array([i for x in ids for i in x], np.int64), np.array([len(x) for x in ids], np.int64)]
        return tuple(out)

    def _ids_joined(self, units: list[bytes], run: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """The same for units that may stand behind one another, encoded many at a time; None if bytes are not given back."""
        if not units:
            return (np.empty(0, np.int64),) * 4
        texts = [b"".join(units[k : k + run]).decode() for k in range(0, len(units), run)]
        data = np.frombuffer(b"".join(units), np.uint8)
        ends = np.cumsum([len(u) for u in units])
        out = []
        found = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self._encode_b(texts)
        sides = (self.a_flat, self.a_at, self.a_size), (self.b_flat, self.b_at, self.b_size)
        for ids, (flat, at, sizes) in zip(found, sides, strict=True):
            ids = np.array([i for x in ids for i in x], np.int64)
            size = sizes[ids]
            upto = np.cumsum(size)
            if upto[-1] != len(data) or not np.array_equal(flat[ranges(at[ids], size)], data):
                return None
            last = np.searchsorted(upto, ends)
            if not np.array_equal(upto[last], ends):
                return None
            out += [ids, np.diff(np.concatenate([[0], last + 1]))]
        return tuple(out)

    def _ids(self, units: list[bytes]) -> tuple[list[bytes], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The units in the order of their ids."""
        joined, alone = [], []
        for u in units:
            (joined if self.cuts and _ends_solid(u) else alone).append(u)
        found = self._ids_joined(joined)
        if found is None:
            joined, alone, found = [], units, self._ids_joined([])
        if alone:
            found = tuple(np.concatenate(x) for x in zip(found, self._ids_alone(alone), strict=True))
        return joined + alone, found

    def learn(self, units: list[bytes]) -> None:
        """Encode and align units that are not known."""
        first = len(self.text)
        units, (flat_a, n_a, flat_b, n_b) = self._ids(units)
        size_a, size_b = self.a_size[flat_a], self.b_size[flat_b]
        # all units in a row: the bytes agree, so ends of units are ends of both
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
        both = end_a[np.isin(end_a, end_b, assume_unique=True)]
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        low = np.searchsorted(end_b, end_a - size_a, side="right")
        high = np.searchsorted(end_b - size_b, end_a, side="left")
        links = high - low
        upto_a = np.concatenate([[0], np.cumsum(n_a)])
        linked = np.concatenate([[0], np.cumsum(links)])[upto_a]
        grouped = np.concatenate([[0], group_a + 1])[upto_a]
        self.at.add(linked[:-1] + self.link_a.size)
        self.link_a.add(np.repeat(flat_a, links))
        self.link_b.add(flat_b[ranges(low, links)])
        for held, values in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, np.diff(grouped)), (self.n_links, np.diff(linked))):
            held.add(values)
        text, upto = self._group_text(flat_a, group_a, flat_b, group_b)
        bounds = upto[upto_a + np.concatenate([[0], np.cumsum(n_b)])].tolist()
        self.text += [text[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        self.row.update(zip(units, range(first, first + len(units)), strict=True))
        self.held += sum(map(len, units)) + len(text) + 8 * int(links.sum()) + 200 * len(units)

    def _group_text(self, flat_a: np.ndarray, group_a: np.ndarray, flat_b: np.ndarray, group_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Groups as ``a1,a2|b1,b2;`` one after the other, and where each token's part begins."""
        side = np.concatenate([2 * group_a, 2 * group_b + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([flat_a, flat_b])[order]
        upto = np.concatenate([[0], np.cumsum(self.name_size[ids])])
        out = self.name_flat[ranges(self.name_at[ids], self.name_size[ids])]
        more = np.append(side[1:] == side[:-1], False)[: len(side)]
        out[upto[1:] - 1] = np.where(more, ord(","), np.where(side % 2 == 0, ord("|"), ord(";")))
        return out.tobytes(), upto

    def rows(self, units: list[bytes]) -> np.ndarray:
        """The row of each distinct unit; unknown ones are learned."""
        if self.held > self.most:
            self.clear()
        fresh = [u for u in units if u not in self.row]
        for k in range(0, len(fresh), 50_000):
            self.learn(fresh[k : k + 50_000])
        return np.array([self.row[u] for u in units], np.int64)


def _ends_solid(unit: bytes) -> bool:
    """Whether another unit may follow: the last character is no white space, and none stands for a blank."""
    if 0x20 < unit[-1] < 0x7F:
        return _BLANK_SIGN not in unit
    return unit[-1] >= 0x80 and not unit.decode()[-1].isspace() and unit.decode()[-1] != "\u180e" and _BLANK_SIGN not in unit


_aligners: dict[AlignParams, Aligner] = {}


def _aligner(params: AlignParams) -> Aligner:
    """One aligner for each worker process, whose tokenizers are kept between its tasks."""
    if params not in _aligners:
        _aligners[params] = Aligner(params)
    return _aligners[params]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive ends."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[ends])


def _chunk(aligner: Aligner, data: np.ndarray, offsets: np.ndarray, counted: np.ndarray) -> dict[str, object]:
    """One row of the alignment; its links along the identity map are added to ``counted``."""
    count = len(offsets) - 1
    full = np.flatnonzero(np.diff(offsets))
    # every text but empty ones with a blank before it
    data = np.insert(data, offsets[full], 0x20)
    bounds = np.append(offsets[full] + np.arange(len(full)), len(data))
    starts = unit_starts(data, bounds) if aligner.cuts else bounds[:-1]
    code, words = distinct_runs(data, starts, np.append(starts[1:], len(data)))
    row = aligner.rows(words.to_pylist()) if len(words) else np.empty(0, np.int64)
    first = np.searchsorted(starts, bounds)

    def known(held: Growing) -> np.ndarray:
        return held.data[: held.size][row]

    n_a, n_b, n_groups, n_links = (known(x) for x in (aligner.n_a, aligner.n_b, aligner.n_groups, aligner.n_links))
    good = _sums(n_a[code] == 0, first) == 0
    out = {k: np.zeros(count, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    for name, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links)):
        out[name][full[good]] = _sums(values[code], first)[good]
    digest = [""] * count
    for k in np.flatnonzero(good).tolist():
        state, stop = hashlib.sha256(), int(first[k + 1])
        for x in range(int(first[k]), stop, 1 << 16):
            part = b"".join([aligner.text[r] for r in row[code[x : min(x + (1 << 16), stop)]].tolist()])
            state.update(part if x + (1 << 16) < stop else part[:-1])
        digest[full[k]] = state.hexdigest()

    # each document's units, documents without tokens left out
    sizes = np.zeros(count, np.int64)
    sizes[full[good]] = np.diff(first)[good]
    unit = code[np.repeat(good, np.diff(first))]
    total = np.bincount(unit, minlength=len(words)).astype(np.int64)
    place = ranges(known(aligner.at), n_links)
    link_a, link_b = aligner.link_a.data[place].astype(np.int64), aligner.link_b.data[place].astype(np.int64)
    weight = np.repeat(total, n_links)
    same = aligner.same[link_a] == link_b
    np.add.at(counted, link_a[same], weight[same])
    pair, inverse = np.unique(link_a[~same] << 32 | link_b[~same], return_inverse=True)
    link = np.empty(len(link_a), np.int64)
    link[same] = -1 - link_a[same]
    link[~same] = inverse
    pair_n = np.zeros(len(pair), np.int64)
    np.add.at(pair_n, inverse, weight[~same])
    return out | {
        "digest": digest, "n_units": sizes, "unit": unit, "links_of": n_links, "link": link, "pair_a": pair >> 32, "pair_b": pair & 0xFFFFFFFF,
        "pair_n": pair_n, "same_a": None, "same_n": None,
    }


def _batch(chunk: int | None, row: dict[str, object]) -> pa.RecordBatch:
    def column(name: str, kind: pa.DataType) -> pa.Array:
        values = row[name]
        if values is None:
            return pa.array([None], pa.list_(kind))
        flat = values if isinstance(values, pa.Array) else pa.array(values, kind)
        return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(kind))

    runs = [pa.array([None if row[k] is None else _packed(row[k])], pa.binary()) for k in _RUNS]
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), *[column(k, t) for k, t in _LISTS.items()], *runs], ["chunk", *_LISTS, *_RUNS]
    )


def _packed(values: np.ndarray) -> bytes:
    """32-bit numbers, their count before them, compressed."""
    raw = values.astype("<i4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), "<i4") if size else np.empty(0, "<i4")


def align(docs: DataFrame, params: AlignParams = AlignParams()) -> DataFrame:
    """The alignment in chunks, written to the shared folder; input of ``pair_counts`` and ``per_document``.

    A row holds some documents: their counts and digests, their units one after the other,
    the links of each distinct unit (a place among the row's pairs, or -1 - id of A for a
    link along the identity map) and the distinct other pairs with their counts. One more
    row for each task, without a chunk, holds the task's counts along the identity map.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(params)
        counted = np.zeros(len(aligner.same), np.int64)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for row, data, offsets in text_parts(batch.column(1), params.chunk):
                found = _chunk(aligner, data, offsets, counted)
                yield _batch(chunk, found | {"doc_id": batch.column(0).slice(row, len(offsets) - 1)})
                chunk += 1
        aligner.clear()  # an idle worker holds the tokenizers only
        pa.default_memory_pool().release_unused()
        at = np.flatnonzero(counted)
        if len(at):
            yield _batch(None, dict.fromkeys([*_LISTS, *_RUNS]) | {"same_a": at, "same_n": counted[at]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _CHUNKS)
    return written(docs.sparkSession, "token-alignment", rows)


def _identity(aligned: DataFrame, aligner: Aligner) -> np.ndarray:
    """Links along the identity map by id of A, summed over the tasks' vectors; as long as the vocabulary."""
    counts = np.zeros(len(aligner.same), np.int64)
    cells = aligned.where("chunk IS NULL").select(F.inline(F.arrays_zip("same_a", "same_n")))
    for row in cells.groupBy("same_a").agg(F.sum("same_n").alias("n")).collect():
        counts[row["same_a"]] = row["n"]
    return counts


def _other_counts(aligned: DataFrame) -> DataFrame:
    pairs = aligned.where("chunk IS NOT NULL").select(F.inline(F.arrays_zip("pair_a", "pair_b", "pair_n")))
    return pairs.groupBy(F.col("pair_a").alias("a"), F.col("pair_b").alias("b")).agg(F.sum("pair_n").alias("n")).where("n > 0")


def pair_counts(aligned: DataFrame, params: AlignParams = AlignParams()) -> DataFrame:
    """(a, b, n): how many links of all documents hold each pair of ids."""
    aligner = _aligner(params)
    counts = _identity(aligned, aligner)
    rows = [(int(a), int(aligner.same[a]), int(counts[a])) for a in np.flatnonzero(counts)]
    return _other_counts(aligned).unionByName(aligned.sparkSession.createDataFrame(rows, "a int, b int, n long"))


def per_document(aligned: DataFrame, params: AlignParams = AlignParams()) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    What the driver and each task hold beside their rows are two vectors as long as the
    vocabularies: the counts along the identity map, and each B id's highest count.
    """
    spark = aligned.sparkSession
    aligner = _aligner(params)
    same = _identity(aligned, aligner)
    others = written(spark, "token-pairs", _other_counts(aligned))
    best = np.zeros(len(aligner.b_size), np.int64)
    mapped = aligner.same >= 0
    best[aligner.same[mapped]] = same[mapped]
    for row in others.groupBy("b").agg(F.max("n").alias("n")).collect():
        best[row["b"]] = max(best[row["b"]], row["n"])
    same_best = np.zeros(len(same), bool)
    same_best[mapped] = same[mapped] == best[aligner.same[mapped]]

    chunks = aligned.where("chunk IS NOT NULL")
    places = chunks.select("chunk", F.posexplode(F.arrays_zip("pair_a", "pair_b")).alias("place", "pair"))
    found = (
        places.select("chunk", "place", F.col("pair.pair_a").alias("a"), F.col("pair.pair_b").alias("b"))
        .join(others, ["a", "b"])
        .select(F.col("chunk").alias("of"), "place", "b", "n")
    )

    def finish(chunk: pa.Table, counts: pa.Table) -> pa.Table:
        def whole(name: str) -> pa.Array:
            return chunk.column(name).combine_chunks().flatten()

        def values(name: str) -> np.ndarray:
            return whole(name).to_numpy(zero_copy_only=False)

        place, n = counts.column("place").to_numpy(), counts.column("n").to_numpy()
        count, top = (np.zeros(len(values("pair_a")), k) for k in (np.int64, bool))
        count[place], top[place] = n, n == best[counts.column("b").to_numpy()]
        unit, links_of, link = (_unpacked(chunk.column(k)[0].as_py()) for k in _RUNS)
        along = link < 0
        at = np.where(along, -1 - link, link)
        each, high = np.empty(len(link), np.int64), np.empty(len(link), bool)
        each[along], high[along] = same[at[along]], same_best[at[along]]
        each[~along], high[~along] = count[at[~along]], top[at[~along]]
        ends, entries = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in (links_of, values("n_units")))
        columns = {k: whole(k) for k in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        columns["n_best"] = pa.array(_sums(_sums(high, ends)[unit], entries))
        columns["count_sum"] = pa.array(_sums(_sums(each, ends)[unit], entries))
        columns["groups_sha256"] = whole("digest")
        return pa.table(columns)

    kept = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "digest", "n_units", "pair_a", *_RUNS]
    return chunks.select(*kept).groupBy("chunk").cogroup(found.groupBy("of")).applyInArrow(finish, _RESULT)


def align_documents(docs: DataFrame, params: AlignParams = AlignParams()) -> DataFrame:
    """``per_document`` of all documents.

    Each row is a document of its own, also with a repeated or null doc_id; columns other
    than doc_id and text are not read. A null or empty text, or one whose tokens do not
    give back its bytes, has no tokens: zeros and an empty digest. A task holds ``chunk``
    bytes of text with some ten times as much in offsets and links, or one longer text; a
    text without blanks and line breaks is encoded in one piece.
    """
    return per_document(align(docs, params), params)
