"""Ranked lexical search, term at a time with a limited number of accumulators.

The items of a block make a vocabulary. One pass over the documents writes an inverted
index of its terms in shards: one row for each run of texts, with the places of every
term sorted by document. Counts over all shards give the weights. In each shard the
terms of an item are then taken rarest first. Documents get accumulators as terms reach
them, until the bounds of the terms left cannot lift a new document to the k-th partial
score; from there on only the documents that have accumulators are added to, exactly.
A task carries each item's best documents from shard to shard, so later shards open
fewer accumulators.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.llm.common import ALNUM, distinct_runs, spans, text_parts
from kpiloom.session import ship_package
from kpiloom.sources.extracts import written

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHARD = (
    "ids array<long>, sizes array<long>, n_docs long, n_terms long, "
    "term array<int>, starts array<int>, doc array<int>, tf array<int>"
)


@dataclass(frozen=True)
class SearchParams:
    """The ``top`` best documents of each item.

    ``shard`` is the number of bytes of text in a row of the index (one longer text is a
    row of its own); ``block`` the number of distinct terms of the items searched
    together. No result depends on either.
    """

    top: int = 10
    shard: int = 1 << 22
    block: int = 200_000


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For the term runs of a column: first run of each text (n + 1 entries), index of each run, distinct terms."""
    first, parts = [np.zeros(1, np.int64)], []
    for _, data, offsets in text_parts(texts, 1 << 62):
        data = _LOWER[data]
        starts, ends, upto = spans(data, offsets, ALNUM)
        code, words = distinct_runs(data, starts, ends)
        first.append(upto[1:])
        parts.append((code, words))
    if not parts:
        return first[0], np.empty(0, np.int64), pa.array([], pa.large_binary())
    return np.concatenate(first), *parts[0]


def _index_rows(batches: Iterator[pa.RecordBatch], vocabulary: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
        *[(name, pa.list_(pa.int32())) for name in ("term", "starts", "doc", "tf")],
    ])
    for batch in batches:
        for row, _, offsets in text_parts(batch.column(1), most):
            count = len(offsets) - 1
            first, code, words = terms(batch.column(1).slice(row, count))
            sizes = np.diff(first)
            known = pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy()
            at = known[code] if len(code) else np.empty(0, np.int64)
            hit = np.flatnonzero(at >= 0)
            doc = np.repeat(np.arange(count), sizes)
            pair, tf = np.unique(at[hit].astype(np.int64) * count + doc[hit], return_counts=True)
            term, starts = np.unique(pair // count, return_index=True)
            lists = [term, np.append(starts, len(pair)), pair % count, tf]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column(0).slice(row, count).to_pylist()], schema.field(0).type),
                    pa.array([sizes], schema.field(1).type),
                    pa.array([int((sizes > 0).sum())], pa.int64()),
                    pa.array([int(sizes.sum())], pa.int64()),
                    *[pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in lists],
                ],
                schema=schema,
            )


def index(docs: DataFrame, vocabulary: list[bytes], params: SearchParams = SearchParams()) -> DataFrame:
    """Inverted index shards of the vocabulary's terms, written to the shared folder.

    A row has the ids and sizes (all terms, with repeats) of its documents, and the
    places of each term it holds: documents ``doc[starts[i]:starts[i + 1]]`` of the
    row hold ``term[i]`` ``tf`` times.
    """
    spark = docs.sparkSession
    ship_package(spark)
    values, most = pa.array(vocabulary, pa.large_binary()), params.shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _index_rows(batches, values, most)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SHARD)
    return written(spark, "search-index", rows)


def weights(shards: DataFrame, vocabulary: list[bytes]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and each term's weight.

    Exact counts over all shards; one number for each term of the block reaches the driver.
    """
    n, total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    sizes = F.transform("term", lambda t, i: F.struct(t.alias("term"), (F.col("starts")[i + 1] - F.col("starts")[i]).alias("df")))
    df = np.zeros(len(vocabulary), np.int64)
    for row in shards.select(F.inline(sizes)).groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[row["term"]] = row["df"]
    n, total = n or 0, total or 0
    return n, total, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


@dataclass
class Item:
    """An item's terms rarest first, and each term's weight times its repeats in the item."""

    number: int
    term: np.ndarray
    weight: np.ndarray


class Shard:
    """One row of the index with the impact of every place, as the ranking defines it."""

    def __init__(self, row: dict, n: int, total: int):
        self.ids = row["ids"]
        m = 25 + (75 * row["sizes"] * n) // max(total, 1)
        tf = row["tf"].astype(np.int64)
        self.doc = row["doc"]
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc])
        self.starts = row["starts"]
        self.place = {t: i for i, t in enumerate(row["term"].tolist())}
        self.most = np.maximum.reduceat(self.impact, self.starts[:-1]) if len(self.impact) else self.impact

    def best(self, item: Item, least: int, top: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents (by place in the shard) that may be among the ``top`` best, their scores, accumulators made.

        ``least`` is the score of the k-th best document known so far, 0 without.
        """
        here = [(self.place[t], w) for t, w in zip(item.term.tolist(), item.weight.tolist(), strict=True) if w and t in self.place]
        partial = np.zeros(len(self.ids), np.int64)
        # what the terms from each place on can add to a document at most
        left = np.cumsum([0, *(w * int(self.most[i]) for i, w in here[::-1])])[::-1]
        if left[0] < least:
            return np.empty(0, np.int64), partial[:0], 0
        alive = None
        for k, (i, w) in enumerate(here):
            span = slice(self.starts[i], self.starts[i + 1])
            doc, impact = self.doc[span], self.impact[span]
            if alive is None:
                reached = least
                if k and len(partial) >= top:
                    reached = max(least, int(np.partition(partial, -top)[-top]))
                # an equal score may still win by its id, so only a smaller bound stops new accumulators
                if left[k] < reached:
                    alive = partial > 0
            if alive is not None:
                among = alive[doc]
                doc, impact = doc[among], impact[among]
            partial[doc] += w * impact
        found = np.flatnonzero(partial)
        made = len(found)
        found = found[partial[found] >= least]
        if len(found) > top:
            found = found[partial[found] >= np.partition(partial[found], -top)[-top]]
        return found, partial[found], made


def _merge(known: list[tuple], ids: np.ndarray, found: np.ndarray, scores: np.ndarray, top: int) -> list[tuple]:
    fresh = [(-s, ids[k] is None, ids[k] or 0) for k, s in zip(found.tolist(), scores.tolist(), strict=True)]
    return sorted([*known, *fresh])[:top]


def _search_rows(batches: Iterator[pa.RecordBatch], items: list[Item], n: int, total: int, top: int) -> Iterator[pa.RecordBatch]:
    best: list[list[tuple]] = [[] for _ in items]
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].values.to_numpy(zero_copy_only=False) for name in ("sizes", "term", "starts", "doc", "tf")}
            shard = Shard(row | {"ids": batch.column("ids")[k].values.to_pylist()}, n, total)
            for at, item in enumerate(items):
                least = -best[at][-1][0] if len(best[at]) == top else 0
                found, scores, _ = shard.best(item, least, top)
                if len(found):
                    best[at] = _merge(best[at], shard.ids, found, scores, top)
    rows = [(item.number, None if null else i, -s) for item, kept in zip(items, best, strict=True) for s, null, i in kept]
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "doc_id", "score"])


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[object, Counter]]]:
    """The items that have terms, in blocks of ``most`` distinct terms (or one item with more)."""
    block: list[tuple[object, Counter]] = []
    seen: set[bytes] = set()
    for row in items.select("item_id", "text").toLocalIterator():
        _, code, words = terms(pa.array([row["text"]], pa.string()))
        if not len(code):
            continue
        counts = Counter(dict(zip(words.to_pylist(), np.bincount(code).tolist(), strict=True)))
        if block and len(seen | counts.keys()) > most:
            yield block
            block, seen = [], set()
        block.append((row["item_id"], counts))
        seen |= counts.keys()
    if block:
        yield block


def _search_block(docs: DataFrame, items_of: DataFrame, block: list[tuple[object, Counter]], params: SearchParams) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted(set().union(*(counts for _, counts in block)))
    number = {t: i for i, t in enumerate(vocabulary)}
    shards = index(docs, vocabulary, params)
    n, total, weight = weights(shards, vocabulary)
    items = []
    for k, (_, counts) in enumerate(block):
        at = np.array([number[t] for t in counts], np.int64)
        each = np.array(list(counts.values()), np.int64)
        order = np.lexsort((at, -weight[at]))
        items.append(Item(k, at[order], (weight[at] * each)[order]))
    top = params.top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _search_rows(batches, items, n, total, top)

    found = shards.mapInArrow(run, "item long, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    for keys in ([F.col("item"), part], [F.col("item")]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    schema = T.StructType([T.StructField("item", T.LongType()), items_of.schema["item_id"]])
    names = spark.createDataFrame([(k, item_id) for k, (item_id, _) in enumerate(block)], schema)
    return found.join(names, "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item with a score above 0.

    Equal scores rank by ascending doc_id, a null id last. Every row of ``docs`` is a
    document of its own and every row of ``items`` an item of its own, also with repeated
    ids (rows of one document may then share an id, items' ranks repeat). Null and empty
    texts hold no term: such items return no rows, such documents count nowhere. Items
    are read block by block; each block makes an index and one search of all documents,
    and what the driver holds is a block's vocabulary, not anything of the documents.
    A task holds one shard: the postings of ``shard`` bytes of text, or of one longer text.
    """
    blocks = [_search_block(docs, items, block, params) for block in _blocks(items, params.block)]
    if blocks:
        return reduce(DataFrame.unionByName, blocks)
    none = docs.sparkSession.createDataFrame([], T.StructType([items.schema["item_id"]]))
    return none.selectExpr("item_id", "0 AS rank", "0L AS doc_id", "0L AS score")
