"""SimHash near-duplicates: vantage-point trees over fingerprints in Hamming space.

Two fingerprints within three bits agree to within one bit on their upper or on
their lower half. Each half therefore has a vantage-point tree of radius one: a
node splits fingerprints by their distance to its vantage point, a fingerprint has
one home leaf and is also sent to every leaf that the triangle bound cannot
exclude. Leaves are shards; within a shard the tree goes on in memory, and what is
left is compared exactly on all 64 bits. Only distinct fingerprints take part, and
a shard returns a spanning star of each linked group, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from xxhash import xxh64_intdigest

from kpiloom.llm.common import text_parts, unused
from kpiloom.llm.components import components
from kpiloom.session import ship_package
from kpiloom.sources.extracts import written

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class SimHashParams:
    """``leaf`` is the wanted size of a shard, ``sample`` the fingerprints that shape it.

    Trees grow with the data up to ``leaves`` leaves, which bounds what the driver holds and
    sends (a million sampled fingerprints). ``block`` bounds the rows of one side in a task:
    larger shards become a grid of blocks.
    """

    words: int = 3
    bits: int = 3
    seed: int = 42
    sample: int = 16
    leaf: int = 2_048
    leaves: int = 65_536
    block: int = 20_000


def fingerprint_of(text: bytes, words: int = 3, seed: int = 42, step: int = 1 << 15) -> int:
    """Signed 64-bit fingerprint of one UTF-8 text; the shingles are hashed in runs of ``step``."""
    joined = b" ".join(text.translate(_LOWER).split())
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], spaces + 1])
    ends = np.concatenate([spaces, [len(joined)]])
    count = max(len(starts) - words + 1, 1)
    starts, ends = starts[:count], ends[-count:]
    ones = np.zeros(64, np.int64)
    for at in range(0, count, step):
        digests = np.fromiter(
            (xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + step].tolist(), ends[at : at + step].tolist())),
            np.uint64,
        )
        ones += np.unpackbits(digests.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count).view(np.int64)[0])


def fingerprint(text: Column, words: int = 3, seed: int = 42) -> Column:
    """64-bit SimHash (as a signed long) of whole texts; a null text has no words and gives zero."""

    @arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        out = np.empty(len(column), np.int64)
        for row, data, offsets in text_parts(column):
            body = data.tobytes()
            for k in range(len(offsets) - 1):
                out[row + k] = fingerprint_of(body[offsets[k] : offsets[k + 1]], words, seed)
        return pa.array(out)

    return run(text)


def as_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


# ----------------------------------------------------------------- the trees

@dataclass(frozen=True)
class Tree:
    """Nodes as arrays: vantage point, median distance, children; a leaf has child -1 and a number."""

    vantage: np.ndarray
    median: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray


def distance(values: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(values ^ point)


def grow(values: np.ndarray, leaves: int, seed: int = 1) -> Tree:
    """A tree of about ``leaves`` leaves over sampled values; nodes of fewer than 16 are not split."""
    rng = np.random.default_rng(seed)
    nodes: list[list[int]] = []

    def add(part: np.ndarray, wanted: int) -> int:
        me = len(nodes)
        nodes.append([0, 0, -1, -1])
        if wanted > 1 and len(part) >= 16:
            point = part[rng.integers(len(part))]
            far = distance(part, point)
            # the vantage point is the farthest of a few: distances to it spread most
            tried = part[rng.integers(len(part), size=8)]
            point = max(tried, key=lambda p: (int(np.var(distance(part, p)) * 1000), int(p)))
            far = distance(part, point)
            cut = int(np.median(far))
            inside = far <= cut
            if inside.all():
                cut -= 1
                inside = far <= cut
            if inside.any():
                nodes[me][:2] = [int(point), cut]
                share = int(round(wanted * inside.mean()))
                share = min(max(share, 1), wanted - 1)
                nodes[me][2] = add(part[inside], share)
                nodes[me][3] = add(part[~inside], wanted - share)
        return me

    add(values, leaves)
    table = np.array(nodes, dtype=np.int64)
    leaf = np.where(table[:, 2] < 0, np.cumsum(table[:, 2] < 0) - 1, -1)
    return Tree(table[:, 0].astype(values.dtype), table[:, 1], table[:, 2], table[:, 3], leaf)


def route(tree: Tree, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the value, leaf, is home) for every leaf a ball of ``radius`` can reach.

    All values go down the tree together, one level at a time.
    """
    rows, node, home = np.arange(len(values)), np.zeros(len(values), np.int64), np.ones(len(values), bool)
    found = []
    while len(rows):
        ended = tree.left[node] < 0
        found.append((rows[ended], tree.leaf[node[ended]], home[ended]))
        rows, node, home = rows[~ended], node[~ended], home[~ended]
        far, cut = distance(values[rows], tree.vantage[node]).astype(np.int64), tree.median[node]
        near, away, inside = far <= cut + radius, far > cut - radius, far <= cut
        rows, home, node = (
            np.concatenate([rows[near], rows[away]]),
            np.concatenate([(home & inside)[near], (home & ~inside)[away]]),
            np.concatenate([tree.left[node[near]], tree.right[node[away]]]),
        )
    if not found:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, bool)
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def shape(count: int, params: SimHashParams) -> tuple[int, int]:
    """Leaves of a tree for ``count`` distinct fingerprints, and how many of them to sample for it."""
    leaves = min(max(1, -(-count // params.leaf)), params.leaves)
    return leaves, params.sample * leaves


def half(values: np.ndarray, which: int) -> np.ndarray:
    return ((values >> np.uint64(32)) if which else (values & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links reduced to (node, smallest node reachable through them), node and label differing."""
    nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ids[: len(a)], ids[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def near_links(homes: np.ndarray, others: np.ndarray, which: int, bits: int, small: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Stars that join every home with every other fingerprint within ``bits`` whose chosen
    halves are within bits // 2. The tree goes on here: nodes split by half distance, then by
    whole distance, until a part is small or no longer shrinks."""
    radius = bits // 2
    out_a, out_b = [], []
    rng = np.random.default_rng(len(homes))
    todo = [(homes, others)]
    while todo:
        h, o = todo.pop()
        if not len(h) or not len(o):
            continue
        if len(h) * len(o) > small:
            parts = None
            point = h[rng.integers(len(h))]
            for view, r in ((lambda v: half(v, which), radius), (lambda v: v, bits)):
                at = view(np.array([point]))[0]
                fh, fo = distance(view(h), at).astype(np.int64), distance(view(o), at).astype(np.int64)
                cut = int(np.median(fh))
                if (fh <= cut).all():
                    cut -= 1
                split = [(h[fh <= cut], o[fo <= cut + r]), (h[fh > cut], o[fo > cut - r])]
                if sum(len(x) * len(y) for x, y in split) < 0.9 * len(h) * len(o):
                    parts = split
                    break
            if parts is not None:
                todo += parts
                continue
        step = max(1, small // len(o))
        for at in range(0, len(h), step):
            part = h[at : at + step]
            i, j = np.nonzero(np.bitwise_count(part[:, None] ^ o[None, :]) <= bits)
            a, b = part[i], o[j]
            differ = a != b
            if differ.any():
                a, b = _stars(a[differ], b[differ])
                out_a.append(a)
                out_b.append(b)
    if not out_a:
        none = np.empty(0, np.uint64)
        return none, none
    return _stars(np.concatenate(out_a), np.concatenate(out_b))


# ---------------------------------------------------------------- Spark jobs

def near_fingerprints(prints: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """Links (u, v) that connect exactly the fingerprints within ``bits`` of each other.

    ``prints`` has one row per distinct fingerprint in column ``fp``. The result
    is a sparse set of links with the same components as all such pairs.
    """
    spark = prints.sparkSession
    ship_package(spark)
    count = prints.count()
    leaves, wanted = shape(count, params)
    # a fixed pseudo-random choice: about ``wanted`` of the fingerprints, whatever their order
    share = -(-wanted * (1 << 32) // max(count, 1))
    rows = prints.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 32)) < share).select("fp").toArrow().column("fp")
    known = rows.to_numpy().astype(np.int64).view(np.uint64)
    trees = [grow(np.unique(half(known, w)), leaves, seed=w + 1) for w in (0, 1)]
    radius = params.bits // 2
    first = [0, int(trees[0].leaf.max()) + 1]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for w in (0, 1):
                row, leaf, home = route(trees[w], half(fp, w), radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((leaf + first[w]).astype(np.int32)), pa.array(fp[row].view(np.int64)), pa.array(home)],
                    ["leaf", "fp", "home"],
                )

    routed = prints.select("fp").mapInArrow(send, "leaf int, fp long, home boolean")
    if leaves > 1:
        routed = written(spark, "simhash-routed", routed)
    sizes = routed.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
    grid = sizes.select(
        "leaf",
        F.ceil(F.col("homes") / params.block).cast("int").alias("kh"),
        F.ceil(F.col("n") / params.block).cast("int").alias("ko"),
    )
    # a row for each leaf of two trees: bounded by a parameter
    placed = routed.join(F.broadcast(grid), "leaf")
    mine = lambda k: F.pmod(F.xxhash64("fp"), F.greatest(F.col(k), F.lit(1))).cast("int")
    all_of = lambda k: F.explode(F.sequence(F.lit(0), F.greatest(F.col(k), F.lit(1)) - 1))
    role_home = placed.where("home").select("leaf", mine("kh").alias("bh"), all_of("ko").alias("bo"), "fp", "home")
    role_other = placed.where("kh > 0").select(
        "leaf", all_of("kh").alias("bh"), mine("ko").alias("bo"), "fp", F.lit(False).alias("home")
    )
    split = first[1]

    def link(key: tuple, shard: pa.Table) -> pa.Table:
        fp = shard.column("fp").to_numpy().view(np.uint64)
        home = shard.column("home").to_numpy(zero_copy_only=False)
        which = int(key[0].as_py() >= split)
        a, b = near_links(fp[home], fp[~home], which, params.bits)
        return pa.table({"u": a.view(np.int64), "v": b.view(np.int64)})

    return (
        role_home.unionByName(role_other)
        .groupBy("leaf", "bh", "bo")
        .applyInArrow(link, "u long, v long")
    )


def near_duplicates(docs: DataFrame, text: str = "text", params: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, text_hash, fp, label, component_id) for every row of ``docs``.

    Rows link when their fingerprints differ in at most ``bits`` bits; equal texts,
    repeated rows and texts without words (fingerprint zero) are linked like any
    other. ``label`` is a fingerprint that names the component, component_id its
    smallest doc_id; a null doc_id takes part, and a component with only null ids
    has a null component_id. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    ship_package(spark)
    base = written(
        spark, "simhash-prints",
        docs.select(
            "doc_id",
            F.xxhash64(text).alias("text_hash"),
            fingerprint(F.col(text), params.words, params.seed).alias("fp"),
        ),
    )
    prints = written(spark, "simhash-distinct", base.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = written(spark, "simhash-links", near_fingerprints(prints, params))
    labels = components(spark, links, "simhash-stars")
    named = prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return base.join(named.join(smallest, "label").select("fp", "label", "component_id"), "fp")


def deduplicate(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """One document of each component, with the columns of ``docs``.

    The row with the component's smallest doc_id stays (a null id only where all
    are null); of several rows with that id, one with the smallest text hash.
    """
    found = near_duplicates(docs, params=params)
    own, best_id, best_hash = unused(docs.columns, "hash", "best_id", "best_hash")
    keep = found.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")
    ).select(F.col("best.doc_id").alias(best_id), F.col("best.text_hash").alias(best_hash))
    marked = docs.withColumn(own, F.xxhash64("text"))
    same = marked["doc_id"].eqNullSafe(F.col(best_id)) & (F.col(own) == F.col(best_hash))
    return marked.join(keep, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)
