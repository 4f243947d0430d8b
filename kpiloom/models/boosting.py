"""Second-order boosted trees for a 0/1 target, grown from histograms, several models in one pass.

Rows are cut into bins once and held in blocks with each model's margins. A level of a
tree is one job: every task sums gradients and hessians by node, feature and bin, for all
models together, a shuffle merges a feature's sums and finds its best splits, and the driver
picks among the features. The sums are whole numbers, so they and the trees are the same
however the rows are dealt out. Leaf weights are Newton steps; a split sends
missing values to the side that gains more. Models share trees' columns and row draws and
differ in the rows they learn from, as the folds of a cross-validation do.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.session import shared_dir, ship_package
from kpiloom.sources.extracts import written

MISSING_BIN = 255
# how many joint bins several columns may have that are summed together
_BUNDLE = 2048
# gradients and hessians are counted in units of 2^-20
_UNIT = float(1 << 20)
_BLOCKS = "rows int, bins binary, target binary, members binary, draw binary, margin binary"
_NODES = (
    "model INT, tree INT, node INT, feature INT, cut DOUBLE, missing_left BOOLEAN, value DOUBLE, gain DOUBLE, cover DOUBLE"
)


@dataclass(frozen=True)
class BoostingParams:
    """``rows`` and ``columns`` are the shares drawn for each tree; ``ridge`` and ``least`` the
    penalty on leaf weights and the least hessian of a leaf. ``restart`` trees are grown
    between two written states. The driver merges nothing itself: ``parts`` is kept for callers
    that still name it."""

    trees: int = 300
    depth: int = 4
    step: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    seed: int = 42
    ridge: float = 1.0
    least: float = 1.0
    bins: int = 64
    block: int = 65_536
    restart: int = 20
    parts: int = 64


@dataclass
class Trees:
    """One tree a model as arrays (model, node); children of node i are 2i + 1 and 2i + 2, a leaf has feature -1."""

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @staticmethod
    def empty(models: int, depth: int) -> Trees:
        shape = (models, (2 << depth) - 1)
        return Trees(
            np.full(shape, -1, np.int64), np.zeros(shape, np.int64), np.zeros(shape, bool),
            *(np.zeros(shape) for _ in range(3)),
        )

    def walk(self, model: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node each row of bins has reached after at most ``levels`` steps; fastest if a column's bins lie together."""
        node = np.zeros(len(bins), np.uint8 if levels < 8 else np.int64)
        for i in range((1 << levels) - 1):
            feature = self.feature[model, i]
            # a leaf's rows stay where they are
            if feature < 0:
                continue
            own = bins[:, feature]
            right = own > int(self.bin[model, i])
            if self.missing_left[model, i]:
                right &= own != MISSING_BIN
            step = right.astype(node.dtype)
            step += i + 1
            step *= node == i
            node += step
        return node


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(draw: np.ndarray, tree: int, params: BoostingParams) -> np.ndarray:
    """Which rows a tree learns from: a fixed pseudo-random choice by the row's own number."""
    salt = np.uint64((params.seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return _mix(draw ^ salt) < np.uint64(min(int(params.rows * 2.0**64), (1 << 64) - 1))


def columns_of(tree: int, count: int, params: BoostingParams) -> np.ndarray:
    rng = np.random.default_rng([params.seed, tree])
    return np.sort(rng.choice(count, max(1, int(params.columns * count)), replace=False))


def gradients(margin: np.ndarray, target: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of the weighted log loss, in whole units."""
    p = 1.0 / (1.0 + np.exp(-margin))
    weight = np.where(target == 1, ratio * _UNIT, _UNIT)
    return np.rint((p - target) * weight), np.rint(np.maximum(p * (1.0 - p), 1e-16) * weight)


class _Block:
    """A block of rows as arrays, from the fields of ``_BLOCKS``; a column's bins lie together."""

    def __init__(self, rows: int, bins, target, members, draw, margin, models: int):
        self.rows = rows
        self.bins = np.asfortranarray(np.frombuffer(bins, np.uint8).reshape(rows, -1))
        self.target, self.members, self.draw = np.frombuffer(target, np.uint8), np.frombuffer(members, np.int64), np.frombuffer(draw, np.uint64)
        self.margin = np.frombuffer(margin, np.float64).reshape(models, rows)

    @staticmethod
    def of_batch(batch: pa.RecordBatch, models: int) -> list[_Block]:
        names = ("bins", "target", "members", "draw", "margin")
        return [_Block(batch.column("rows")[k].as_py(), *[batch.column(n)[k].as_buffer() for n in names], models) for k in range(len(batch))]


def bundles(columns: np.ndarray, widths: Sequence[int], most: int = _BUNDLE) -> list[list[int]]:
    """Columns, by their place in ``columns``, that are counted together by their joint bin: ``most`` bins at most, unless one column has more."""
    out: list[tuple[int, list[int]]] = []
    for place in sorted(range(len(columns)), key=lambda c: -widths[columns[c]]):
        width = widths[columns[place]]
        at = next((i for i, (size, _) in enumerate(out) if size * width <= most), None)
        if at is None:
            out.append((width, [place]))
        else:
            out[at] = (out[at][0] * width, [*out[at][1], place])
    return [places for _, places in out]


def level_sums(
    parts: Iterable[_Block], models: int, trees: Trees, level: int, tree: int, columns: np.ndarray, widths: Sequence[int],
    ratio: float, params: BoostingParams,
) -> np.ndarray:
    """Sums (model, gradient or hessian, node of the level, column, bin) over some blocks.

    ``widths`` is a feature's number of bins, the missing one included. Columns of few bins are
    summed by their joint bin and told apart once at the end.
    """
    nodes = 1 << level
    together = bundles(columns, widths)
    sizes = [int(np.prod([widths[columns[c]] for c in places])) for places in together]
    joint = [np.zeros((models, 2, nodes * size)) for size in sizes]
    for block in parts:
        cells = []
        for places in together:
            cell = np.zeros(block.rows, np.int64)
            for c in places:
                width = widths[columns[c]]
                cell *= width
                cell += np.minimum(block.bins[:, columns[c]], width - 1)
            cells.append(cell)
        chosen = drawn(block.draw, tree, params)
        for m in range(models):
            inside = chosen & (block.members & (1 << m) != 0)
            if level:
                node = trees.walk(m, block.bins, level)
                inside &= node >= nodes - 1
            use = np.flatnonzero(inside)
            place = node.take(use).astype(np.int64) - (nodes - 1) if level else None
            g, h = gradients(block.margin[m].take(use), block.target.take(use), ratio)
            for cell, size, total in zip(cells, sizes, joint, strict=True):
                own = cell.take(use)
                if level:
                    own += place * size
                # whole numbers, so their floating sums are exact
                total[m, 0] += np.bincount(own, g, nodes * size)
                total[m, 1] += np.bincount(own, h, nodes * size)
    out = np.zeros((models, 2, nodes, len(columns), params.bins + 1), np.int64)
    for places, total in zip(together, joint, strict=True):
        split = total.astype(np.int64).reshape(models, 2, nodes, *[widths[columns[c]] for c in places])
        for i, c in enumerate(places):
            single = split.sum(axis=tuple(3 + k for k in range(len(places)) if k != i))
            out[:, :, :, c, : single.shape[-1] - 1], out[:, :, :, c, -1] = single[..., :-1], single[..., -1]
    return out


def best_splits(sums: np.ndarray, params: BoostingParams) -> dict[str, np.ndarray]:
    """For each (model, node): gain, column, bin, missing_left, and gradient and hessian whole and of the left side.

    Of equal gains the first wins: missing to the right before the left, then by column and bin.
    """
    g, h = sums[:, 0] / _UNIT, sums[:, 1] / _UNIT
    whole = g[:, :, 0].sum(axis=-1), h[:, :, 0].sum(axis=-1)

    def score(x, y):
        return x * x / (y + params.ridge)

    gains, lefts = [], []
    for missing_left in (False, True):
        left = [np.cumsum(x[..., :-1], axis=-1) + (x[..., -1:] if missing_left else 0.0) for x in (g, h)]
        right = [t[..., None, None] - x for t, x in zip(whole, left, strict=True)]
        gain = score(*left) + score(*right) - score(*whole)[..., None, None]
        gains.append(np.where((left[1] >= params.least) & (right[1] >= params.least), gain, -np.inf))
        lefts.append(left)
    both = np.stack(gains, axis=2)
    flat = both.reshape(*both.shape[:2], -1)
    at = flat.argmax(axis=-1)
    side, column, cut = np.unravel_index(at, both.shape[2:])
    m, n = np.indices(at.shape)
    picked = [np.stack([lefts[s][k] for s in (0, 1)], axis=2)[m, n, side, column, cut] for k in (0, 1)]
    return {
        "gain": np.take_along_axis(flat, at[..., None], -1)[..., 0], "column": column, "bin": cut, "missing_left": side == 1,
        "g": whole[0], "h": whole[1], "left_g": picked[0], "left_h": picked[1],
    }


def best_columns(found: Sequence[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The best of the columns' own best splits: of equal gains the one ``best_splits`` over all of them picks."""
    every = {k: np.stack([one[k] for one in found]) for k in found[0]}
    # a column's own best has the side that comes first, so sides and then columns decide
    turn = every["missing_left"] * len(found) + np.arange(len(found))[:, None, None]
    column = np.where(every["gain"] == every["gain"].max(axis=0), turn, 2 * len(found)).argmin(axis=0)
    return {k: np.take_along_axis(x, column[None], 0)[0] for k, x in every.items()} | {"column": column}


def split_level(trees: Trees, found: dict[str, np.ndarray], level: int, columns: np.ndarray, params: BoostingParams) -> bool:
    """Set a level's best splits and the weights below it; whether any node was split."""
    first, nodes = (1 << level) - 1, 1 << level
    at = slice(first, first + nodes)

    def weight(g, h):
        return -params.step * g / (h + params.ridge)

    trees.cover[:, at] = found["h"]
    if level == 0:
        trees.value[:, at] = weight(found["g"], found["h"])
    split = found["gain"] > 1e-6
    trees.feature[:, at] = np.where(split, columns[found["column"]], -1)
    trees.bin[:, at], trees.missing_left[:, at] = found["bin"], found["missing_left"]
    trees.gain[:, at] = np.where(split, found["gain"], 0.0)
    g, h, left_g, left_h = (found[k] for k in ("g", "h", "left_g", "left_h"))
    for side, (x, y) in enumerate(((left_g, left_h), (g - left_g, h - left_h))):
        below = slice(2 * first + 1 + side, 2 * (first + nodes) + side, 2)
        trees.value[:, below], trees.cover[:, below] = np.where(split, weight(x, y), 0.0), np.where(split, y, 0.0)
    return bool(split.any())


def advance(block: _Block, trees: Trees, depth: int) -> np.ndarray:
    """The block's margins after one more tree."""
    out = np.empty_like(block.margin)
    for m, margin in enumerate(block.margin):
        np.add(margin, trees.value[m].take(trees.walk(m, block.bins, depth)), out=out[m])
    return out


# -- Spark jobs -------------------------------------------------------------

def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Ascending cuts by feature from one mergeable quantile sketch each; a row is in bin b if b cuts are below it."""
    at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    row = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), at, F.lit(10_000)).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [np.unique(np.array(row[i] if row[i] is not None else [], float)) for i in range(len(features))]


def _bins_of(columns: list[np.ndarray], edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty((len(columns[0]), len(columns)), np.uint8, order="F")
    for k, (values, cuts) in enumerate(zip(columns, edges, strict=True)):
        out[:, k] = np.where(np.isnan(values), MISSING_BIN, np.searchsorted(cuts, values, side="left"))
    return out


def widths_of(edges: list[np.ndarray]) -> list[int]:
    """How many bins each feature has, the missing one included."""
    return [len(cuts) + 2 for cuts in edges]


def parts_of(rows: int, slots: int, params: BoostingParams) -> int:
    """In how many partitions the blocks are held: a block each until all slots have one, then whole
    rounds of slots with sixteen blocks a task at most. One if they fit in a block."""
    blocks = max(-(-rows // params.block), 1)
    return min(blocks, -(-blocks // (16 * slots)) * slots)


def _checkpointed(state: DataFrame) -> DataFrame:
    """The blocks written to the shared folder, in the partitions they have."""
    shared_dir(state.sparkSession)
    return state.checkpoint()


def blocks(rows: DataFrame, features: Sequence[str], edges: list[np.ndarray], models: int, params: BoostingParams) -> DataFrame:
    """Binned rows in blocks, written once. ``rows`` has key, target and members beside the features."""
    names = [f"_{k}" for k in range(len(features))]
    plain = rows.select(
        F.xxhash64("key").alias("draw"), F.col("target").cast("int").alias("target"), F.col("members").cast("long").alias("members"),
        *[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(n) for f, n in zip(features, names, strict=True)],
    )
    parts = parts_of(rows.count(), rows.sparkSession.sparkContext.defaultParallelism, params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), params.block):
                part = batch.slice(first, params.block)
                n = len(part)
                binned = _bins_of([part.column(k).to_numpy(zero_copy_only=False) for k in names], edges)
                fields = (
                    binned, part.column("target").to_numpy().astype(np.uint8), part.column("members").to_numpy().astype(np.int64),
                    part.column("draw").to_numpy().view(np.uint64), np.zeros(models * n),
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in fields]],
                    ["rows", "bins", "target", "members", "draw", "margin"],
                )

    return _checkpointed(plain.repartition(parts).mapInArrow(run, _BLOCKS))


def _advanced(state: RDD, trees: Trees, depth: int) -> RDD:
    def run(block: _Block) -> _Block:
        block.margin = advance(block, trees, depth)
        return block

    return state.map(run, preservesPartitioning=True)


# a column's best splits as they reach the driver
_FOUND = ("gain", "bin", "missing_left", "g", "h", "left_g", "left_h")


def merged_splits(
    state: RDD, trees: Trees, level: int, tree: int, columns: np.ndarray, widths: Sequence[int], ratio: float, models: int,
    params: BoostingParams,
) -> dict[str, np.ndarray]:
    """One job: the level's sums over all rows, merged column by column in a shuffle, where each
    column's best splits are found. What reaches the driver is one split a model, node and column,
    however many tasks and bins there are."""

    def run(blocks: Iterator[_Block]) -> Iterator[tuple[int, np.ndarray]]:
        total = level_sums(blocks, models, trees, level, tree, columns, widths, ratio, params)
        for c, column in enumerate(columns):
            # the bins the feature has, the missing one last
            yield c, np.delete(total[..., c, :], np.s_[widths[column] - 1 : -1], axis=-1)

    def merge(parts: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray]]:
        whole: dict[int, np.ndarray] = {}
        for c, sums in parts:
            whole[c] = whole[c] + sums if c in whole else sums
        for c, sums in whole.items():
            found = best_splits(sums[..., None, :], params)
            yield c, np.stack([found[k] for k in _FOUND])

    mergers = min(len(columns), 1 + state.getNumPartitions() // 16)
    told = dict(state.mapPartitions(run).partitionBy(mergers, int).mapPartitions(merge).collect())
    if not told:  # a table of no partitions
        return best_splits(np.zeros((models, 2, 1 << level, len(columns), params.bins + 1)), params)
    return best_columns([dict(zip(_FOUND, told[c], strict=True)) for c in range(len(columns))])


def _grown_alone(
    state: DataFrame, first: int, columns: Sequence[np.ndarray], widths: Sequence[int], ratio: float, models: int, params: BoostingParams
) -> tuple[DataFrame, list[Trees]]:
    """Some rounds of a table whose one partition needs no merging: its task's sums are already whole.

    The same steps on the same sums as the level jobs, so the same trees, without their
    waiting times, which are most of a small table's fit.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        parts = [block for batch in held for block in _Block.of_batch(batch, models)]
        grown = []
        for t, chosen in enumerate(columns, first):
            trees = Trees.empty(models, params.depth)
            for level in range(params.depth if parts else 0):
                sums = level_sums(parts, models, trees, level, t, chosen, widths, ratio, params)
                if not split_level(trees, best_splits(sums, params), level, chosen, params):
                    break
            for block in parts:
                block.margin = advance(block, trees, params.depth)
            grown.append(trees)
        told, after = pickle.dumps(grown), iter(parts)
        for batch in held:
            margins = [next(after).margin.tobytes() for _ in range(len(batch))]
            out = batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margins, pa.binary()))
            yield out.append_column("grown", pa.array([told] + [None] * (len(batch) - 1) if told else [None] * len(batch), pa.binary()))
            told = None

    after = written(state.sparkSession, "boosting-state", state.mapInArrow(run, f"{_BLOCKS}, grown binary"))
    found = after.where("grown IS NOT NULL").select("grown").first()
    rounds = pickle.loads(found["grown"]) if found else [Trees.empty(models, params.depth) for _ in columns]
    return after.drop("grown").coalesce(1), rounds


def _grown_together(
    state: DataFrame, features: Sequence[str], widths: Sequence[int], models: int, ratio: float, params: BoostingParams
) -> list[Trees]:
    """All rounds of a table of many partitions, a job a level."""
    rounds: list[Trees] = []
    held = state.rdd.map(lambda row: _Block(*row, models)).persist(StorageLevel.MEMORY_AND_DISK)
    kept = [held]
    for t in range(params.trees):
        if rounds:
            held = _advanced(held, rounds[-1], params.depth).persist(StorageLevel.MEMORY_AND_DISK)
            if t % params.restart == 0:
                held.checkpoint()
            kept.append(held)
            # the first level's job holds the new margins and needs the old ones
            if len(kept) > 2:
                kept.pop(0).unpersist()
        trees = Trees.empty(models, params.depth)
        columns = columns_of(t, len(features), params)
        for level in range(params.depth):
            found = merged_splits(held, trees, level, t, columns, widths, ratio, models, params)
            if not split_level(trees, found, level, columns, params):
                break
        rounds.append(trees)
    for old in kept:
        old.unpersist()
    return rounds


@dataclass
class Boosted:
    """Fitted models: a tree a round for each, and the cuts their bins stand for."""

    features: list[str]
    edges: list[np.ndarray]
    rounds: list[Trees]
    depth: int

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The models as a table, one row a node: also the form in which they are saved."""
        rows = []
        for t, trees in enumerate(self.rounds):
            for m in range(len(trees.feature)):
                reached = [0]
                for i in reached:
                    f = int(trees.feature[m, i])
                    cut = None
                    if f >= 0:
                        cuts, b = self.edges[f], int(trees.bin[m, i])
                        cut = float(cuts[b]) if b < len(cuts) else float("inf")
                        reached += [2 * i + 1, 2 * i + 2]
                    rows.append((m, t, i, f, cut, bool(trees.missing_left[m, i]), float(trees.value[m, i]), float(trees.gain[m, i]), float(trees.cover[m, i])))
        return spark.createDataFrame(rows, _NODES)

    @staticmethod
    def from_nodes(nodes: DataFrame, features: Sequence[str]) -> Boosted:
        """The models from their table. Bins are rebuilt from the cuts that splits use."""
        rows = nodes.toPandas().sort_values(["tree", "model", "node"])
        edges = [np.unique(rows.loc[(rows["feature"] == f) & np.isfinite(rows["cut"]), "cut"].to_numpy(float)) for f in range(len(features))]
        depth = int(np.log2(rows["node"].max() + 1)) if len(rows) else 0
        models = int(rows["model"].max()) + 1 if len(rows) else 0
        rounds = [Trees.empty(models, depth) for _ in range(int(rows["tree"].max()) + 1 if len(rows) else 0)]
        for r in rows.itertuples(index=False):
            trees = rounds[r.tree]
            trees.feature[r.model, r.node], trees.missing_left[r.model, r.node] = r.feature, r.missing_left
            trees.value[r.model, r.node], trees.gain[r.model, r.node], trees.cover[r.model, r.node] = r.value, r.gain, r.cover
            if r.feature >= 0:
                trees.bin[r.model, r.node] = np.searchsorted(edges[r.feature], r.cut, side="left")
        return Boosted(list(features), edges, rounds, depth)

    def margin(self, columns: list[np.ndarray], model: int) -> np.ndarray:
        bins = _bins_of(columns, self.edges)
        out = np.zeros(len(bins))
        for trees in self.rounds:
            out += trees.value[model][trees.walk(model, bins, self.depth)]
        return out

    def probability(self, columns: Sequence[Column], model: int = 0) -> Column:
        """Probability of target 1, from the features as columns of numbers; a null is missing."""

        @F.pandas_udf("double")
        def run(*values: pd.Series) -> pd.Series:
            return pd.Series(1.0 / (1.0 + np.exp(-self.margin([v.to_numpy(float) for v in values], model))))

        return run(*[c.cast("double") for c in columns])

    def importance(self, model: int = 0) -> np.ndarray:
        """Mean gain of a feature's splits, as shares of all features' sum."""
        total, times = np.zeros(len(self.features)), np.zeros(len(self.features))
        for trees in self.rounds:
            at = np.flatnonzero(trees.feature[model] >= 0)
            np.add.at(total, trees.feature[model][at], trees.gain[model][at])
            np.add.at(times, trees.feature[model][at], 1)
        mean = np.divide(total, times, out=np.zeros_like(total), where=times > 0)
        return mean / mean.sum() if mean.sum() > 0 else mean


def fit(rows: DataFrame, features: Sequence[str], models: int, ratio: float, params: BoostingParams = BoostingParams()) -> Boosted:
    """Fit ``models`` models in one pass.

    ``rows`` has ``key`` (any type, tells rows apart in the draws), ``target`` 0 or 1,
    ``members`` (bit m is set if model m learns from the row) and the features as numbers;
    a null feature is missing, a positive row weighs ``ratio``. The driver holds one
    level's best splits and the trees; rows stay in blocks on the executors. Every ``restart``
    trees the margins are written, which ends the lineage. A table of one partition (one
    block) is grown ``restart`` trees a job.
    """
    spark = rows.sparkSession
    ship_package(spark)
    edges = bin_edges(rows, features, params.bins)
    widths = widths_of(edges)
    state = blocks(rows, features, edges, models, params)
    parts = state.rdd.getNumPartitions()
    rounds: list[Trees] = []
    kept: list[DataFrame] = []
    while parts == 1 and len(rounds) < params.trees:
        these = range(len(rounds), min(len(rounds) + params.restart, params.trees))
        columns = [columns_of(t, len(features), params) for t in these]
        state, grown = _grown_alone(state.coalesce(1), these.start, columns, widths, ratio, models, params)
        rounds += grown
    if len(rounds) < params.trees:
        rounds = _grown_together(state, features, widths, models, ratio, params)
    return Boosted(list(features), edges, rounds, params.depth)
