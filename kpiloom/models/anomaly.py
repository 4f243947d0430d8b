"""Order anomalies: features, standardisation, isolation forest, report.

The forest follows Liu, Ting & Zhou (2008): each tree isolates a subsample of
at most 256 rows by random cuts; rows that end up alone early score low.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiloom.functions import columns as C
from kpiloom.functions import lookups as L
from kpiloom.operators.quantiles import counted_percentile, exact_percentiles
from kpiloom.plans.kpi import Star, dated_orders

FEATURES = [
    "price",
    "freight_value",
    "freight_ratio",
    "payment_installments",
    "review_score",
    "delivery_days",
    "dow_num",
    "month",
]
TREES = 200
SUBSAMPLE = 256
CONTAMINATION = 0.05
SEED = 42
_HASH_RANGE = 1 << 63
_NODE_SCHEMA = (
    "tree INT, node INT, feature INT, threshold DOUBLE, left INT, right INT, path DOUBLE"
)
_CARRIED = ["order_id", "price", "freight_value", "delivery_days", "review_score"]


# -- features ---------------------------------------------------------------

def median_review(orders: DataFrame) -> DataFrame:
    return counted_percentile(orders, "review_score", 0.5).select(F.col("p").alias("median"))


def base_rows(star: Star) -> DataFrame:
    """Orders with a price and a positive delivery time, before filling."""
    chosen = dated_orders(star).where(
        F.col("price").isNotNull()
        & F.col("delivery_days").isNotNull()
        & (F.col("delivery_days") > 0)
    )
    return chosen.select(
        "order_id",
        F.col("price").cast("double").alias("price"),
        F.col("freight_value").cast("double").alias("freight_value"),
        "payment_installments",
        F.col("review_score").cast("double").alias("review_score"),
        "delivery_days",
        C.map_values(F.col("day_of_week"), L.WEEKDAY_CODE, 0).alias("dow_num"),
        "month",
    )


def feature_frame(base: DataFrame, median: DataFrame | None = None) -> DataFrame:
    """The eight model features of every selected order.

    A missing review becomes the median of the selected orders; any other
    missing feature becomes zero. Without ``median`` (``median_review(base)``) it is counted
    from ``base`` at once, so pass both as written tables when they are expensive.
    """
    median = median_review(base) if median is None else median
    review = F.coalesce(F.col("review_score"), median.scalar())
    return base.select(
        "order_id",
        "price",
        C.fill_missing(F.col("freight_value"), 0.0).alias("freight_value"),
        C.fill_missing(C.freight_ratio(F.col("freight_value"), F.col("price")), 0.0).alias(
            "freight_ratio"
        ),
        C.fill_missing(F.col("payment_installments"), 0).alias("payment_installments"),
        C.fill_missing(review, 0.0).alias("review_score"),
        "delivery_days",
        "dow_num",
        "month",
    )


def standardize(features: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Z-scores with the population deviation; a constant column becomes zero."""
    names = names or FEATURES
    stats = features.agg(
        F.struct(
            *[
                F.struct(
                    F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")
                ).alias(c)
                for c in names
            ]
        )
    ).scalar()
    tagged = features.withColumn("_stats", stats)
    scaled = []
    for c in names:
        mean, std = F.col(f"_stats.{c}.mean"), F.col(f"_stats.{c}.std")
        scaled.append(
            ((F.col(c) - mean) / F.when(std == 0, 1.0).otherwise(std)).alias(c)
        )
    others = [c for c in features.columns if c not in names]
    return tagged.select(*others, *scaled)


# -- forest -----------------------------------------------------------------

def average_path(n: int) -> float:
    """Mean unsuccessful-search depth of a binary tree over n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Random cuts until rows are alone or the height limit is met."""
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[tuple] = []
    open_nodes = [(0, x, 0)]
    next_id = 1
    while open_nodes:
        node, rows, depth = open_nodes.pop()
        low, high = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append((node, 0, math.inf, node, node, depth + average_path(len(rows))))
            continue
        feature = int(rng.choice(usable))
        cut = float(rng.uniform(low[feature], high[feature]))
        side = rows[:, feature] <= cut
        left, right = next_id, next_id + 1
        next_id += 2
        nodes.append((node, feature, cut, left, right, 0.0))
        open_nodes += [(left, rows[side], depth + 1), (right, rows[~side], depth + 1)]
    return nodes


def tree_samples(
    features: DataFrame,
    rows: int,
    trees: int = TREES,
    subsample: int = SUBSAMPLE,
    seed: int = SEED,
    key: str = "order_id",
) -> DataFrame:
    """Give every tree a random subsample: ``tree`` plus key and features.

    One seeded permutation of the table is cut into consecutive runs of
    ``subsample`` rows, one run per tree; small tables are permuted again until
    all trees are served. Only hashes below a threshold are ordered, so that is near
    ``trees * subsample`` rows whatever the table's size; the threshold is on the same
    hash as the order, so it keeps a prefix of it and cannot change the result.
    """
    size = min(subsample, rows)
    per_round = max(1, min(trees, rows // size))
    rounds = math.ceil(trees / per_round)
    # expected kept rows exceed the need by far more than sampling noise
    wanted = per_round * size
    keep_share = min(1.0, (1.2 * wanted + 1000) / rows)
    drawn = features.withColumn(
        "_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))) if rounds > 1 else F.lit(0)
    ).withColumn(
        "_hash", F.shiftrightunsigned(F.xxhash64(F.col(key), F.col("_round"), F.lit(seed)), 1)
    ).where(F.col("_hash") <= min(math.ceil(keep_share * _HASH_RANGE), _HASH_RANGE - 1))
    # each round now holds at most about 1.2 * trees * subsample + 1000 rows
    order = Window.partitionBy("_round").orderBy("_hash", key)
    ranked = drawn.withColumn("_rank", F.row_number().over(order) - 1)
    tree = F.col("_round") * per_round + F.floor(F.col("_rank") / size)
    return (
        ranked.where(F.col("_rank") < wanted)
        .withColumn("tree", tree.cast("int"))
        .where(F.col("tree") < trees)
        .select("tree", key, *[F.col(c).cast("double").alias(c) for c in FEATURES])
    )


def fit_trees(
    samples: DataFrame, seed: int = SEED, key: str = "order_id", size: int | None = None
) -> DataFrame:
    """One call per tree over its subsample; the node table is the model.

    With ``size`` given, a tree whose subsample came out shorter is an error.

    The samples are few bytes but much work, so they are spread by number of
    slots instead of by size.
    """
    slots = samples.sparkSession.sparkContext.defaultParallelism

    def build(group: pd.DataFrame) -> pd.DataFrame:
        if size is not None and len(group) != size:
            raise ValueError(f"a tree has {len(group)} rows in its subsample, not {size}")
        group = group.sort_values(key)
        tree = int(group["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        nodes = _grow_tree(group[FEATURES].to_numpy(dtype=float), rng)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "path"])
        out.insert(0, "tree", tree)
        return out

    spread = samples.repartition(max(1, min(slots, TREES)), "tree")
    return spread.groupBy("tree").applyInPandas(build, _NODE_SCHEMA)


@dataclass
class Forest:
    """Node arrays of all trees, shape (trees, nodes); leaves point at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    height: int
    subsample: int

    @cached_property
    def _packed(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Complete trees: the thresholds of each feature in order, each node's feature and its
        threshold's place in that order, and the leaves' paths. Children of node ``i`` (from 1)
        are ``2i`` and ``2i + 1``; below a leaf all nodes are that leaf."""
        feature, threshold, at = [], [], np.zeros((len(self.feature), 1), dtype=np.int64)
        for _ in range(self.height):
            feature.append(np.take_along_axis(self.feature, at, 1))
            threshold.append(np.take_along_axis(self.threshold, at, 1))
            below = [np.take_along_axis(side, at, 1) for side in (self.left, self.right)]
            at = np.stack(below, axis=2).reshape(len(at), -1)
        none = np.zeros((len(at), 1), dtype=np.int64)
        feature = np.concatenate([none, *feature], axis=1)
        threshold = np.concatenate([none + np.inf, *threshold], axis=1)
        cuts = [np.unique(threshold[feature == f]) for f in range(int(feature.max()) + 1)]
        rank = np.zeros_like(feature)
        for f, ordered in enumerate(cuts):
            rank[feature == f] = np.searchsorted(ordered, threshold[feature == f])
        return cuts, feature, rank, np.take_along_axis(self.path, at, 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """−2^(−mean depth / expected depth): lower is more anomalous."""
        out = np.empty(len(x))
        for start in range(0, len(x), 10_000):
            out[start : start + 10_000] = self._scores(x[start : start + 10_000])
        return out

    def _scores(self, x: np.ndarray) -> np.ndarray:
        """A value is at most a threshold if no more thresholds are below it than below that one, so
        places stand for both. A word holds a feature's first place in the table of values and,
        in its low bits, a place: one look-up gives a node, one the row's value, and their
        difference has the sign of the side to take."""
        cuts, feature, rank, path = self._packed
        rows, trees = len(x), len(feature)
        bits = max(len(c) for c in cuts).bit_length()
        values = np.empty((len(cuts), rows), dtype=np.int64)
        for f, ordered in enumerate(cuts):
            values[f] = np.searchsorted(ordered, x[:, f]) + ((f * rows) << bits)
        flat, first = values.ravel(), np.arange(rows)
        at, node, place, value = (np.empty(rows, dtype=np.int64) for _ in range(4))
        depth = np.empty((trees, rows))
        # a tree at a time: its nodes and the rows' places stay in the processor's cache
        for t in range(trees):
            words = ((feature[t] * rows) << bits) + rank[t]
            at.fill(1)
            for level in range(self.height):
                if level:
                    words.take(at, out=node, mode="wrap")
                    np.right_shift(node, bits, out=place)
                    place += first
                    flat.take(place, out=value, mode="wrap")
                else:
                    node.fill(words[1])
                    value[:] = values[feature[t, 1]]
                node -= value
                node >>= 63  # -1 to the right, 0 to the left
                at += at
                at -= node
            at -= 1 << self.height
            path[t].take(at, out=depth[t], mode="wrap")
        mean = np.empty(rows)
        for start in range(0, rows, 1024):
            mean[start : start + 1024] = np.ascontiguousarray(depth[:, start : start + 1024].T).mean(axis=1)
        return -np.exp2(-mean / average_path(self.subsample))


def save_forest(nodes: DataFrame, subsample: int, path: str) -> None:
    """Write the node table with what scoring must know: feature names and sample size."""
    nodes.select(
        "*",
        F.array(*[F.lit(c) for c in FEATURES]).alias("features"),
        F.lit(subsample).alias("subsample"),
    ).write.mode("overwrite").parquet(path)


def read_forest(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Node table and sample size of a saved forest; another feature list is an error."""
    saved = spark.read.parquet(path)
    about = saved.select("features", "subsample").first()
    if about["features"] != FEATURES:
        raise ValueError(f"the forest was grown on {about['features']}")
    return saved.drop("features", "subsample"), about["subsample"]


def load_forest(nodes: DataFrame, subsample: int) -> Forest:
    """Pack the node table. It has at most trees × (2·256 − 1) rows: a model,
    not data, so it is small enough for the driver and for a broadcast."""
    table = nodes.toPandas().sort_values(["tree", "node"])
    trees = int(table["tree"].max()) + 1
    width = int(table["node"].max()) + 1
    shape = (trees, width)
    at = (table["tree"].to_numpy(), table["node"].to_numpy())

    def pack(name: str, dtype) -> np.ndarray:
        grid = np.zeros(shape, dtype=dtype)
        grid[at] = table[name].to_numpy()
        return grid

    return Forest(
        pack("feature", np.int64),
        pack("threshold", float),
        pack("left", np.int64),
        pack("right", np.int64),
        pack("path", float),
        math.ceil(math.log2(max(subsample, 2))),
        subsample,
    )


def fit_forest(
    features: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED
) -> DataFrame:
    """Node table of a forest grown on ``features`` (read twice: count, sample)."""
    rows = features.agg(F.count(F.lit(1))).first()[0]
    if rows == 0:
        raise ValueError("no rows to fit an isolation forest on")
    return fit_trees(
        tree_samples(features, rows, trees, subsample, seed), seed, size=min(subsample, rows)
    )


def score_forest(spark: SparkSession, features: DataFrame, nodes: DataFrame, subsample: int) -> DataFrame:
    """Add ``anomaly_score`` to every row with one vectorised pass.

    Rows are scored where their splits are read; repartition a small table first.
    """
    shared = spark.sparkContext.broadcast(load_forest(nodes, subsample))
    fields = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in features.schema if f.name in _CARRIED
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[_CARRIED].copy()
            out["anomaly_score"] = shared.value.scores(batch[FEATURES].to_numpy(dtype=float))
            yield out

    carried = [f.split(" ")[0] for f in fields.split(", ")]
    ordered = features.select(*carried, *[c for c in FEATURES if c not in carried])
    return ordered.mapInPandas(run, f"{fields}, anomaly_score DOUBLE").select(
        *_CARRIED, "anomaly_score"
    )


def flag_anomalies(scored: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Flag the rows that score below the exact ``contamination`` percentile."""
    limit = exact_percentiles(scored, "anomaly_score", [contamination]).select("p0")
    return scored.withColumn("is_anomaly", F.col("anomaly_score") < limit.scalar())


# -- report -----------------------------------------------------------------

def anomaly_report(flagged: DataFrame) -> DataFrame:
    """Counts and the normal / anomalous averages, all in one aggregate."""
    bad = F.col("is_anomaly")

    def mean(column: str, condition, digits: int):
        return F.round(F.avg(F.when(condition, F.col(column))), digits)

    return flagged.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(bad).alias("anomaly_count"),
        C.percent_where(bad, 2).cast("double").alias("anomaly_pct"),
        mean("price", ~bad, 2).alias("avg_price_normal"),
        mean("price", bad, 2).alias("avg_price_anomaly"),
        mean("delivery_days", ~bad, 1).alias("avg_delivery_normal"),
        mean("delivery_days", bad, 1).alias("avg_delivery_anomaly"),
    )


def anomaly_extract(flagged: DataFrame) -> DataFrame:
    return flagged.where("is_anomaly").select(*_CARRIED, "anomaly_score")


def anomaly_kpis(extract: DataFrame) -> DataFrame:
    return extract.agg(
        F.count(F.lit(1)).alias("anomalies"),
        F.avg("price").alias("avg_price"),
        F.avg("delivery_days").alias("avg_delivery_days"),
    )


def lowest_scores(extract: DataFrame, n: int = 20) -> DataFrame:
    return extract.orderBy("anomaly_score", "order_id").limit(n)
