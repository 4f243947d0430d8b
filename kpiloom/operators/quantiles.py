"""Exact order statistics that never sort a whole column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.operators.keys import parts_for, range_buckets


def exact_percentiles(
    df: DataFrame,
    value: str,
    quantiles: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 100_000,
) -> DataFrame:
    """Linear-interpolated percentiles: columns ``p0, p1, ...`` and ``n`` per group.

    A sketch brackets each wanted rank; one pass then counts the values inside
    the brackets exactly and folds everything else into a few gap cells, so the
    final ordering sees about ``4 / accuracy`` of the distinct values. If a
    bracket ever missed its rank the query fails rather than guesses.

    ``by`` must be a closed set of classes: its sketch rows are broadcast.
    """
    by = list(by)
    values = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    margin = 2.0 / accuracy
    edges = sorted(quantiles)
    low = [F.lit(max(0.0, q - margin)) for q in edges]
    high = [F.lit(min(1.0, q + margin)) for q in edges]
    stats = F.struct(
        F.count("_v").alias("n"),
        F.percentile_approx("_v", F.array(*low), accuracy).alias("lo"),
        F.percentile_approx("_v", F.array(*high), accuracy).alias("hi"),
    ).alias("_s")
    if by:
        sketch = values.groupBy(*by).agg(stats)
        keyed = sketch.select(*[F.col(c).alias(f"_b_{c}") for c in by], "_s")
        same = [values[c].eqNullSafe(keyed[f"_b_{c}"]) for c in by]
        tagged = values.join(F.broadcast(keyed), same, "inner")
    else:
        tagged = values.withColumn("_s", values.agg(stats).scalar())

    inside = F.lit(False)
    gap = F.lit(0)
    for i in range(len(edges)):
        lo, hi = F.col("_s.lo")[i], F.col("_s.hi")[i]
        inside = inside | F.col("_v").between(lo, hi)
        gap = gap + F.when(F.col("_v") > hi, 1).otherwise(0)
    cells = (
        tagged.select(
            *by,
            F.col("_s.n").alias("n"),
            "_v",
            gap.alias("_gap"),
            F.when(inside, F.col("_v")).alias("_cell"),
        )
        .groupBy(*by, "n", "_gap", "_cell")
        .agg(F.count("_v").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    )
    running = (
        Window.partitionBy(*by).orderBy("_min").rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = cells.withColumn("_end", F.sum("_c").over(running)).withColumn(
        "_begin", F.col("_end") - F.col("_c")
    )

    def value_at(rank):
        hit = (F.col("_begin") <= rank) & (rank < F.col("_end"))
        found = (
            F.when(rank == F.col("_end") - 1, F.col("_max"))
            .when(rank == F.col("_begin"), F.col("_min"))
            .when(F.col("_cell").isNotNull(), F.col("_cell"))
            .otherwise(F.raise_error(F.lit("percentile bracket missed its rank")).cast("double"))
        )
        return F.max(F.when(hit, found))

    aggregates = []
    for i, q in enumerate(quantiles):
        position = F.lit(float(q)) * (F.col("n") - 1)
        below = F.floor(position)
        above = F.ceil(position)
        aggregates += [
            value_at(below).alias(f"_lo{i}"),
            value_at(above).alias(f"_hi{i}"),
            F.max(position - below).alias(f"_f{i}"),
        ]
    found = ranked.groupBy(*by).agg(F.max("n").alias("n"), *aggregates)
    return found.select(
        *by,
        "n",
        *[
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"p{i}")
            for i in range(len(quantiles))
        ],
    )


def counted_percentile(df: DataFrame, value: str, quantile: float, buckets: int = 4096) -> DataFrame:
    """One row ``p``: the linear-interpolated percentile as ``percentile`` gives it, without a sketch.

    ``percentile`` brings every distinct value to one task. Here rows are counted in
    order-preserving buckets, and only the distinct values of the one or two buckets that hold
    the wanted ranks are ordered. NULLs do not count; without values ``p`` is NULL.
    """
    values = df.select(F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    bucketed = range_buckets(values, "_v", "_bucket", buckets)
    sizes = sorted(bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect())
    rows = sum(n for _, n in sizes)
    position = (rows - 1) * quantile
    below, above = math.floor(position), math.ceil(position)
    chosen, start, seen = [], 0, 0
    for bucket, n in sizes:
        if seen <= above and seen + n > below:
            start = start if chosen else seen
            chosen.append(bucket)
        seen += n
    distinct = bucketed.where(F.col("_bucket").isin(chosen)).groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy().orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = distinct.withColumn("_end", F.lit(start) + F.sum("_n").over(running))

    def at(rank: int) -> Column:
        return F.min(F.when(F.col("_end") > rank, F.col("_v")))

    lower, higher = at(below), at(above)
    between = F.lit(above - position) * lower + F.lit(position - below) * higher
    return ranked.agg(F.when(lower == higher, lower).otherwise(between).alias("p"))


def exact_auc(df: DataFrame, score: str, label: str, buckets: int | None = None) -> DataFrame:
    """One row ``auc``: rank-sum ROC-AUC, ties counted half.

    Scores are first folded to one row per distinct value, then cumulated in
    order-preserving buckets whose offsets are a running sum of bucket totals. Their
    number follows the row count unless given; the result does not depend on it.
    """
    y = F.col(label).cast("bigint")
    folded = df.groupBy(F.col(score).alias("_score")).agg(
        F.sum(y).alias("_pos"), F.sum(1 - y).alias("_neg")
    )
    parts = range_buckets(folded, "_score", "_bucket", buckets or parts_for(df.select(score)))
    totals = parts.groupBy("_bucket").agg(
        F.sum("_pos").alias("_tp"), F.sum("_neg").alias("_tn")
    )
    before = Window.partitionBy().orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_bucket", F.coalesce(F.sum("_tn").over(before), F.lit(0)).alias("_offset")
    )
    inner = (
        Window.partitionBy("_bucket").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    )
    # at most ``buckets`` offset rows, so the broadcast is bounded by construction
    ranked = parts.withColumn("_in", F.coalesce(F.sum("_neg").over(inner), F.lit(0))).join(
        F.broadcast(offsets), "_bucket"
    )
    below = (F.col("_offset") + F.col("_in")).cast("double") + F.col("_neg") / F.lit(2.0)
    won = F.sum(F.col("_pos").cast("double") * below)
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    return ranked.agg(F.try_divide(won, pairs).alias("auc"))
