"""Keep-first, surrogate keys and per-class numbering without one-task windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per ``key``: the first in ``order`` (NULLs first).

    The order columns come from one ``min`` over their struct, the others from one
    ``min`` over the whole row, so a group's state is at most two rows, the optimizer
    drops what a query never reads (a bare count needs only the key, and order columns
    alone do not need the others), partial aggregation folds a hot key on the map side,
    and the output is known to be unique on ``key``, which lets unused left joins against
    it disappear. Ties in ``order`` are broken by all other columns together, so the
    result is one of the rows and never a mix, and row order never matters.
    """
    others = [c for c in df.columns if c != key and c not in order]
    rank = [F.col(c) for c in order]
    whole = F.struct(*rank, *[F.col(c) for c in others])
    picked = df.groupBy(key).agg(F.min(F.struct(*rank)).alias("_first"), F.min(whole).alias("_row"))

    def column(name: str) -> Column:
        return F.col(name if name == key else f"_first.{name}" if name in order else f"_row.{name}").alias(name)

    return picked.select(*[column(c) for c in df.columns])


def first_non_null(value: str, order: Sequence[str]) -> Column:
    """First non-null value of a group, as an aggregate expression."""
    col = F.col(value)
    ranked = F.struct(*[F.col(c) for c in order], col.alias("_own"))
    return F.min(F.when(col.isNotNull(), ranked)).getField("_own")


def ordered_number(
    df: DataFrame,
    out: str,
    lead: Sequence[str],
    tail: Sequence[str],
    restart: Sequence[str] = (),
) -> DataFrame:
    """Dense 1-based numbers in the order (lead, tail), restarting per ``restart``.

    Rows are numbered inside each lead group in parallel; the groups' start
    offsets come from a running sum over their counts, one row per group.
    """
    groups = [*restart, *lead]
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
    before = (
        Window.partitionBy(*restart).orderBy(*lead).rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = sizes.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups],
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
    )
    local = df.withColumn(
        "_local", F.row_number().over(Window.partitionBy(*groups).orderBy(*tail))
    )
    same = reduce(
        lambda a, b: a & b, [local[g].eqNullSafe(starts[f"_g_{g}"]) for g in groups]
    )
    return local.join(starts, same, "left").select(
        (F.col("_start") + F.col("_local")).alias(out), *[F.col(c) for c in df.columns]
    )


def _image(value: Column) -> Column:
    """A number that grows with ``value`` and spreads both small and very large ones."""
    return F.signum(value) * F.log1p(F.abs(value))


def _cell(value: Column, low: Column, high: Column, cells: int | Column) -> Column:
    """Which of ``cells`` even parts of [low, high] a value lies in; all in the first if they are equal."""
    share = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
    return F.least(F.floor(share * cells), F.lit(cells) - 1 if isinstance(cells, int) else cells - 1).cast("bigint")


def range_buckets(df: DataFrame, column: str, out: str, buckets: int = 256, cells: int = 65_536, fine: int = 1 << 20) -> DataFrame:
    """Add an order-preserving bucket of near-equal row counts of a non-null numeric column.

    Rows are counted by ``cells`` even parts of an ordered image of the number, and rows
    of parts that hold more than a bucket's share again by finer ones, ``fine`` of them in
    all. Buckets end where these counts reach their shares. What reaches the driver is
    ``cells`` + ``fine`` counts at most, however many ``buckets`` there are; the bounds are then
    fixed, so every use of the result sees the same buckets.
    """
    value = F.col("_at")
    prepared = df.withColumn("_at", _image(F.col(column).cast("double")))
    low, high, rows = prepared.agg(F.min("_at"), F.max("_at"), F.count("_at")).first()
    if not rows:
        return prepared.withColumn(out, F.lit(0.0)).drop("_at")
    share = max(rows / buckets, 1.0)
    first = _cell(value, F.lit(low), F.lit(high), cells)
    counts = {r["c"]: r["n"] for r in prepared.groupBy(first.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    crowded = sorted(c for c, n in counts.items() if n > share)
    parts = max(fine // max(len(crowded), 1), 1)
    # a cell's own bounds: what lies outside them by rounding falls into its first or last part
    width = (high - low) / cells
    second = F.greatest(_cell(value - F.lit(low) - first * F.lit(width), F.lit(0.0), F.lit(width), parts), F.lit(0).cast("bigint"))
    place = first * parts
    inner: dict[int, int] = {}
    if crowded and width > 0:
        # as many rows as there are buckets at most
        chosen = df.sparkSession.createDataFrame([(c,) for c in crowded], "c BIGINT")
        found = prepared.withColumn("c", first).join(F.broadcast(chosen), "c").groupBy((place + second).alias("p"))
        inner = {r["p"]: r["n"] for r in found.agg(F.count(F.lit(1)).alias("n")).collect()}
        place = place + second
    full = set(crowded) if inner else set()
    ordered = sorted([(c * parts, n) for c, n in counts.items() if c not in full] + list(inner.items()))
    splits, seen, bucket = [float("-inf")], 0, 0
    for at, n in ordered:
        if int(seen / share) > bucket:
            bucket = int(seen / share)
            splits.append(float(at))
        seen += n
    splits.append(float("inf"))
    if len(splits) == 2:
        return prepared.withColumn(out, F.lit(0.0)).drop("_at")
    fixed = Bucketizer(splits=splits, inputCol="_place", outputCol=out)
    return fixed.transform(prepared.withColumn("_place", place.cast("double"))).drop("_at", "_place")


def parts_for(df: DataFrame, rows_per_part: int = 1_000_000, most: int = 65_536) -> int:
    """How many parts keep each near ``rows_per_part`` rows; one count of ``df``."""
    rows = df.agg(F.count(F.lit(1))).first()[0]
    return min(max(-(-rows // rows_per_part), 2), most)


def serial_id(df: DataFrame, out: str, key: str, buckets: int | None = None) -> DataFrame:
    """Dense 1-based BIGINT ids in the order of a unique numeric ``key``.

    The number of ``buckets`` follows the row count unless given; the ids do not depend on it.
    """
    bucketed = range_buckets(df, key, "_bucket", buckets or parts_for(df.select(key)))
    return ordered_number(bucketed, out, lead=["_bucket"], tail=[key]).drop("_bucket")


def stratified_number(
    df: DataFrame, label: str, key: str, seed: int, out: str = "rn", digits: int = 4
) -> DataFrame:
    """Random but repeatable 1-based numbers inside each class of ``label``.

    Rows are ordered by a seeded digest of ``key``. The digest's first ``digits`` hex
    digits split every class into 16^digits even parts (65,536), so a class that holds
    most rows is still numbered by many tasks; the numbers do not depend on ``digits``.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    hashed = df.withColumn("_digest", digest).withColumn("_part", F.substring("_digest", 1, digits))
    numbered = ordered_number(
        hashed, out, lead=["_part"], tail=["_digest", key], restart=[label]
    )
    return numbered.drop("_digest", "_part")
