"""Constraint audits: what the warehouse DDL declares, checked as Spark jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.schemas import TABLES, Table


def _stack(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def key_violations(df: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """One row: how many key values repeat and how many rows lack a key."""
    missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.select("_n", missing.alias("_missing")).agg(
        F.lit(table).alias("table_name"),
        F.lit(",".join(key)).alias("key_columns"),
        F.count_if((F.col("_n") > 1) & ~F.col("_missing")).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("_missing"), F.col("_n"))), F.lit(0)).alias("null_keys"),
    )


def audit_pk(frames: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    return _stack([key_violations(df, name, key) for name, (df, key) in frames.items()])


def star_keys(star: Mapping[str, DataFrame]) -> dict[str, tuple[DataFrame, Sequence[str]]]:
    return {n: (star[n], [t.primary_key]) for n, t in TABLES.items() if n in star}


def audit_unique(star: Mapping[str, DataFrame]) -> DataFrame:
    return _stack(
        [key_violations(star[n], n, [c]) for n, t in TABLES.items() for c in t.unique if n in star]
    )


def audit_not_null(star: Mapping[str, DataFrame]) -> DataFrame:
    parts = [
        star[n].agg(
            F.lit(n).alias("table_name"),
            F.lit(c).alias("column_name"),
            F.count_if(F.col(c).isNull()).alias("null_rows"),
        )
        for n, t in TABLES.items()
        for c in t.not_null
        if n in star
    ]
    return _stack(parts)


def orphan_keys(
    fact: DataFrame, dim: DataFrame, table: str, column: str, target: str, key: str
) -> DataFrame:
    """Rows whose non-null key has no match in the dimension.

    Both sides are stacked and folded per key, so a hot key is pre-aggregated
    on the map side and no join (of any kind) is planned.
    """
    used = fact.where(F.col(column).isNotNull()).select(
        F.col(column).alias("_key"), F.lit(1).alias("_used"), F.lit(0).alias("_known")
    )
    known = dim.select(F.col(key).alias("_key"), F.lit(0).alias("_used"), F.lit(1).alias("_known"))
    keys = used.unionByName(known).groupBy("_key").agg(
        F.sum("_used").alias("_n"), F.max("_known").alias("_known")
    )
    return keys.where((F.col("_known") == 0) & (F.col("_n") > 0)).agg(
        F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        F.lit(target).alias("references_table"),
        F.count(F.lit(1)).alias("orphan_keys"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows"),
    )


def audit_fk(star: Mapping[str, DataFrame]) -> DataFrame:
    return _stack(
        [
            orphan_keys(star[n], star[target], n, column, target, key)
            for n, t in TABLES.items()
            for column, target, key in t.foreign_keys
        ]
    )


def _bound_checks(table: Table) -> dict[str, object]:
    checks = {}
    for column, limit in table.max_length:
        checks[column] = F.length(F.col(column).cast("string")) > limit
    for column, kind in table.numerics:
        fits = F.col(column).try_cast(kind)
        checks[column] = F.col(column).isNotNull() & fits.isNull()
    return checks


def audit_bounds(star: Mapping[str, DataFrame]) -> DataFrame:
    """Values too long or too large for their column, all columns in one pass."""
    parts = []
    for name, table in TABLES.items():
        checks = _bound_checks(table)
        if name not in star or not checks:
            continue
        counted = star[name].agg(*[F.count_if(test).alias(col) for col, test in checks.items()])
        parts.append(
            counted.unpivot([], list(checks), "column_name", "violations").select(
                F.lit(name).alias("table_name"), "column_name", "violations"
            )
        )
    return _stack(parts)
