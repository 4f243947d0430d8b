"""Sinks: append, replace, CSV, metrics JSON, table copies and table creation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kpiloom.plans.star import build_dimensions, build_facts, conform, number_employees
from kpiloom.schemas import TABLES
from kpiloom.sources import versions
from kpiloom.sources.extracts import written
from kpiloom.sources.readers import TIMESTAMP_FORMAT, raw_folder


def append(df: DataFrame, path: str) -> None:
    """Add rows to the table as it is now."""
    df.write.mode("append").parquet(versions.current(df.sparkSession, path))


def replace(df: DataFrame, path: str) -> None:
    """Full refresh: the new rows take the place of whatever was there once all are written.

    The old rows stay readable until then, and for good if the load fails. Read the
    table with ``versions.read``.
    """
    versions.publish(df, path)


def write_csv(df: DataFrame, path: str, keep_blanks: bool = False) -> None:
    """Header CSV; blanks around a value are dropped unless ``keep_blanks``."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    if keep_blanks:
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    for name in ("timestampFormat", "timestampNTZFormat"):
        writer = writer.option(name, TIMESTAMP_FORMAT)
    writer.csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A one-row metrics frame as JSON; ``df`` is already reduced to one row."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_jdbc(df: DataFrame, url: str, table: str, replace_rows: bool, **options: str) -> None:
    """Batched insert; a replace truncates so that grants and keys survive."""
    writer = df.write.format("jdbc").option("url", url).option("dbtable", table)
    writer = writer.option("batchsize", 1000).options(**options)
    if replace_rows:
        writer.option("truncate", True).mode("overwrite").save()
    else:
        writer.mode("append").save()


def load_star(
    spark: SparkSession, raw: Mapping[str, DataFrame], root: str, declared: bool = False, tables: Iterable[str] = tuple(TABLES)
) -> dict[str, int]:
    """Build and write the eight tables (or some of them) under ``root``; row counts back.

    Dimensions are written first and the facts look their keys up in the
    written dimensions, so no dimension is derived twice. ``declared`` casts
    to the declared types; without it keys keep the cheaper type of their
    source and sums their full precision (an overflow is then an audit
    finding, not a failed load), and the raw employee key is kept. The counts
    are observed during the writes, so no table is read just to count it.

    Orders are stored in ranges of ``date_id``, which follows the calendar: a query on a
    period skips the row groups outside it. Both facts are joined once and written; the
    ranges' sample and the employees' numbers are taken from the written rows.
    """

    def shaped(name: str, frame: DataFrame) -> DataFrame:
        if declared:
            return conform(frame, name)
        names = [*TABLES[name].schema.fieldNames(), "source_key"]
        return frame.select(*[c for c in names if c in frame.columns])

    def store(frames: Mapping[str, DataFrame]) -> dict[str, int]:
        return copy_frames({n: shaped(n, f) for n, f in frames.items()}, root)

    chosen = set(tables)
    dimensions = build_dimensions(spark, raw)
    counts = store({name: frame for name, frame in dimensions.items() if name in chosen})
    if not chosen - set(dimensions):
        return counts
    looked_up = {source for table in chosen for source in STAR_SOURCES[table]}
    dims = {n: versions.read(spark, f"{root}/{n}") if n in looked_up else frame for n, frame in dimensions.items()}
    facts = {name: frame for name, frame in build_facts(raw, dims).items() if name in chosen}
    if "fact_orders" in facts:
        joined = written(spark, "order-rows", facts["fact_orders"])
        facts["fact_orders"] = joined.repartitionByRange("date_id", "order_id").sortWithinPartitions("date_id", "order_id")
    if "fact_employees" in facts:
        facts["fact_employees"] = number_employees(
            written(spark, "employee-rows", facts["fact_employees"])
        )
    return counts | store(facts)


# What each table is made of: raw frames, and tables whose keys it looks up.
STAR_SOURCES = {
    "dim_date": ("orders",),
    "dim_customer": ("customers",),
    "dim_product": ("products", "translation"),
    "dim_geography": ("customers", "regions"),
    "dim_department": ("employees",),
    "dim_attrition_label": (),
    "fact_orders": ("orders", "items", "payments", "reviews", "customers", "dim_date", "dim_geography"),
    "fact_employees": ("employees", "dim_department", "dim_attrition_label", "dim_date"),
}
_MANIFEST = "_manifest"


def table_marks(marks: Mapping[str, str], code: str = "") -> dict[str, str]:
    """A mark of each table, which changes with those of the raw frames it is made of, or with ``code``."""
    out: dict[str, str] = {}
    for table, sources in STAR_SOURCES.items():
        parts = [code, *(out[s] if s in out else marks.get(s, "") for s in sources)]
        out[table] = hashlib.sha256("\n".join(parts).encode()).hexdigest()
    return out


def attach_star(
    spark: SparkSession, raw: Mapping[str, DataFrame], root: str, marks: Mapping[str, str], code: str = "", declared: bool = False,
    tables: Iterable[str] = tuple(TABLES),
) -> tuple[dict[str, int], list[str]]:
    """The star under ``root``, or some of its ``tables`` with those they look keys up in, loading
    only what is missing or older than its sources.

    ``marks`` has a mark of each raw frame (``versions.source_mark``); a manifest beside the
    tables keeps each table's mark and row count, and is written after the tables.
    Returns the row counts of these tables and the names of those that were loaded.
    """
    chosen = set(tables)
    chosen |= {source for t in chosen for source in STAR_SOURCES[t]}
    every = table_marks(marks, code)
    wanted = {t: mark for t, mark in every.items() if t in chosen}
    known = json.loads(versions.read_note(spark, f"{root}/{_MANIFEST}") or "{}")
    stale = [t for t, mark in wanted.items() if known.get(t, {}).get("mark") != mark]
    if stale:
        counts = load_star(spark, raw, root, declared, tables=stale)
        known = {t: known[t] for t in every if t in known and t not in stale} | {t: {"mark": wanted[t], "rows": n} for t, n in counts.items()}
        versions.write_note(spark, f"{root}/{_MANIFEST}", json.dumps(known, sort_keys=True))
    return {t: known[t]["rows"] for t in wanted}, stale


def load_star_from_csv(spark: SparkSession, folder: str, root: str) -> dict[str, int]:
    """The batch job: raw CSV folder in, eight declared tables out, row counts back."""
    return load_star(spark, raw_folder(spark, folder), root, declared=True)


def copy_frames(frames: Mapping[str, DataFrame], root: str) -> dict[str, int]:
    counts = {}
    for name, frame in frames.items():
        seen = Observation(f"rows_{name}")
        replace(frame.observe(seen, F.count(F.lit(1)).alias("rows")), f"{root}/{name}")
        counts[name] = seen.get["rows"]
    return counts


def copy_tables(
    spark: SparkSession, source: str, target: str, tables: Iterable[str] = tuple(TABLES)
) -> dict[str, int]:
    """Copy tables between two stores in reference order, keys unchanged."""
    return copy_frames({t: versions.read(spark, f"{source}/{t}") for t in tables}, target)


def counts_frame(spark: SparkSession, counts: Mapping[str, int]) -> DataFrame:
    return spark.createDataFrame(list(counts.items()), "table_name STRING, n BIGINT")


def create_tables(spark: SparkSession, database: str, root: str) -> list[str]:
    """CREATE TABLE IF NOT EXISTS for the eight warehouse tables, its tables and the database's own folder below ``root``."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}/database'")
    names = []
    for table in TABLES.values():
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{table.name} ({columns}) "
            f"USING parquet LOCATION '{root}/{table.name}'"
        )
        names.append(f"{database}.{table.name}")
    return names


def drop_tables(spark: SparkSession, database: str) -> None:
    """Take the database and its tables out of the catalog; the tables' files stay."""
    spark.sql(f"DROP DATABASE IF EXISTS {database} CASCADE")
