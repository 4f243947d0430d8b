"""Sources: CSV with declared schemas, parquet tables as views, JDBC."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kpiloom.schemas import RAW
from kpiloom.sources.quoted import scan_quoted_csv

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

# The file each raw frame comes in, as the two public data sets name them.
RAW_FILES = {
    "orders": "olist_orders_dataset.csv",
    "items": "olist_order_items_dataset.csv",
    "payments": "olist_order_payments_dataset.csv",
    "reviews": "olist_order_reviews_dataset.csv",
    "customers": "olist_customers_dataset.csv",
    "products": "olist_products_dataset.csv",
    "translation": "product_category_name_translation.csv",
    "employees": "WA_Fn-UseC_-HR-Employee-Attrition.csv",
}
# review comments hold line breaks inside quotes
_QUOTED_BREAKS = {"reviews"}


def field_options(timestamp_format: str) -> dict[str, str]:
    """How fields are parsed: formats of dates and times, and a quote in a quoted field doubled."""
    return {
        "timestampFormat": timestamp_format,
        "timestampNTZFormat": timestamp_format,
        "dateFormat": "yyyy-MM-dd",
        "escape": '"',
    }


def scan_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    timestamp_format: str = TIMESTAMP_FORMAT,
    multiline: bool = False,
) -> DataFrame:
    """Header CSV under a declared schema: one scan, no inference pass.

    Columns are matched by header name, so a wider or reordered file still
    yields the declared columns; DATE and TIMESTAMP columns are parsed here. A quote
    inside a quoted field is doubled.
    """
    raw = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", multiline)
    return raw.options(**field_options(timestamp_format)).schema(schema).csv(path)


def header_schema(spark: SparkSession, path: str, wanted: T.StructType) -> T.StructType:
    """Full-file schema for a CSV whose header has more columns than wanted.

    Only the header row is read. Unwanted columns become STRING and are pruned
    by the caller's ``select``.
    """
    header = spark.read.option("header", True).csv(path).columns
    known = {f.name: f.dataType for f in wanted}
    return T.StructType([T.StructField(h, known.get(h, T.StringType())) for h in header])


def scan_wide_csv(
    spark: SparkSession, path: str, wanted: T.StructType, quoted_breaks: bool = False
) -> DataFrame:
    """Read only the wanted columns of a CSV that has others too.

    With ``quoted_breaks`` quoted fields may hold line breaks; the file is split all the same.
    """
    full = header_schema(spark, path, wanted)
    if quoted_breaks:
        rows = scan_quoted_csv(spark, path, full, **field_options(TIMESTAMP_FORMAT))
    else:
        rows = scan_csv(spark, path, full)
    return rows.select(*wanted.fieldNames())


def raw_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The raw frames from a folder of the eight CSV files, with their declared columns."""
    return {
        name: scan_wide_csv(spark, f"{folder.rstrip('/')}/{file}", RAW[name], name in _QUOTED_BREAKS)
        for name, file in RAW_FILES.items()
    }


def register_views(frames: Mapping[str, DataFrame]) -> None:
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def scan_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Expose a parquet table as a temp view and return it as a frame."""
    spark.read.parquet(path).createOrReplaceTempView(name)
    return spark.table(name)


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 32,
    **options: str,
) -> DataFrame:
    """Read a database table, split into range queries over a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if partition_column is not None:
        if bounds is None:
            raise ValueError("bounds are needed to split on a partition column")
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.options(**options).load()
