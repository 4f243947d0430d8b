"""CSV whose quoted fields hold line breaks, read in byte ranges by many tasks.

Spark's text source deals a file out in byte ranges and gives each range the lines that
start in it. A range counts its quotes; the running parity of these counts over the
ranges before it tells whether a range starts inside quotes. With that, each task cuts
its own lines into records. A record that runs on into later ranges belongs to the range
it starts in; only such pieces, two a range at most, are brought together again. Fields
are parsed by ``from_csv``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom.session import ship_package
from kpiloom.sources.extracts import written

# A whole record; what ends a record of an earlier range; what begins one that this range does not end.
WHOLE, END, BEGINNING = 0, 1, 2
_PIECES = "path string, start long, kind int, heads boolean, record string"


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, path, start): each line with its file and the first byte of its range, in file order in a task."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def open_ranges(lines: DataFrame) -> DataFrame:
    """(path, start) of the ranges that start inside quotes; at most a row for each range of the input."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    odd = lines.groupBy("path", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return odd.withColumn("seen", F.sum("odd").over(before)).where("seen % 2 = 1").select("path", "start")


class _Range:
    """The records of one range, from its lines in any number of batches."""

    def __init__(self, path: str, start: int, inside: bool):
        self.path, self.start, self.inside = path, start, inside
        self.heads = start == 0
        self.kind = END if inside else WHOLE
        self.held: list[str] = []
        self.out: list[tuple[str, int, int, bool, str]] = []

    def take(self, lines: pa.Array) -> None:
        """Cut the next lines into records; a line that ends inside quotes is held for the next one."""
        odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) % 2 == 1
        after = (np.cumsum(odd) + self.inside) % 2 == 1
        first = 0
        for last in np.flatnonzero(~after).tolist():
            self._emit([*self.held, *lines.slice(first, last + 1 - first).to_pylist()])
            self.held, first = [], last + 1
        self.held += lines.slice(first).to_pylist()
        self.inside = bool(after[-1])

    def _emit(self, parts: list[str]) -> None:
        text = "\n".join(parts)
        self.out.append((self.path, self.start, self.kind, self.heads and self.kind == WHOLE, text))
        self.heads, self.kind = self.heads and self.kind != WHOLE, WHOLE

    def end(self) -> None:
        """What the range leaves open: the beginning of a record, or all of it inside an earlier one."""
        if self.held:
            self.kind = self.kind if self.kind == END else BEGINNING
            self.out.append((self.path, self.start, self.kind, self.heads, "\n".join(self.held)))
        self.held = []

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) or [[]] * 5
        self.out = []
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["path", "start", "kind", "heads", "record"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in batches:
        lines, paths, starts, inside = batch.columns
        key = paths.dictionary_encode().indices.to_numpy(), starts.to_numpy()
        edges = np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(lines)], strict=True):
            if a == b:
                continue
            path, start = paths[a].as_py(), starts[a].as_py()
            if now is None or (now.path, now.start) != (path, start):
                if now is not None:
                    now.end()
                    yield now.taken()
                now = _Range(path, start, inside[a].as_py())
            now.take(lines.slice(a, b - a))
        if now is not None:
            yield now.taken()
    if now is not None:
        now.end()
        yield now.taken()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, heads): every record of the files as text, and whether it is a file's first.

    Quotes follow the usual rule: a field with a quote, comma or line break is quoted,
    and a quote inside it is doubled. A record that is still open at the end of a file is
    returned as it is. A task holds one record and one batch of lines at a time; the
    driver holds nothing of the files.
    """
    ship_package(spark)
    lines = physical_lines(spark, path)
    opened = open_ranges(lines).withColumn("inside", F.lit(True))
    # a row for each range that starts inside quotes at most, and never the lines' side: their order must stay
    marked = lines.join(F.broadcast(opened), ["path", "start"], "left")
    pieces = marked.select("line", "path", "start", F.coalesce("inside", F.lit(False)).alias("inside")).mapInArrow(_cut, _PIECES)
    kept = written(spark, "quoted-records", pieces)
    # an end belongs to the last beginning before it; within a range the end comes first
    upto = Window.partitionBy("path").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parted = kept.where(F.col("kind") != WHOLE).withColumn("owner", F.sum(F.when(F.col("kind") == BEGINNING, 1).otherwise(0)).over(upto))
    joined = parted.groupBy("path", "owner").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "record"))).alias("parts"), F.bool_or("heads").alias("heads")
    )
    text = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
    return kept.where(F.col("kind") == WHOLE).select("record", "heads").unionByName(joined.select(text.alias("record"), "heads"))


def scan_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    """Rows of header CSV files whose columns are those of ``schema``, in that order.

    The rows are those of Spark's reader with ``multiLine``, without its one task a file.
    """
    found = records(spark, path).where(~F.col("heads"))
    # line breaks of the other convention come out as the reader gives them, and empty lines are no rows
    text = F.regexp_replace("record", "\r\n|\r$", "\n")
    body = found.select(F.rtrim(text, F.lit("\n")).alias("record")).where("record <> ''")
    return body.select(F.from_csv("record", schema.simpleString(), options).alias("row")).select("row.*")
