"""Repeated lines are dropped with the help of levelled sorted runs of line hashes.

A run is a table of line hashes, bucketed and sorted by hash, with the number of
documents that hold the line and the largest document id. Documents come in batches.
The lines of a batch are folded by hash and merge-joined with all runs: hashes that no
run holds become the batch's own run, the others a log of repeats. So every hash lies
in one run only. Runs of one level are merged into one of the next when there are
``fanout`` of them. Runs are never shuffled again: joins and merges go bucket by bucket.

A line is known by the first 128 bits of the SHA-256 of its key. Everything here is
DataFrame functions.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm.common import unused
from kpiloom.session import fresh_path
from kpiloom.sources.extracts import written

_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LineParams:
    """Keys of at least ``least_chars`` code points in at least ``least_docs`` documents are dropped.

    ``batches`` and ``fanout`` shape the runs; no result depends on them.
    """

    least_chars: int = 40
    least_docs: int = 5
    batches: int = 4
    fanout: int = 2


def line_keys(text: Column) -> Column:
    """Keys of all lines: blanks stripped at both ends, A-Z in lower case. A null text is one empty line."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.transform(F.split(low, "\n", -1), lambda line: F.btrim(line, F.lit(_SPACE)))


def _digest(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(key.cast("binary"), 256), 1, 32))


@dataclass
class LineRuns:
    """The runs by level, the log of repeats, and how both grow by a batch.

    ``buckets`` is the partition count of the session's shuffles, so that folding a
    batch deals it out the way the runs lie.
    """

    spark: SparkSession
    fanout: int = 2
    levels: list[list[str]] = field(default_factory=list)
    batches: list[str] = field(default_factory=list)
    buckets: int = 0

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _store(self, frame: DataFrame, split: str | None = None) -> str:
        name = f"line_runs_{uuid.uuid4().hex[:16]}"
        writer = frame.write.format("parquet").option("path", fresh_path(self.spark, "line-run"))
        if split:
            writer = writer.partitionBy(split)
        writer.bucketBy(self.buckets, "h").sortBy("h").saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(t).where("fresh").select("h", "n", "top") for level in self.levels for t in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Take in a batch: ``lines`` has one row (doc_id, h) for each document and line hash.

        Returns (h, n, top, seen, fresh): n counts the batch, seen is the number of documents
        in the run that holds the hash, null for those that are new; top covers both. Documents of a batch must
        not come again in a later one.
        """
        if self.levels and len(self.levels[0]) >= self.fanout:
            self._compact(0)
        found = lines.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top"))
        none = F.lit(None)
        seen, tops = [none.cast("long"), none.cast("long")], [F.col("top"), F.col("top")]
        for k, run in enumerate(self.runs()):
            known = run.select(F.col("h").alias(f"h{k}"), F.col("n").alias(f"n{k}"), F.col("top").alias(f"top{k}"))
            found = found.join(known.hint("merge"), F.col("h") == F.col(f"h{k}"), "left")
            seen.append(F.col(f"n{k}"))
            tops.append(F.col(f"top{k}"))
        before = F.coalesce(*seen)
        rows = found.select("h", "n", F.greatest(*tops).alias("top"), before.alias("seen"), before.isNull().alias("fresh"))
        name = self._store(rows, "fresh")
        self.batches.append(name)
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(name)
        return self.spark.table(name)

    def _compact(self, level: int) -> None:
        """Merge the runs of a level, which share no hash, into one run of the next level."""
        if len(self.levels) == level + 1:
            self.levels.append([])
        if len(self.levels[level + 1]) >= self.fanout:
            self._compact(level + 1)
        merged = None
        for name in self.levels[level]:
            run = self.spark.table(name).where("fresh").select("h", "n", "top")
            merged = run if merged is None else self._merge(merged, run)
        self.levels[level + 1].append(self._store(merged.withColumn("fresh", F.lit(True))))
        self.levels[level] = []

    @staticmethod
    def _merge(left: DataFrame, right: DataFrame) -> DataFrame:
        a, b = left.alias("a"), right.hint("merge").alias("b")
        both = a.join(b, F.col("a.h") == F.col("b.h"), "full")
        return both.select(*[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in ("h", "n", "top")])

    def totals(self, least: int) -> DataFrame:
        """(h, n, top) of the hashes that at least ``least`` documents hold, over all batches."""
        empty = F.lit(0).cast("long")
        rows = None
        for run in self.runs():
            part = run.where(F.col("n") >= least).select("h", F.col("n").alias("first"), empty.alias("more"), "top")
            rows = part if rows is None else rows.unionByName(part)
        for name in self.batches:
            part = self.spark.table(name).where("not fresh")
            rows = rows.unionByName(part.select("h", F.col("seen").alias("first"), F.col("n").alias("more"), "top"))
        folded = rows.groupBy("h").agg((F.max("first") + F.sum("more")).alias("n"), F.max("top").alias("top"))
        return folded.where(F.col("n") >= least)

    def forget(self) -> None:
        """Take the runs out of the catalog; their files stay below the shared folder."""
        for name in {*self.batches, *(t for level in self.levels for t in level)}:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def drop_repeated_lines(docs: DataFrame, params: LineParams = LineParams(), text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, and ``kept_text``, ``n_lines`` and ``n_dropped``, which replace columns so named.

    A line goes if its key has at least ``least_chars`` code points, at least
    ``least_docs`` documents hold it and this is not the largest doc_id that does.
    Every row is a document of its own, also with a repeated doc_id; rows that share
    the largest id keep the line. A null id is smaller than any other. A null or
    empty text is one empty line. A task holds one text and its lines at a time.
    """
    spark = docs.sparkSession
    body = F.col(text)
    marks = F.transform(F.filter(line_keys(body), lambda k: F.length(k) >= params.least_chars), _digest)
    held = docs.select(
        "doc_id",
        F.pmod(F.xxhash64("doc_id"), F.lit(params.batches)).cast("int").alias("batch"),
        F.explode(F.array_distinct(marks)).alias("h"),
    )
    path = fresh_path(spark, "lines")
    held.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h binary, batch int").parquet(path)

    runs = LineRuns(spark, params.fanout)
    for k in range(params.batches):
        runs.add(lines.where(F.col("batch") == k).select("doc_id", "h"))
    repeated = written(spark, "repeated-lines", runs.totals(params.least_docs))
    runs.forget()

    gone_id, gone, left = unused(docs.columns, "gone_id", "gone", "left")
    by_document = (
        lines.join(repeated.select("h", "top"), "h")
        .where(~F.col("doc_id").eqNullSafe(F.col("top")))
        .groupBy(F.col("doc_id").alias(gone_id))
        .agg(F.collect_set("h").alias(gone))
    )
    joined = docs.join(by_document, F.col("doc_id").eqNullSafe(F.col(gone_id)), "left")
    split = F.split(F.coalesce(body, F.lit("")), "\n", -1)
    goes = F.transform(
        line_keys(body), lambda k: (F.length(k) >= params.least_chars) & F.array_contains(F.col(gone), _digest(k))
    )
    kept = F.transform(
        F.filter(F.arrays_zip(split.alias("line"), goes.alias("goes")), lambda x: ~x["goes"]), lambda x: x["line"]
    )
    whole = F.struct(F.coalesce(body, F.lit("")).alias("text"), F.size(split).alias("n"))
    part = F.transform(F.array(kept), lambda x: F.struct(F.array_join(x, "\n").alias("text"), F.size(x).alias("n")))[0]
    n_lines = F.size(split).cast("long")
    return (
        joined.withColumn(left, F.when(F.col(gone).isNull(), whole).otherwise(part))
        .withColumns({
            "kept_text": F.col(f"{left}.text"), "n_lines": n_lines, "n_dropped": n_lines - F.col(f"{left}.n"),
        })
        .drop(gone_id, gone, left)
    )
