"""Quality rules with thresholds taken from the data of each language and source.

The base rules are fixed. The adaptive ones replace fixed cut-offs by fences from
quantile sketches: each value falls into a bucket whose width is 1/64 of its size,
so a sketch is a table of (language, source, metric, bucket, count). Such sketches
merge by adding counts and are the same whatever the partitioning; a quantile read
from one is at most 1/64 off. Everything here is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.llm.common import unused
from kpiloom.sources.extracts import written

SPACE = "[\\x20\\x09-\\x0D]"
METRICS = ("symbols", "dup_lines", "repeats", "word_length")


@dataclass(frozen=True)
class RuleParams:
    """Per metric of ``METRICS``: ``fence`` spreads beyond the median are kept.

    A spread reaches from the median to the ``high`` quantile, so a share of up to
    1 - ``high`` of a group may be junk without moving its fence. Where they are equal the
    group is constant up to there, and ``floors`` stands for the spread.

    Metrics are integers: symbols and repeated words per 1,000 words, repeated lines
    per 1,000 words, code points per 1,000 words.
    """

    fence: tuple[int, ...] = (6, 3, 2, 10)
    high: tuple[float, ...] = (0.75, 0.99, 0.99, 0.75)
    floors: tuple[int, ...] = (5, 2, 5, 20)


def _let(value: Column, body) -> Column:
    """Bind an expression once, so that lambdas below see a computed array."""
    return F.transform(F.array(value), body)[0]


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def _cut(a: Column, less: int) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - less, F.lit(0)))


def _windows(words: Column) -> Column:
    """64-bit hashes of all windows of eight words, by doubling."""
    def doubled(a: Column, by: int) -> Column:
        return _let(a, lambda x: F.zip_with(_cut(x, by), _shifted(x, by), lambda p, q: F.xxhash64(p, q)))

    return doubled(doubled(doubled(F.transform(words, lambda w: F.xxhash64(w)), 1), 2), 4)


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    def count(s: Column) -> Column:
        # s: (hash, place) in order; equal neighbours are repeated windows
        flagged = F.transform(
            s,
            lambda x, i: F.when(
                (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]
            ),
        )
        places = F.array_sort(F.filter(flagged, lambda p: p.isNotNull()))
        return F.aggregate(
            places,
            F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last")),
            lambda acc, p: F.struct(
                (acc["n"] + F.least(F.lit(8), p - acc["last"])).alias("n"), p.alias("last")
            ),
        )["n"]

    def of(w: Column) -> Column:
        placed = F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            _let(F.array_sort(placed), count)
        )

    return _let(windows, of)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all long.

    A null text has no words and no lines. Columns of these names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    counted = _let(words, lambda w: F.struct(F.size(w).alias("n"), _covered(_windows(w)).alias("r")))
    found, repeated = unused(docs.columns, "words", "lines")
    return (
        docs.withColumns({found: counted, repeated: _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))})
        .withColumns({
            "n_words": F.col(f"{found}.n").cast("long"),
            "word_chars": F.length(F.translate(body, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": F.col(repeated).cast("long"),
            "n_repeat_words": F.col(f"{found}.r").cast("long"),
        })
        .drop(found, repeated)
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _metric(name: str) -> Column:
    counts = {"symbols": "n_symbols", "dup_lines": "n_dup_lines", "repeats": "n_repeat_words", "word_length": "word_chars"}
    return F.expr(f"1000 * {counts[name]} div greatest(n_words, 1)")


def bucket(value: str) -> Column:
    """Order-preserving bucket of a non-negative integer column: exact below 128, then 1/64 wide."""
    bits = f"(length(bin({value})) - 7)"
    return F.expr(f"CASE WHEN {value} < 128 THEN {value} ELSE {bits} * 64 + shiftright({value}, {bits}) END")


def _lowest(b: str) -> Column:
    """Smallest value of a bucket; the inverse of ``bucket``."""
    return F.expr(f"CASE WHEN {b} < 128 THEN {b} ELSE shiftleft({b} % 64 + 64, int({b} div 64 - 1)) END")


def sketches(measured: DataFrame) -> DataFrame:
    """Quantile sketches by lang, source and metric of the documents that pass the base rules.

    One row per bucket: (lang, source, metric, bucket, n). Sketches merge by summing n.
    """
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), _metric(m).alias("value")) for m in METRICS])
    return (
        measured.where(~base_failed())
        .select("lang", "source", F.inline(pairs))
        .groupBy("lang", "source", "metric", bucket("value").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """One row per lang and source with the largest value each metric may have.

    fence = median + ``fence`` x max(``high`` quantile - median, floor), all by metric.
    """
    group = ["lang", "source", "metric"]
    running = Window.partitionBy(*group).orderBy("bucket")
    whole = Window.partitionBy(*group)
    ranked = sketch.withColumns({"upto": F.sum("n").over(running), "total": F.sum("n").over(whole)})

    def by_metric(values) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for p in zip(METRICS, values, strict=True) for x in p]), F.col("metric"))

    def quantile(percent: Column) -> Column:
        return F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), F.col("bucket")))

    high = by_metric([int(round(100 * q)) for q in params.high])
    spread = F.greatest(_lowest("high") - _lowest("mid"), by_metric(params.floors))
    bounds = (
        ranked.groupBy(*group)
        .agg(quantile(F.lit(50)).alias("mid"), quantile(high).alias("high"))
        .withColumn("most", _lowest("mid") + by_metric(params.fence) * spread)
    )
    return bounds.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("most"))).alias(f"most_{m}") for m in METRICS]
    )


def apply_rules(measured: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """Append base_failed and kept to measured documents.

    lang and source may be null; nulls form groups of their own. A document of a
    group without any passing document has failed the base rules itself. The
    fences have one row per group and are joined, not broadcast by hint.
    """
    lang, source, *most = unused(measured.columns, "lang", "source", *(f"most_{m}" for m in METRICS))
    bounds = fences(sketches(measured), params).select(
        F.col("lang").alias(lang), F.col("source").alias(source),
        *[F.col(f"most_{m}").alias(name) for m, name in zip(METRICS, most, strict=True)],
    )
    within = F.lit(True)
    for m, name in zip(METRICS, most, strict=True):
        within = within & (_metric(m) <= F.col(name))
    joined = measured.join(
        bounds,
        F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source)),
        "left",
    )
    return joined.withColumns({
        "base_failed": base_failed(),
        "kept": ~base_failed() & F.coalesce(within, F.lit(False)),
    }).drop(lang, source, *most)


def rule_documents(docs: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """Measure all documents and apply the rules. The counts are written once, without the text,
    and read for the sketches and again for the filter; other columns of ``docs`` are not kept."""
    measured = measure(docs.select("doc_id", "lang", "source", "text")).drop("text")
    return apply_rules(written(docs.sparkSession, "rules-measured", measured), params)
