"""Classifier metrics and risk rules over a scored table, as aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.functions import columns as C
from kpiloom.functions.lookups import RECOMMENDATION
from kpiloom.operators.quantiles import exact_auc

RISK_BOUNDS = ((0.6, "High"), (0.35, "Medium"))


def accuracy(scored: DataFrame, label: str = "target", prediction: str = "prediction") -> DataFrame:
    hits = F.count_if(F.col(label) == F.col(prediction))
    return scored.agg(C.ratio_half_up(hits, F.count(F.lit(1)), 4).alias("accuracy"))


def roc_auc(scored: DataFrame, label: str = "target", score: str = "probability") -> DataFrame:
    return exact_auc(scored, score, label).select(
        C.round_half_up(F.col("auc"), 4).alias("roc_auc")
    )


def classification_report(
    scored: DataFrame,
    label: str = "target",
    prediction: str = "prediction",
    names: tuple[str, str] = ("Stay", "Leave"),
) -> DataFrame:
    """Precision, recall, F1 and support per class, plus the three averages.

    One pass counts the confusion matrix; the rest is arithmetic on one row.
    """
    y, p = F.col(label), F.col(prediction)
    cell = scored.agg(
        *[
            F.count_if((y == a) & (p == b)).cast("double").alias(f"c{a}{b}")
            for a in (0, 1)
            for b in (0, 1)
        ]
    )
    zero = F.lit(0.0)

    def ratio(part, whole):
        return F.coalesce(F.try_divide(part, whole), zero)

    def c(a, b):
        return F.col(f"c{a}{b}")

    def line(name, precision, recall, f1, support):
        return cell.select(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.cast("bigint").alias("support"),
        )

    total = c(0, 0) + c(0, 1) + c(1, 0) + c(1, 1)
    per_class = []
    for k in (0, 1):
        other = 1 - k
        precision = ratio(c(k, k), c(k, k) + c(other, k))
        recall = ratio(c(k, k), c(k, k) + c(k, other))
        f1 = ratio(2 * c(k, k), 2 * c(k, k) + c(other, k) + c(k, other))
        per_class.append((precision, recall, f1, c(k, 0) + c(k, 1)))
    lines = [line(names[k], *per_class[k]) for k in (0, 1)]
    hit_rate = ratio(c(0, 0) + c(1, 1), total)
    lines.append(line("accuracy", hit_rate, hit_rate, hit_rate, total))
    macro = [(per_class[0][i] + per_class[1][i]) / 2 for i in range(3)]
    lines.append(line("macro avg", *macro, total))
    weighted = [
        ratio(per_class[0][i] * per_class[0][3] + per_class[1][i] * per_class[1][3], total)
        for i in range(3)
    ]
    lines.append(line("weighted avg", *weighted, total))
    stacked = reduce(lambda a, b: a.unionByName(b), lines)
    return stacked.select(
        "class",
        *[C.round_half_up(F.col(m), 4).cast("double").alias(m) for m in ("precision", "recall", "f1")],
        "support",
    )


def risk_tiers(scored: DataFrame, probability: str = "probability") -> DataFrame:
    """Risk level and recommendation for every scored employee."""
    p = F.col(probability)
    level = C.tiered(p, RISK_BOUNDS, "Low")
    return (
        scored.withColumn("attrition_probability", F.bround(p, 4))
        .withColumn("risk_level", level)
        .withColumn("recommendation", C.map_values(F.col("risk_level"), RECOMMENDATION, None))
    )


def risk_alerts(scored: DataFrame, probability: str = "probability") -> DataFrame:
    """Two warning flags: overtime risk and low-income risk."""
    p = F.col(probability)
    return scored.withColumn(
        "overtime_alert", (F.col("overtime") == "Yes") & (p > 0.5)
    ).withColumn("income_alert", (F.col("monthly_income") < 3000) & (p > 0.4))
