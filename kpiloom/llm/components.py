"""Connected components of a link table, by alternating star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.sources.extracts import written


def components(spark: SparkSession, links: DataFrame, name: str = "components", rounds: int = 50) -> DataFrame:
    """(node, label) for every node of ``links`` (u, v); label is the component's smallest node.

    Each round hangs every node's larger neighbours, then its smaller ones, on the
    smallest node it knows, so components shrink to stars in a few rounds. Every
    round is a written table: lineage stays short and a lost executor costs one
    round. Links with a null end or equal ends are ignored.
    """
    u, v = F.col("u"), F.col("v")
    edges = written(
        spark, name,
        links.where(u != v).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
    )
    before = None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = edges.unionByName(edges.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        hung = small.where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        edges = written(spark, name, hung.unionByName(small.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return edges.select(u.alias("node"), v.alias("label")).unionByName(
        edges.select(v.alias("node"), v.alias("label")).distinct()
    )
