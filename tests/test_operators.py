from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kpiloom.operators import keys
from kpiloom.operators.quantiles import counted_percentile, exact_auc, exact_percentiles

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@FEW
@given(st.lists(st.floats(-1e6, 1e6, width=32), min_size=1, max_size=60))
def test_percentiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v DOUBLE")
    qs = [0.0, 0.05, 0.25, 0.5, 0.75, 1.0]
    row = exact_percentiles(df, "v", qs).first()
    want = np.percentile(np.array(values, dtype=float), [q * 100 for q in qs])
    got = [row[f"p{i}"] for i in range(len(qs))]
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-6)
    assert row["n"] == len(values)


@pytest.mark.parametrize(("quantile", "buckets"), [(0.05, 7), (0.731, 4096)])
def test_counted_percentile_is_that_of_the_plain_aggregate(spark, quantile, buckets):
    rng = np.random.default_rng(23)
    tied = np.concatenate([-rng.random(3000), np.full(1500, -0.45), -0.45 + rng.random(500) * 1e-12])
    for values in (tied, rng.normal(size=777) * 1e6, np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in rng.permutation(values)] + [(None,)], "v DOUBLE")
        want = df.agg(F.percentile("v", quantile)).first()[0]
        assert counted_percentile(df, "v", quantile, buckets).first()["p"] == want


def test_counted_percentile_without_values_is_null(spark):
    df = spark.createDataFrame([(None,)], "v DOUBLE")
    assert counted_percentile(df, "v", 0.05).collect() == [(None,)]
    assert counted_percentile(df.limit(0), "v", 0.05).collect() == [(None,)]


@pytest.mark.parametrize("accuracy", [10, 100, 100_000])
def test_percentiles_with_coarse_sketch_and_hot_value(spark, accuracy):
    """A coarse sketch leaves wide brackets and real gap cells; results stay exact."""
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(size=3000), np.full(1500, 0.25)])
    group = np.where(rng.random(len(values)) < 0.8, "a", "b")
    df = spark.createDataFrame(
        [(str(g), float(v)) for g, v in zip(group, values)] + [("a", None)], "g STRING, v DOUBLE"
    ).repartition(5)
    qs = [0.05, 0.25, 0.5, 0.75, 0.95]
    for row in exact_percentiles(df, "v", qs, by=["g"], accuracy=accuracy).collect():
        mine = values[group == row["g"]]
        np.testing.assert_allclose(
            [row[f"p{i}"] for i in range(len(qs))], np.percentile(mine, [q * 100 for q in qs])
        )


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg))


def test_auc_matches_pairs_and_ignores_monotone_maps(spark):
    rng = np.random.default_rng(3)
    labels = (rng.random(400) < 0.3).astype(int)
    scores = np.round(rng.random(400) * 0.6 + labels * 0.2, 2)  # many ties
    df = spark.createDataFrame(
        [(float(s), int(y)) for s, y in zip(scores, labels)], "s DOUBLE, y INT"
    )
    want = brute_auc(scores, labels)
    assert exact_auc(df, "s", "y", buckets=16).first()["auc"] == pytest.approx(want, abs=1e-12)
    mapped = df.withColumn("s", F.exp(F.col("s") * 5))
    assert exact_auc(mapped, "s", "y").first()["auc"] == pytest.approx(want, abs=1e-12)


def test_auc_of_constant_scores(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0)], "s DOUBLE, y INT")
    assert exact_auc(df, "s", "y").first()["auc"] == 0.5


def test_keep_first_with_hot_key(spark):
    rows = [("hot", i, f"v{i}") for i in range(500)] + [("cold", 3, None), ("cold", 9, "z")]
    df = spark.createDataFrame(rows, "k STRING, o INT, v STRING").repartition(7)
    got = {r.k: (r.o, r.v) for r in keys.keep_first(df, "k", ["o"]).collect()}
    assert got == {"hot": (0, "v0"), "cold": (3, None)}


def test_keep_first_returns_a_row_that_exists(spark):
    rows = [(1, 1, "a", "z"), (1, 1, "b", "y")]
    df = spark.createDataFrame(rows, "k INT, o INT, v STRING, w STRING")
    assert [tuple(r) for r in keys.keep_first(df, "k", ["o"]).collect()] == [rows[0]]


def test_first_non_null(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, "b"), (1, 3, "a"), (2, 1, None)], "k INT, o INT, v STRING")
    got = dict(df.groupBy("k").agg(keys.first_non_null("v", ["o"]).alias("v")).collect())
    assert got == {1: "b", 2: None}


def test_ordered_number_is_dense_and_ordered(spark):
    rows = [(a, b) for a in ("x", None, "m") for b in range(20)]
    df = spark.createDataFrame(rows, "a STRING, b INT").repartition(5)
    got = keys.ordered_number(df, "id", ["a"], ["b"]).orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 61))
    assert [(r.a, r.b) for r in got] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))


def test_serial_id_on_clustered_keys(spark):
    """Keys bunched at one end, one far outlier: ids stay dense and ordered."""
    ids = [*range(1000), 10**15]
    df = spark.createDataFrame([(i,) for i in ids], "k BIGINT").repartition(6)
    got = keys.serial_id(df, "id", "k", buckets=16).orderBy("k").collect()
    assert [r.id for r in got] == list(range(1, 1002))


def test_stratified_number_is_a_permutation_per_class(spark):
    df = spark.range(500).withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    first = {r.id: (r.y, r.rn) for r in keys.stratified_number(df, "y", "id", 42).collect()}
    again = {r.id: (r.y, r.rn) for r in keys.stratified_number(df.repartition(3), "y", "id", 42).collect()}
    other = {r.id: (r.y, r.rn) for r in keys.stratified_number(df, "y", "id", 43).collect()}
    assert first == again and first != other
    for y, n in ((0, 400), (1, 100)):
        assert sorted(rn for c, rn in first.values() if c == y) == list(range(1, n + 1))


def test_part_counts_do_not_change_results(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    few, many = (
        sorted(keys.stratified_number(df, "y", "id", 42, digits=d).select("id", "rn").collect())
        for d in (1, 3)
    )
    assert few == many
    few, many = (
        sorted(keys.serial_id(df, "n", "id", buckets=b).select("id", "n").collect()) for b in (4, 512)
    )
    assert few == many
    assert keys.parts_for(df, rows_per_part=100) == 30


SPREADS = {
    "even": "CAST(id AS DOUBLE)",
    "squares": "CAST(id * id AS DOUBLE)",
    "tails": "CASE WHEN id = 7 THEN 1e300 WHEN id = 8 THEN -1e300 ELSE id / 1e6 END",
    "few": "CAST(id % 5 AS DOUBLE)",
    "powers": "pow(1.001D, CAST(id AS DOUBLE)) * IF(id % 2 = 0, 1, -1)",
    "one": "3.5D",
}


@pytest.mark.parametrize("kind", SPREADS)
@pytest.mark.parametrize("cells, fine", [(65_536, 1 << 20), (16, 64)])
def test_buckets_keep_the_order_and_share_the_rows(spark, kind, cells, fine):
    df = spark.range(8_000).selectExpr("id", f"{SPREADS[kind]} AS v")
    rows = keys.range_buckets(df, "v", "b", 40, cells, fine).collect()
    assert len(rows) == 8_000
    ranked = sorted(rows, key=lambda r: (r.v, r.b))
    assert all(a.b <= b.b for a, b in zip(ranked, ranked[1:]))
    by_value = {}
    for r in rows:
        by_value.setdefault(r.v, set()).add(r.b)
    assert all(len(found) == 1 for found in by_value.values())
    if cells > 16 and kind != "one":
        sizes = Counter(r.b for r in rows)
        most = max(Counter(r.v for r in rows).values())
        assert max(sizes.values()) <= max(2 * 8_000 / 40 + 1, most + 8_000 / 40)
    assert keys.range_buckets(df.limit(0), "v", "b", 40).collect() == []


@pytest.mark.parametrize("buckets", [1, 4, 999, 65_536])
def test_serial_ids_do_not_depend_on_the_buckets(spark, buckets):
    df = spark.range(3_000).selectExpr("(id * 7919) % 100003 AS k")
    got = {r.k: r.i for r in keys.serial_id(df, "i", "k", buckets).collect()}
    assert got == {k: n for n, k in enumerate(sorted(got), 1)}


def test_keep_first_folds_on_the_map_side_and_prunes(spark, tmp_path):
    spark.range(1000).selectExpr("id % 7 AS k", "id AS o", "id * 2 AS v", "repeat('x', 50) AS wide").write.parquet(str(tmp_path / "t"))
    first = keys.keep_first(spark.read.parquet(str(tmp_path / "t")), "k", ["o"])

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    whole = plan(first)
    assert whole.index("partial_min") > whole.index("Exchange hashpartitioning(k")  # the plan is printed from the end
    assert whole.count("partial_min(") == 2 and "min_by" not in whole
    for wanted, read in ((["k"], "struct<k:bigint>"), (["k", "o"], "struct<k:bigint,o:bigint>")):
        assert f"ReadSchema: {read}" in plan(first.select(*wanted))
    left = spark.range(20).withColumnRenamed("id", "k")
    assert "Join" not in plan(left.join(first, "k", "left").select("k"))
