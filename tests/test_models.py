import tracemalloc
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kpiloom.models import anomaly, attrition, evaluate, forecast
from kpiloom.operators.quantiles import exact_auc


# -- attrition --------------------------------------------------------------

@pytest.fixture(scope="module")
def staff(spark):
    """Overtime and low income raise the chance of leaving; some gaps."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        overtime = bool(rng.random() < 0.3)
        income = float(rng.uniform(1000, 20000))
        leave = rng.random() < (0.1 + 0.4 * overtime + 0.3 * (income < 4000))
        years = None if i % 50 == 0 else int(rng.integers(0, 20))
        rows.append(
            (i, int(rng.integers(18, 60)), "Male" if i % 2 else "Female", income,
             int(rng.integers(1, 5)), years, "Yes" if overtime else "No",
             int(rng.integers(1, 30)), int(rng.integers(1, 6)), int(rng.integers(1, 5)), 3,
             ["Sales", "R&D", "HR"][i % 3], f"role{i % 40}", "Yes" if leave else "No")
        )
    schema = (
        "source_key BIGINT, age INT, gender STRING, monthly_income DOUBLE, job_satisfaction INT, "
        "years_at_company INT, overtime STRING, distance_from_home INT, education INT, "
        "environment_satisfaction INT, performance_rating INT, department_name STRING, "
        "job_role STRING, attrition STRING"
    )
    return attrition.stratified_split(spark.createDataFrame(rows, schema), "source_key").cache()


def test_split_is_exact_and_stratified(staff):
    rows = staff.collect()
    assert len(rows) == 600
    for y in (0, 1):
        mine = [r for r in rows if r.target == y]
        assert sum(r.is_test for r in mine) == round(0.2 * len(mine))


def test_folds_are_even_per_class(staff):
    sizes = (
        staff.withColumn("fold", attrition.fold_of(F.col("rn")))
        .groupBy("target", "fold").count().collect()
    )
    for y in (0, 1):
        counts = [r["count"] for r in sizes if r.target == y]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_label_codes_are_alphabetical(staff):
    codes = {
        (r.old, r.department_name)
        for r in attrition.label_encode(
            staff.select("department_name", "gender", "overtime", "job_role",
                         F.col("department_name").alias("old"))
        ).collect()
    }
    assert codes == {("HR", 0), ("R&D", 1), ("Sales", 2)}


def test_training_finds_planted_signal(spark, staff, tmp_path):
    params = attrition.BoostingParams(trees=8)
    train, test = staff.where(~F.col("is_test")), staff.where("is_test")
    ratio = attrition.class_weight(train).first()["class_weight"]
    model = attrition.train(train, ratio, params)
    scored = attrition.score(model, test, ["source_key", "target"])
    assert exact_auc(scored, "probability", "target").first()["auc"] > 0.6
    top = [r.feature for r in attrition.feature_importance(spark, model).limit(4).collect()]
    assert "overtime" in top or "monthly_income" in top
    assert attrition.tree_summary(spark, model).count() == 8

    path = str(tmp_path / "model")
    attrition.save_model(spark, model, path)
    again = attrition.score(attrition.load_model(spark, path), test, ["source_key", "target"])
    assert sorted(again.collect()) == sorted(scored.collect())
    strangers = test.withColumn("job_role", F.lit("never seen"))
    assert attrition.score(model, strangers, ["source_key"]).count() == test.count()


def test_cross_validation(spark, staff):
    folds = attrition.cross_validated_auc(
        spark, staff, 3.0, attrition.BoostingParams(trees=3, depth=2), folds=3
    )
    rows = folds.collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2] and all(r.auc > 0.5 for r in rows)
    # the folds grown together give what each gives alone
    params, folded = attrition.BoostingParams(trees=3, depth=2), staff.withColumn("fold", attrition.fold_of(F.col("rn"), 3))
    for r in rows:
        alone = attrition.fit_models(folded, [F.col("fold") != r.fold], 3.0, params)[0]
        scored = attrition.score(alone, folded.where(F.col("fold") == r.fold), ["target"])
        assert exact_auc(scored, "probability", "target").first()["auc"] == pytest.approx(r.auc, abs=1e-12)
    summary = attrition.cv_summary(folds).first()
    assert summary.cv_roc_auc_std == pytest.approx(np.std([r.auc for r in rows]), abs=1e-4)


def test_report_by_hand(spark):
    pairs = [(0, 0)] * 6 + [(0, 1)] * 2 + [(1, 0)] * 1 + [(1, 1)] * 3
    df = spark.createDataFrame(pairs, "target INT, prediction INT")
    lines = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert lines["Leave"].precision == 0.6 and lines["Leave"].recall == 0.75
    assert lines["Stay"].support == 8 and lines["accuracy"].precision == 0.75
    assert float(evaluate.accuracy(df).first()["accuracy"]) == 0.75


def test_risk_rules(spark):
    df = spark.createDataFrame(
        [("Yes", 2999.0, 0.61), ("No", 2999.0, 0.41), ("Yes", 9000.0, 0.5), ("No", 1.0, 0.2)],
        "overtime STRING, monthly_income DOUBLE, probability DOUBLE",
    )
    rows = evaluate.risk_alerts(evaluate.risk_tiers(df)).collect()
    assert [r.risk_level for r in rows] == ["High", "Medium", "Medium", "Low"]
    assert [r.overtime_alert for r in rows] == [True, False, False, False]
    assert [r.income_alert for r in rows] == [True, True, False, False]
    assert rows[3].recommendation.startswith("Employee appears stable")


def test_scoring_codes(spark):
    df = spark.createDataFrame(
        [("Male", "Yes", "Sales", "Manager"), ("x", None, "Legal", "Pilot")],
        "gender STRING, overtime STRING, department_name STRING, job_role STRING",
    )
    rows = attrition.encode_for_scoring(df).collect()
    got = [(r.gender_code, r.overtime_code, r.department_code, r.role_code) for r in rows]
    assert got == [(1, 1, 2, 3), (0, 0, 1, 6)]


def test_requests_are_scored_by_the_fixed_codes(spark, staff):
    params = attrition.BoostingParams(trees=4, depth=3)
    model = attrition.train(staff, 2.0, params)
    row = staff.limit(1).drop("target", "is_test", "rn", "attrition")
    known = row.withColumns({"department_name": F.lit("Research & Development"), "job_role": F.lit("Research Scientist")})
    unknown = row.withColumns({"department_name": F.lit("Legal"), "job_role": F.lit("Pilot")})
    one, other = (attrition.score_requests(model, r, ["age"]).first() for r in (known, unknown))
    assert one.probability == other.probability and 0 < one.probability < 1
    numbers = attrition.request_numbers(known.withColumn("age", F.lit(None).cast("int"))).first()
    assert (numbers.department_name_num, numbers.job_role_num) == (1.0, 6.0)
    assert numbers.age_num is None


# -- anomalies --------------------------------------------------------------

@pytest.fixture(scope="module")
def orders(spark):
    rng = np.random.default_rng(11)
    n = 2000
    price = rng.normal(100, 15, n)
    price[:40] *= 10
    frame = pd.DataFrame(
        {
            "order_id": np.arange(n),
            "price": price,
            "freight_value": rng.normal(20, 3, n),
            "payment_installments": rng.integers(1, 6, n).astype("int32"),
            "review_score": [None if i % 97 == 0 else float(i % 5 + 1) for i in range(n)],
            "delivery_days": rng.integers(1, 25, n).astype("int32"),
            "dow_num": rng.integers(0, 7, n).astype("int32"),
            "month": rng.integers(1, 13, n).astype("int32"),
        }
    )
    schema = (
        "order_id BIGINT, price DOUBLE, freight_value DOUBLE, payment_installments INT, "
        "review_score DOUBLE, delivery_days INT, dow_num INT, month INT"
    )
    rows = [tuple(None if v != v else v for v in r) for r in frame.astype(object).values.tolist()]
    return anomaly.feature_frame(spark.createDataFrame(rows, schema)).cache()


def test_features_are_filled(orders):
    row = orders.where("order_id = 97").first()
    assert row.review_score == 3.0
    assert orders.where("freight_ratio IS NULL OR review_score IS NULL").count() == 0


def test_standardize(orders):
    z = anomaly.standardize(orders).select(anomaly.FEATURES).toPandas()
    np.testing.assert_allclose(z.mean(), 0, atol=1e-9)
    np.testing.assert_allclose(z.std(ddof=0), 1, atol=1e-9)


def test_forest_flags_planted_outliers(spark, orders):
    nodes = anomaly.fit_forest(orders, trees=60).cache()
    assert nodes.select("tree").distinct().count() == 60
    scored = anomaly.score_forest(spark, orders, nodes, anomaly.SUBSAMPLE).cache()
    flagged = anomaly.flag_anomalies(scored).cache()
    report = anomaly.anomaly_report(flagged).first()
    assert report.total_orders == 2000 and abs(report.anomaly_count - 100) <= 2
    assert report.avg_price_anomaly > report.avg_price_normal
    hits = flagged.where("is_anomaly AND order_id < 40").count()
    assert hits >= 36
    span = scored.agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert -1.0 <= span[0] and span[1] < 0.0
    worst = anomaly.lowest_scores(anomaly.anomaly_extract(flagged)).collect()
    assert len(worst) == 20
    assert [r.anomaly_score for r in worst] == sorted(r.anomaly_score for r in worst)


def test_forest_is_repeatable(spark, orders):
    a = anomaly.fit_forest(orders, trees=12).orderBy("tree", "node").collect()
    b = anomaly.fit_forest(orders.repartition(3), trees=12).orderBy("tree", "node").collect()
    assert a == b


@pytest.mark.parametrize("rows", [7, 300, 2000])
def test_tree_samples(orders, rows):
    table = orders.where(F.col("order_id") < rows)
    size = min(256, rows)
    samples = anomaly.tree_samples(table, rows, trees=20).groupBy("tree").agg(
        F.count("*").alias("n"), F.countDistinct("order_id").alias("d")
    ).collect()
    assert len(samples) == 20
    assert all(r.n == size and r.d == size for r in samples)


def test_tree_samples_of_a_large_table_stay_small(spark):
    names = [n for n in anomaly.FEATURES]
    table = spark.range(400_000).select(
        F.col("id").alias("order_id"), *[F.lit(1.0).alias(n) for n in names]
    )
    samples = anomaly.tree_samples(table, 400_000, trees=20).groupBy("tree").count().collect()
    assert len(samples) == 20 and {r["count"] for r in samples} == {256}


def test_the_sampling_threshold_does_not_choose_the_rows(spark, monkeypatch):
    table = spark.range(100_000).select(
        F.col("id").alias("order_id"), *[F.lit(1.0).alias(n) for n in anomaly.FEATURES]
    )

    def drawn():
        rows = anomaly.tree_samples(table, 100_000, trees=20).select("tree", "order_id").collect()
        return {tuple(r) for r in rows}

    want = drawn()
    monkeypatch.setattr(anomaly.math, "ceil", lambda x: 1 << 63 if x > 1e6 else int(-(-x // 1)))
    assert drawn() == want


def test_a_saved_forest_scores_alike(spark, orders, tmp_path):
    nodes = anomaly.fit_forest(orders, trees=10)
    size = min(anomaly.SUBSAMPLE, orders.count())
    anomaly.save_forest(nodes, size, str(tmp_path / "forest"))
    again, known = anomaly.read_forest(spark, str(tmp_path / "forest"))
    assert known == size
    first = anomaly.score_forest(spark, orders, nodes, size).collect()
    assert sorted(anomaly.score_forest(spark, orders, again, known).collect()) == sorted(first)


def test_a_short_subsample_is_an_error(spark, orders):
    samples = anomaly.tree_samples(orders, 300, trees=4)
    with pytest.raises(Exception, match="subsample"):
        anomaly.fit_trees(samples.where(F.col("order_id") % 2 == 0), size=256).collect()


# -- forecasts --------------------------------------------------------------

@pytest.fixture(scope="module")
def series(spark):
    """Noise-free trend times weekday pattern, two series of different length."""
    weekday = [1.2, 1.1, 1.0, 0.9, 0.8, 0.7, 1.3]
    rows = []
    for name, days, base in (("a", 420, 50.0), ("b", 210, 500.0)):
        for i in range(days):
            d = date(2020, 1, 6) + timedelta(days=i)
            rows.append((name, d, (base + 0.1 * i) * weekday[d.weekday()]))
    return spark.createDataFrame(rows, "series STRING, ds DATE, y DOUBLE").cache()


def truth(name, day):
    weekday = [1.2, 1.1, 1.0, 0.9, 0.8, 0.7, 1.3]
    base = 50.0 if name == "a" else 500.0
    return (base + 0.1 * (day - date(2020, 1, 6)).days) * weekday[day.weekday()]


@pytest.mark.parametrize("method", [forecast.seasonal_forecast, forecast.baseline_forecast])
def test_forecast_recovers_pattern(series, method):
    rows = method(series).collect()
    for name, days in (("a", 420), ("b", 210)):
        mine = sorted((r for r in rows if r.series == name), key=lambda r: r.ds)
        future = [r for r in mine if r.is_future]
        assert len(future) == 90 and len(mine) == days + 90
        assert [(b.ds - a.ds).days for a, b in zip(future, future[1:])] == [1] * 89
        assert (future[0].ds - mine[days - 1].ds).days == 1
        assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in mine)
        error = [abs(r.yhat - truth(name, r.ds)) / truth(name, r.ds) for r in mine]
        assert np.mean(error) < 0.03


def test_slopes_change_only_at_the_breaks():
    rng = np.random.default_rng(8)
    n, breaks = 700, (0.24, 0.56)
    t = np.arange(n) / (n - 1)
    level = 100 + 40 * t - 160 * np.maximum(t - breaks[0], 0) + 300 * np.maximum(t - breaks[1], 0)
    weekly = 1 + 0.1 * np.sin(2 * np.pi * np.arange(n) / 7)
    days = [date(2020, 1, 6) + timedelta(days=i) for i in range(n)]
    model = forecast.fit_one_series(pd.DataFrame({"series": "s", "ds": days, "y": level * weekly + rng.normal(0, 1.5, n)}))
    knots, changes = np.asarray(model["knots"][0]), np.asarray(model["trend"][0])[2:]
    at = knots[changes != 0]
    assert len(knots) == forecast.CHANGEPOINTS and 2 <= len(at) <= 8
    strong = knots[np.abs(changes) > 0.15 * np.abs(changes).max()]
    assert all(min(abs(k - b) for b in breaks) < 0.07 for k in strong)
    for b in breaks:
        assert min(abs(k - b) for k in strong) < 0.04
    straight = forecast.fit_one_series(pd.DataFrame({"series": "s", "ds": days, "y": (100 + 40 * t) * weekly + rng.normal(0, 1.5, n)}))
    assert np.count_nonzero(np.asarray(straight["trend"][0])[2:]) <= 1


def test_sparse_fit_meets_its_conditions():
    """Against a plain proximal gradient method on the same penalised problem."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 12))
    x[:, 0] = 1.0
    y = x @ np.r_[2.0, -1.0, 3.0, np.zeros(8), -2.0] + rng.normal(0, 0.3, 200)
    got = forecast.sparse_fit(x, y, free=2)
    base = np.linalg.lstsq(x[:, :2], np.column_stack([y, x[:, 2:]]), rcond=None)[0]
    r, z = y - x[:, :2] @ base[:, 0], x[:, 2:] - x[:, :2] @ base[:, 1:]
    noise = np.sqrt(((r - z @ np.linalg.lstsq(z, r, rcond=None)[0]) ** 2).sum() / (200 - 12))
    penalty = noise * np.sqrt((z**2).sum(axis=0)) * np.sqrt(2 * np.log(10))
    w, step = np.zeros(10), 1 / np.linalg.eigvalsh(z.T @ z).max()
    for _ in range(20_000):
        w = w + step * (z.T @ (r - z @ w))
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
    assert set(np.flatnonzero(got[2:])) == set(np.flatnonzero(np.abs(w) > 1e-9))
    active = np.r_[0, 1, 2 + np.flatnonzero(np.abs(w) > 1e-9)]
    assert np.allclose(got[active], np.linalg.lstsq(x[:, active], y, rcond=None)[0], atol=1e-6)
    assert np.count_nonzero(got) < 6 and abs(got[2] - 3) < 0.1 and abs(got[11] + 2) < 0.1


def test_the_band_widens_with_the_horizon():
    rng = np.random.default_rng(3)
    days = [date(2020, 1, 6) + timedelta(days=i) for i in range(400)]
    slope = np.repeat(rng.normal(0, 1, 8), 50)
    y = 200 + np.cumsum(slope) + rng.normal(0, 2, 400)
    model = forecast.fit_one_series(pd.DataFrame({"series": "s", "ds": days, "y": y}))
    ahead = [days[-1] + timedelta(days=i) for i in range(91)]
    out = forecast.predict_one_series(pd.DataFrame({"series": "s", "ds": ahead, "is_future": True}), model)
    width = (out["yhat_upper"] - out["yhat_lower"]).to_numpy()
    assert width[0] > 0 and np.all(np.diff(width) > 0)
    # without residuals the band is that of simulated future slope changes
    model = model.assign(bend=0.3, low=0.0, high=0.0)
    out = forecast.predict_one_series(pd.DataFrame({"series": "s", "ds": ahead, "is_future": True}), model)
    factor = (out["yhat"] / (trend_of(model, ahead) * model["scale"][0])).to_numpy()
    spread = ((out["yhat_upper"] - out["yhat"]) / forecast.NORMAL_80 / model["scale"][0]).to_numpy() / np.abs(factor)
    far = 90 / 399
    drifts = []
    for _ in range(20_000):
        at = rng.uniform(0, far, rng.poisson(len(model["knots"][0]) * far))
        drifts.append(np.sum(rng.laplace(0, 0.3, len(at)) * (far - at)))
    assert spread[0] == 0 and abs(np.std(drifts) / spread[90] - 1) < 0.05


def trend_of(model, days):
    t = np.array([(d - date(2020, 1, 6)).days for d in days]) / 399
    knots, weights = np.asarray(model["knots"][0]), np.asarray(model["trend"][0])
    return weights[0] + weights[1] * t + np.maximum(t[:, None] - knots, 0) @ weights[2:]


def test_saved_forecasts_predict_alike(spark, series, tmp_path):
    forecast.fit_forecast(series).write.parquet(str(tmp_path / "models"))
    models = spark.read.parquet(str(tmp_path / "models"))
    again = forecast.apply_forecast(models, forecast.forecast_days(series, models))
    want = {(r.series, r.ds, r.is_future): r.yhat for r in forecast.seasonal_forecast(series).collect()}
    got = {(r.series, r.ds, r.is_future): r.yhat for r in again.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * abs(want[k]) for k in want)
    one = pd.DataFrame({"series": ["s"], "ds": [date(2020, 1, 1)], "y": [3.0]})
    assert len(forecast.fit_one_series(one)) == 1


def test_clipping_and_metrics(spark):
    rows = [("s", date(2020, 1, i + 1), y, y - 1, y + 1, i > 0) for i, y in enumerate([9.0, -3.0, 2.25, 4.75])]
    df = spark.createDataFrame(
        rows, "series STRING, ds DATE, yhat DOUBLE, yhat_lower DOUBLE, yhat_upper DOUBLE, is_future BOOLEAN"
    )
    clipped = forecast.clipped_future(df)
    assert sorted(r.yhat for r in clipped.collect()) == [0.0, 2.2, 4.8]
    row = forecast.forecast_metrics(clipped).first()
    assert (row.forecast_horizon_days, row.peak_predicted) == (3, 4.8)
    kpis = forecast.forecast_kpis(df, days=2).first()
    assert kpis.peak_day == date(2020, 1, 4) and kpis.avg_daily == 3.5


def test_peak_day_tie_goes_to_the_earliest(spark):
    df = spark.createDataFrame(
        [(date(2020, 1, 3), 5.0), (date(2020, 1, 2), 5.0), (date(2020, 1, 1), 1.0)], "ds DATE, yhat DOUBLE"
    )
    assert forecast.peak_day(df).first()["peak_day"] == date(2020, 1, 2)


def test_forest_scores_equal_a_walk_by_row_in_little_memory():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2048, len(anomaly.FEATURES)))
    grown = [anomaly._grow_tree(x[rng.choice(len(x), 64, replace=False)], rng) for _ in range(anomaly.TREES)]
    table = pd.DataFrame(
        [(t, *node) for t, nodes in enumerate(grown) for node in nodes],
        columns=["tree", "node", "feature", "threshold", "left", "right", "path"],
    )

    class Nodes:
        def toPandas(self):
            return table

    forest = anomaly.load_forest(Nodes(), 64)
    tracemalloc.start()
    got = forest.scores(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the depths of 2,048 rows in 200 trees and little else
    assert peak < 8e6

    def depth(nodes, row):
        by, at = {n[0]: n for n in nodes}, 0
        while by[at][3] != at:
            at = by[at][3] if row[by[at][1]] <= by[at][2] else by[at][4]
        return by[at][5]

    for i in (0, 7, 2047):
        want = -(2 ** (-np.mean([depth(nodes, x[i]) for nodes in grown]) / anomaly.average_path(64)))
        assert got[i] == pytest.approx(want, abs=1e-12)


def test_forest_scores_equal_a_plain_walk_bit_for_bit():
    """Values on a threshold, without bound and not a number too."""
    rng = np.random.default_rng(17)
    x = np.round(rng.normal(size=(3000, len(anomaly.FEATURES))), 1)
    grown = [anomaly._grow_tree(x[rng.choice(len(x), 100, replace=False)], rng) for _ in range(50)]
    table = pd.DataFrame(
        [(t, *node) for t, nodes in enumerate(grown) for node in nodes],
        columns=["tree", "node", "feature", "threshold", "left", "right", "path"],
    )

    class Nodes:
        def toPandas(self):
            return table

    forest = anomaly.load_forest(Nodes(), 100)
    x[::5, 3] = rng.choice(table["threshold"][np.isfinite(table["threshold"])], len(x[::5]))
    x[::7, 1], x[::11, 2], x[::13, 0] = np.inf, -np.inf, np.nan
    x[::17] = np.nan
    each = np.arange(len(x))
    depth = np.empty((len(x), len(grown)))
    for t in range(len(grown)):
        at = np.zeros(len(x), dtype=int)
        for _ in range(forest.height):
            low = x[each, forest.feature[t][at]] <= forest.threshold[t][at]
            at = np.where(low, forest.left[t][at], forest.right[t][at])
        depth[:, t] = forest.path[t][at]
    want = -np.exp2(-depth.mean(axis=1) / anomaly.average_path(100))
    assert np.array_equal(forest.scores(x), want)
    assert np.array_equal(forest.scores(x[:1]), want[:1]) and len(forest.scores(x[:0])) == 0


def test_a_tree_of_one_leaf_scores(spark):
    nodes = spark.createDataFrame([(0, 0, 0, float("inf"), 0, 0, 1.0)], anomaly._NODE_SCHEMA)
    x = np.array([[1.0] * len(anomaly.FEATURES), [np.nan] * len(anomaly.FEATURES)])
    assert anomaly.load_forest(nodes, 2).scores(x).tolist() == [-0.5, -0.5]


def test_features_read_a_known_median_instead_of_the_rows(spark):
    base = spark.createDataFrame(
        [(1, 10.0, None, 1, 4.0, 3, 0, 1), (2, 20.0, 1.0, None, None, 4, 1, 2)],
        "order_id BIGINT, price DOUBLE, freight_value DOUBLE, payment_installments INT, "
        "review_score DOUBLE, delivery_days INT, dow_num INT, month INT",
    )
    want = anomaly.feature_frame(base).orderBy("order_id").collect()
    median = spark.createDataFrame([(4.0,)], "median DOUBLE")
    known = anomaly.feature_frame(base, median)
    assert known.orderBy("order_id").collect() == want
    assert "percentile" not in known._jdf.queryExecution().toString()
