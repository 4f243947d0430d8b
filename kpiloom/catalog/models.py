"""Model pipelines, metrics and forecasts as named queries, on whole tables and full fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiloom.catalog.registry import Workspace, query
from kpiloom.catalog.relational import baseline, series_frame
from kpiloom.models import anomaly, attrition, evaluate, forecast
from kpiloom.operators.quantiles import counted_percentile
from kpiloom.plans import kpi
from kpiloom.session import fresh_path
from kpiloom.sources import extracts

BOOSTING = attrition.BoostingParams()
_FEATURE_COLUMNS = (
    "source_key, age, gender, CAST(monthly_income AS DOUBLE) AS monthly_income, job_satisfaction, "
    "years_at_company, overtime, distance_from_home, education, environment_satisfaction, "
    "performance_rating, department_name, job_role, attrition"
)


# -- shared stages ----------------------------------------------------------

def attrition_rows(ws: Workspace):
    """Training rows written once; every fit and score reads this table."""
    return extracts.extract(
        ws.spark, ws.sf_dir, "attrition-rows", lambda: attrition.training_rows(ws.star)
    )


def train_ratio(ws: Workspace) -> float:
    train = attrition_rows(ws).where(~F.col("is_test"))
    return attrition.class_weight(train).first()["class_weight"]


def attrition_models(ws: Workspace):
    """The model of the train split and those of the five folds, all grown in one pass."""
    def fit():
        learns = [~F.col("is_test"), *attrition.outside_fold()]
        return attrition.fit_models(attrition_rows(ws), learns, train_ratio(ws), BOOSTING)

    return extracts.fitted(ws.spark, ("attrition", ws.sf_dir, BOOSTING), fit)


def attrition_model(ws: Workspace):
    return attrition_models(ws)[0]


def score_table(ws: Workspace):
    """Fixed, formula-made scores per employee, so metrics can be checked exactly."""
    staff = kpi.labelled_staff(ws.star)
    target = attrition.binary_target(F.col("attrition"))
    points = (F.col("source_key") * 37 % 1000).cast("double") + target * 300
    scored = staff.select(
        "source_key",
        "overtime",
        "monthly_income",
        target.alias("target"),
        (points / F.lit(1300.0)).alias("probability"),
    )
    return scored.withColumn("prediction", F.when(F.col("probability") > 0.5, 1).otherwise(0))


def anomaly_base(ws: Workspace):
    return extracts.extract(
        ws.spark, ws.sf_dir, "anomaly-base", lambda: anomaly.base_rows(ws.star)
    )


def anomaly_median(ws: Workspace):
    return extracts.extract(
        ws.spark, ws.sf_dir, "anomaly-median", lambda: anomaly.median_review(anomaly_base(ws))
    )


def anomaly_rows(ws: Workspace):
    return anomaly.feature_frame(anomaly_base(ws), anomaly_median(ws))


def forest_nodes(ws: Workspace):
    return extracts.extract(
        ws.spark, ws.sf_dir, "forest-nodes", lambda: anomaly.fit_forest(anomaly_rows(ws))
    )


def forest_size(ws: Workspace) -> int:
    """Rows per tree, as fitting chose them."""
    return min(anomaly.SUBSAMPLE, anomaly_rows(ws).count())


def flagged_orders(ws: Workspace):
    def build():
        return anomaly.score_forest(ws.spark, anomaly_rows(ws), forest_nodes(ws), forest_size(ws))

    return anomaly.flag_anomalies(extracts.extract(ws.spark, ws.sf_dir, "anomaly-scores", build))


def formula_orders(ws: Workspace):
    """Fixed, formula-made anomaly scores, so the report can be checked exactly."""
    score = -(F.col("order_id").cast("bigint") * 37 % 1000).cast("double") / F.lit(1300.0)
    return anomaly.flag_anomalies(anomaly_base(ws).withColumn("anomaly_score", score))


def attrition_metrics(ws: Workspace):
    """Metrics of the fitted model: held-out accuracy and AUC, cross-validation, importance."""
    model, rows = attrition_model(ws), attrition_rows(ws)
    held_out = attrition.score(model, rows.where("is_test"), ["target"])
    return attrition.metrics_row(
        evaluate.accuracy(held_out),
        evaluate.roc_auc(held_out),
        attrition.cv_summary(cv_folds(ws)),
        attrition.feature_importance(ws.spark, model),
    )


def cv_folds(ws: Workspace):
    def build():
        return attrition.fold_auc(ws.spark, attrition_rows(ws), attrition_models(ws)[1:])

    return extracts.fitted(ws.spark, ("attrition folds", ws.sf_dir, BOOSTING), build)


# -- attrition --------------------------------------------------------------

@query(
    "attrition_features",
    f"SELECT {_FEATURE_COLUMNS} FROM staff JOIN dim_department USING (department_id)",
)
def _(ws: Workspace):
    return attrition.feature_frame(ws.star, keep=("source_key",))


@query(
    "label_encode",
    """SELECT source_key,
              CAST(dense_rank() OVER (ORDER BY gender) - 1 AS INTEGER) AS gender,
              CAST(dense_rank() OVER (ORDER BY overtime) - 1 AS INTEGER) AS overtime,
              CAST(dense_rank() OVER (ORDER BY department_name) - 1 AS INTEGER) AS department_name,
              CAST(dense_rank() OVER (ORDER BY job_role) - 1 AS INTEGER) AS job_role
       FROM staff JOIN dim_department USING (department_id)""",
)
def _(ws: Workspace):
    rows = attrition.feature_frame(ws.star, keep=("source_key",))
    return attrition.label_encode(rows.select("source_key", *attrition.CATEGORICAL))


@query(
    "binary_target",
    "SELECT source_key, CASE WHEN attrition = 'Yes' THEN 1 ELSE 0 END AS target FROM staff",
)
def _(ws: Workspace):
    return kpi.labelled_staff(ws.star).select(
        "source_key", attrition.binary_target(F.col("attrition")).alias("target")
    )


@query("stratified_split", "SELECT source_key, target, is_test FROM split_staff")
def _(ws: Workspace):
    rows = kpi.labelled_staff(ws.star).select("source_key", "attrition")
    return attrition.stratified_split(rows, "source_key").select("source_key", "target", "is_test")


@query(
    "class_weight",
    """SELECT count(*) FILTER (WHERE target = 0) AS negatives,
              count(*) FILTER (WHERE target = 1) AS positives,
              CAST(count(*) FILTER (WHERE target = 0) AS DOUBLE)
                  / count(*) FILTER (WHERE target = 1) AS class_weight
       FROM split_staff WHERE NOT is_test""",
)
def _(ws: Workspace):
    rows = kpi.labelled_staff(ws.star).select("source_key", "attrition")
    split = attrition.stratified_split(rows, "source_key")
    return attrition.class_weight(split.where(~F.col("is_test")))


@query("train_attrition")
def _(ws: Workspace):
    """Fit on the train split; one summary row per boosted tree."""
    return attrition.tree_summary(ws.spark, attrition_model(ws))


@query(
    "train_attrition_shape",
    """SELECT CAST(300 AS BIGINT) AS trees, true AS numbered, true AS depth_in_bounds,
              true AS nodes_in_bounds, true AS weights_in_bounds""",
)
def _(ws: Workspace):
    """What every fit must meet: 300 trees of at most four levels, steps of Newton's size."""
    trees = attrition.tree_summary(ws.spark, attrition_model(ws))
    return trees.agg(
        F.count(F.lit(1)).alias("trees"),
        ((F.min("tree") == 0) & (F.max("tree") == F.count(F.lit(1)) - 1)).alias("numbered"),
        F.bool_and(F.col("depth").between(0, BOOSTING.depth)).alias("depth_in_bounds"),
        F.bool_and((F.col("nodes") % 2 == 1) & (F.col("nodes") <= (2 << BOOSTING.depth) - 1)).alias("nodes_in_bounds"),
        F.bool_and(F.col("weight").between(0, 20 * BOOSTING.step)).alias("weights_in_bounds"),
    )


def _chances(scored, *keep):
    """The scored rows, and whether probability and prediction are in range and agree."""
    p = F.col("probability")
    return scored.select(*keep, ((p > 0) & (p < 1) & ((p > 0.5).cast("int") == F.col("prediction"))).alias("in_range"))


@query("predict_proba_rows", "SELECT source_key, target, true AS in_range FROM split_staff WHERE is_test")
def _(ws: Workspace):
    held_out = attrition_rows(ws).where("is_test")
    return _chances(attrition.score(attrition_model(ws), held_out, ["source_key", "target"]), "source_key", "target")


@query("vector_score_rows", "SELECT source_key, true AS in_range FROM staff")
def _(ws: Workspace):
    return _chances(attrition.score(attrition_model(ws), attrition_rows(ws), ["source_key"]), "source_key")


@query(
    "feature_importance_shares",
    "SELECT feature, true AS in_range, true AS sums_to_one FROM (VALUES "
    + ", ".join(f"('{f}')" for f in attrition.FEATURES)
    + ") AS f(feature)",
)
def _(ws: Workspace):
    shares = attrition.feature_importance(ws.spark, attrition_model(ws))
    whole = shares.agg(F.sum("importance")).scalar()
    return shares.select(
        "feature", F.col("importance").between(0, 1).alias("in_range"), (F.abs(whole - 1) < 1e-9).alias("sums_to_one")
    )


@query("eval_cv_auc_bounds", "SELECT CAST(5 AS BIGINT) AS folds, true AS in_range, true AS better_than_chance")
def _(ws: Workspace):
    row = cv_folds(ws)
    return row.agg(
        F.count(F.lit(1)).alias("folds"),
        F.bool_and(F.col("auc").between(0, 1)).alias("in_range"),
        (F.avg("auc") > 0.5).alias("better_than_chance"),
    )


@query("predict_proba")
def _(ws: Workspace):
    held_out = attrition_rows(ws).where("is_test")
    return attrition.score(attrition_model(ws), held_out, ["source_key", "target"])


@query("vector_score")
def _(ws: Workspace):
    """The fitted model over every employee."""
    return attrition.score(attrition_model(ws), attrition_rows(ws), ["source_key"])


@query(
    "eval_accuracy",
    """SELECT CAST((20000 * count(*) FILTER (target = prediction) + count(*)) // (2 * count(*)) AS DOUBLE)
              / 10000 AS accuracy FROM score_table""",
)
def _(ws: Workspace):
    return evaluate.accuracy(score_table(ws))


@query(
    "eval_auc",
    """SELECT CAST(round(CAST(
                  (sum(r) FILTER (WHERE target = 1) - p * (p + 1) / 2.0) / (p * n)
              AS DECIMAL(18,6)), 4) AS DOUBLE) AS roc_auc
       FROM (SELECT target, rank() OVER (ORDER BY probability)
                    + (count(*) OVER (PARTITION BY probability) - 1) / 2.0 AS r,
                    CAST(count(*) FILTER (WHERE target = 1) OVER () AS DOUBLE) AS p,
                    CAST(count(*) FILTER (WHERE target = 0) OVER () AS DOUBLE) AS n
             FROM score_table) GROUP BY p, n""",
)
def _(ws: Workspace):
    return evaluate.roc_auc(score_table(ws))


@query("eval_cv_auc")
def _(ws: Workspace):
    return attrition.cv_summary(cv_folds(ws))


@query(
    "eval_report",
    """SELECT class, round(CAST(precision AS DECIMAL(18,6)), 4)::DOUBLE AS precision,
              round(CAST(recall AS DECIMAL(18,6)), 4)::DOUBLE AS recall,
              round(CAST(f1 AS DECIMAL(18,6)), 4)::DOUBLE AS f1, CAST(support AS BIGINT) AS support
       FROM (
         WITH c AS (
           SELECT count(*) FILTER (WHERE target = 0 AND prediction = 0)::DOUBLE AS tn,
                  count(*) FILTER (WHERE target = 0 AND prediction = 1)::DOUBLE AS fp,
                  count(*) FILTER (WHERE target = 1 AND prediction = 0)::DOUBLE AS fn,
                  count(*) FILTER (WHERE target = 1 AND prediction = 1)::DOUBLE AS tp,
                  count(*)::DOUBLE AS total FROM score_table),
         m AS (
           SELECT *, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2*tn / (2*tn + fp + fn) AS f0,
                  tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2*tp / (2*tp + fp + fn) AS f1 FROM c)
         SELECT 'Stay' AS class, p0 AS precision, r0 AS recall, f0 AS f1, tn + fp AS support FROM m
         UNION ALL SELECT 'Leave', p1, r1, f1, fn + tp FROM m
         UNION ALL SELECT 'accuracy', (tn + tp) / total, (tn + tp) / total, (tn + tp) / total, total
                   FROM m
         UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, total FROM m
         UNION ALL SELECT 'weighted avg', (p0*(tn+fp) + p1*(fn+tp)) / total,
                          (r0*(tn+fp) + r1*(fn+tp)) / total, (f0*(tn+fp) + f1*(fn+tp)) / total,
                          total FROM m)""",
)
def _(ws: Workspace):
    return evaluate.classification_report(score_table(ws))


@query("feature_importance")
def _(ws: Workspace):
    return attrition.feature_importance(ws.spark, attrition_model(ws))


@query(
    "score_risk_tier",
    """SELECT source_key, round_even(probability, 4) AS attrition_probability,
              CASE WHEN probability > 0.6 THEN 'High' WHEN probability > 0.35 THEN 'Medium'
                   ELSE 'Low' END AS risk_level,
              CASE WHEN probability > 0.6 THEN
                     'Immediate intervention recommended — review workload and compensation.'
                   WHEN probability > 0.35 THEN 'Monitor closely and improve engagement.'
                   ELSE 'Employee appears stable. Maintain current engagement.'
              END AS recommendation
       FROM score_table""",
)
def _(ws: Workspace):
    return evaluate.risk_tiers(score_table(ws)).select(
        "source_key", "attrition_probability", "risk_level", "recommendation"
    )


@query(
    "risk_alerts",
    """SELECT source_key, overtime = 'Yes' AND probability > 0.5 AS overtime_alert,
              monthly_income < 3000 AND probability > 0.4 AS income_alert FROM score_table""",
)
def _(ws: Workspace):
    return evaluate.risk_alerts(score_table(ws)).select(
        "source_key", "overtime_alert", "income_alert"
    )


_CODES = """CASE WHEN gender = 'Male' THEN 1 ELSE 0 END AS gender_code,
              CASE WHEN overtime = 'Yes' THEN 1 ELSE 0 END AS overtime_code,
              CASE department_name WHEN 'Human Resources' THEN 0
                  WHEN 'Research & Development' THEN 1 WHEN 'Sales' THEN 2 ELSE 1
              END AS department_code,
              CASE job_role WHEN 'Healthcare Representative' THEN 0 WHEN 'Human Resources' THEN 1
                  WHEN 'Laboratory Technician' THEN 2 WHEN 'Manager' THEN 3
                  WHEN 'Manufacturing Director' THEN 4 WHEN 'Research Director' THEN 5
                  WHEN 'Research Scientist' THEN 6 WHEN 'Sales Executive' THEN 7
                  WHEN 'Sales Representative' THEN 8 ELSE 6 END AS role_code"""


def request_rows(ws: Workspace):
    """Every employee as a scoring request: the key and the twelve raw fields."""
    return attrition.feature_frame(ws.star, keep=("source_key",)).drop("attrition")


@query(
    "request_codes",
    f"SELECT source_key, {_CODES} FROM staff JOIN dim_department USING (department_id)",
)
def _(ws: Workspace):
    codes = ("gender_code", "overtime_code", "department_code", "role_code")
    return attrition.encode_for_scoring(request_rows(ws)).select("source_key", *codes)


@query("score_requests")
def _(ws: Workspace):
    """Twelve raw fields to probability, tier, recommendation and alerts, for every employee."""
    scored = attrition.score_requests(
        attrition_model(ws), request_rows(ws), ["source_key", "overtime", "monthly_income"]
    )
    return evaluate.risk_alerts(evaluate.risk_tiers(scored)).drop("prediction")


# -- anomalies --------------------------------------------------------------

@query(
    "anomaly_features",
    "SELECT * REPLACE (CAST(dow_num AS INTEGER) AS dow_num) FROM anomaly_features",
)
def _(ws: Workspace):
    return anomaly_rows(ws)


@query(
    "standardize",
    "SELECT order_id, "
    + ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM anomaly_features)) "
        f"/ (SELECT stddev_pop({c}) FROM anomaly_features), 5) AS {c}"
        for c in anomaly.FEATURES
    )
    + " FROM anomaly_features",
)
def _(ws: Workspace):
    scaled = anomaly.standardize(anomaly_rows(ws))
    return scaled.select("order_id", *[F.round(c, 5).alias(c) for c in anomaly.FEATURES])


@query("isolation_forest_fit")
def _(ws: Workspace):
    """The forest as a table: one row per node of each of the 200 trees."""
    return forest_nodes(ws)


@query(
    "isolation_forest_shape",
    """SELECT CAST(200 AS BIGINT) AS trees, true AS roots, true AS nodes_in_bounds""",
)
def _(ws: Workspace):
    """What every forest must meet: 200 trees, each with a root and at most 511 nodes."""
    each = forest_nodes(ws).groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("root"))
    return each.agg(
        F.count(F.lit(1)).alias("trees"),
        (F.count_distinct("root") == 1).alias("roots"),
        F.bool_and((F.col("n") <= 2 * anomaly.SUBSAMPLE - 1) & (F.col("n") % 2 == 1)).alias("nodes_in_bounds"),
    )


@query(
    "isolation_forest_score_rows",
    "SELECT order_id, true AS in_range, true AS flag_agrees FROM anomaly_base",
)
def _(ws: Workspace):
    """Every order has a score from -1 to 0 and is flagged exactly below the 5 % percentile."""
    scored = flagged_orders(ws)
    cut = counted_percentile(scored, "anomaly_score", 0.05).scalar()
    s = F.col("anomaly_score")
    return scored.select(
        "order_id", s.between(-1, 0).alias("in_range"), ((s < cut) == F.col("is_anomaly")).alias("flag_agrees")
    )


@query("isolation_forest_score")
def _(ws: Workspace):
    return flagged_orders(ws)


@query("anomaly_report")
def _(ws: Workspace):
    return anomaly.anomaly_report(flagged_orders(ws))


@query(
    "anomaly_report_fixed",
    """SELECT count(*) AS total_orders, count(*) FILTER (is_anomaly) AS anomaly_count,
              CAST((20000 * count(*) FILTER (is_anomaly) + count(*)) // (2 * count(*)) AS DOUBLE)
                  / 100 AS anomaly_pct,
              round(avg(price) FILTER (NOT is_anomaly), 2) AS avg_price_normal,
              round(avg(price) FILTER (is_anomaly), 2) AS avg_price_anomaly,
              round(avg(delivery_days) FILTER (NOT is_anomaly), 1) AS avg_delivery_normal,
              round(avg(delivery_days) FILTER (is_anomaly), 1) AS avg_delivery_anomaly
       FROM (SELECT *, s < quantile_cont(s, 0.05) OVER () AS is_anomaly
             FROM (SELECT *, -CAST(order_id * 37 % 1000 AS DOUBLE) / 1300.0 AS s
                   FROM anomaly_base))""",
)
def _(ws: Workspace):
    """The report over formula scores."""
    return anomaly.anomaly_report(formula_orders(ws))


@query("forest_store")
def _(ws: Workspace):
    """Save the forest with its feature list and sample size, read it back, score every order."""
    path = fresh_path(ws.spark, "forest")
    anomaly.save_forest(forest_nodes(ws), forest_size(ws), path)
    nodes, size = anomaly.read_forest(ws.spark, path)
    return anomaly.score_forest(ws.spark, anomaly_rows(ws), nodes, size)


@query("anomaly_kpis")
def _(ws: Workspace):
    return anomaly.anomaly_kpis(anomaly.anomaly_extract(flagged_orders(ws)))


@query("lowest_scores")
def _(ws: Workspace):
    """The twenty most anomalous orders."""
    return anomaly.lowest_scores(anomaly.anomaly_extract(flagged_orders(ws)))


# -- forecasts --------------------------------------------------------------

@query("demand_forecast")
def _(ws: Workspace):
    """Seasonal trend model for daily orders and revenue, history plus 90 days."""
    return forecast.seasonal_forecast(series_frame(ws))


@query("demand_forecast_clipped")
def _(ws: Workspace):
    return forecast.clipped_future(forecast.seasonal_forecast(series_frame(ws)))


@query(
    "forecast_store",
    "SELECT series, ds, is_future, true AS in_order, true AS as_fitted FROM baseline",
)
def _(ws: Workspace):
    """Save the forecast models, read them back and forecast every day with them: whether the
    bounds enclose the forecast and whether it is that of the models before they were saved."""
    series = series_frame(ws)
    models = extracts.written(ws.spark, "forecast-models", forecast.fit_forecast(series))
    again = forecast.apply_forecast(models, forecast.forecast_days(series, models))
    fitted = forecast.seasonal_forecast(series).select("series", "ds", F.col("yhat").alias("_fitted"))
    return again.join(fitted, ["series", "ds"], "left").select(
        "series",
        "ds",
        "is_future",
        ((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("in_order"),
        F.coalesce(F.abs(F.col("yhat") - F.col("_fitted")) <= 1e-6 * F.abs("_fitted"), F.lit(False)).alias("as_fitted"),
    )


@query("grouped_fit")
def _(ws: Workspace):
    """One model per state series, fitted in parallel."""
    return forecast.seasonal_forecast(forecast.series_by_state(ws.star))


def _days_in_order(rows):
    """The days of a forecast, and whether its bounds enclose it and all three are numbers."""
    lower, value, upper = F.col("yhat_lower"), F.col("yhat"), F.col("yhat_upper")
    ordered = (lower <= value) & (value <= upper) & ~F.isnan(value)
    return rows.select("series", "ds", "is_future", F.coalesce(ordered, F.lit(False)).alias("in_order"))


@query("demand_forecast_days", "SELECT series, ds, is_future, true AS in_order FROM baseline")
def _(ws: Workspace):
    return _days_in_order(forecast.seasonal_forecast(series_frame(ws)))


@query(
    "grouped_fit_days",
    """SELECT * FROM (WITH s AS (
         SELECT g.state AS series, d.full_date AS ds, count(*) AS y
         FROM fact_orders f JOIN dim_date d USING (date_id) JOIN dim_geography g USING (geo_id)
         WHERE f.order_status = 'delivered' GROUP BY ALL
       ), r AS (SELECT series, max(ds) AS last_day FROM s GROUP BY series)
       SELECT series, CAST(ds AS DATE) AS ds, false AS is_future, true AS in_order FROM s
       UNION ALL
       SELECT series, CAST(last_day + CAST(i AS INTEGER) AS DATE), true, true FROM r, range(1, 91) AS x(i))""",
)
def _(ws: Workspace):
    """One model per state: every day with orders and the 90 after the last of each."""
    return _days_in_order(forecast.seasonal_forecast(forecast.series_by_state(ws.star)))


_ROUNDED = ", ".join(f"round({c}, 3) AS {c}" for c in ("yhat", "yhat_lower", "yhat_upper"))


@query("forecast_baseline", f"SELECT series, ds, {_ROUNDED}, is_future FROM baseline")
def _(ws: Workspace):
    return baseline(ws).select(
        "series",
        "ds",
        *[F.round(c, 3).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")],
        "is_future",
    )


@query(
    "forecast_metrics",
    """SELECT series, count(*) AS forecast_horizon_days, round(avg(y), 1) AS avg_predicted,
              round(max(y), 1) AS peak_predicted
       FROM (SELECT series, round_even(greatest(yhat, 0), 1) AS y FROM baseline WHERE is_future)
       GROUP BY series""",
)
def _(ws: Workspace):
    return forecast.forecast_metrics(forecast.clipped_future(baseline(ws)))


@query(
    "forecast_kpis",
    """SELECT round(avg(yhat), 3) AS avg_daily, first(ds ORDER BY yhat DESC, ds) AS peak_day,
              round(max(yhat), 3) AS peak_value
       FROM baseline WHERE series = 'orders'
         AND ds > (SELECT max(ds) FROM baseline WHERE series = 'orders') - 90""",
)
def _(ws: Workspace):
    orders = baseline(ws).where(F.col("series") == "orders")
    return forecast.forecast_kpis(orders).select(
        F.round("avg_daily", 3).alias("avg_daily"),
        "peak_day",
        F.round("peak_value", 3).alias("peak_value"),
    )
