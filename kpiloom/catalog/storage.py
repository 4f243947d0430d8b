"""Scans, sinks and copies as named queries: each writes and reads whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiloom import schemas
from kpiloom.catalog.registry import Workspace, query
from kpiloom.catalog.relational import baseline
from kpiloom.catalog.tables import _COUNTS
from kpiloom.models import anomaly, attrition, forecast
from kpiloom.plans import kpi
from kpiloom.plans.star import conform
from kpiloom.session import fresh_path
from kpiloom.sources import extracts, readers, sinks, versions

FORECAST_CSV = schemas.struct(
    "series STRING, ds DATE, yhat DOUBLE, yhat_lower DOUBLE, yhat_upper DOUBLE"
)

ANOMALY_CSV = schemas.struct(
    "order_id STRING, price DOUBLE, freight_value DOUBLE, delivery_days INT, "
    "review_score DOUBLE, anomaly_score DOUBLE"
)


@query(
    "scan_csv",
    """SELECT CAST(customer_id AS VARCHAR) AS customer_id, customer_city, customer_state
       FROM raw_customers""",
)
def _(ws: Workspace):
    path = fresh_path(ws.spark, "customers-csv")
    sinks.write_csv(ws.raw["customers"], path)
    return readers.scan_csv(ws.spark, path, schemas.RAW["customers"])


@query(
    "scan_csv_dates",
    """SELECT CAST(order_id AS VARCHAR) AS order_id, order_purchase_timestamp,
              order_delivered_customer_date FROM raw_orders""",
)
def _(ws: Workspace):
    """CSV with timestamps, more columns in the file than are wanted."""
    path = fresh_path(ws.spark, "orders-csv")
    sinks.write_csv(ws.raw["orders"], path)
    names = ("order_id", "order_purchase_timestamp", "order_delivered_customer_date")
    wanted = T.StructType([schemas.RAW["orders"][n] for n in names])
    return readers.scan_wide_csv(ws.spark, path, wanted)


@query("scan_csv_quoted", "SELECT page_id, url, html FROM pages")
def _(ws: Workspace):
    """CSV whose quoted fields hold line breaks and quotes, read in byte ranges."""
    path = fresh_path(ws.spark, "pages-csv")
    sinks.write_csv(ws.table("pages").select("page_id", "url", "html"), path, keep_blanks=True)
    schema = schemas.struct("page_id BIGINT, url STRING, html STRING")
    return readers.scan_wide_csv(ws.spark, path, schema, quoted_breaks=True)


_TABLE_SQL = """
    SELECT l_returnflag, l_linestatus, COUNT(*) AS n,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS amount
    FROM lineitem GROUP BY l_returnflag, l_linestatus"""


@query("scan_table", _TABLE_SQL)
def _(ws: Workspace):
    readers.scan_table(ws.spark, f"{ws.sf_dir}/lineitem.parquet", "lineitem")
    return ws.spark.sql(_TABLE_SQL)


@query(
    "scan_literal",
    """SELECT l.attrition, l.risk_tier, count(source_key) AS employees
       FROM dim_attrition_label l LEFT JOIN staff e ON l.attrition = e.attrition
       GROUP BY l.attrition, l.risk_tier""",
)
def _(ws: Workspace):
    """The literal label rows against the employees of each attrition value."""
    sizes = (
        kpi.labelled_staff(ws.star)
        .groupBy("attrition")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return ws.star["dim_attrition_label"].join(sizes, "attrition", "left").select(
        "attrition", "risk_tier", F.coalesce("_n", F.lit(0)).alias("employees")
    )


@query("copy_tables", _COUNTS)
def _(ws: Workspace):
    source, _counts = ws.stored
    copied = sinks.copy_tables(ws.spark, source, fresh_path(ws.spark, "copy"))
    return sinks.counts_frame(ws.spark, copied)


_ORDER_LINES = "SELECT order_id, order_status FROM raw_orders"


@query("sink_append", _ORDER_LINES)
def _(ws: Workspace):
    """Two appends whose union is the whole table."""
    path = fresh_path(ws.spark, "append")
    rows = ws.raw["orders"].select("order_id", "order_status")
    delivered = F.col("order_status") == kpi.DELIVERED
    sinks.append(rows.where(delivered), path)
    sinks.append(rows.where(~delivered), path)
    return ws.spark.read.parquet(path)


@query("sink_replace", _ORDER_LINES)
def _(ws: Workspace):
    """A full refresh: the first load must leave nothing behind."""
    path = fresh_path(ws.spark, "replace")
    rows = ws.raw["orders"].select("order_id", "order_status")
    sinks.replace(rows.withColumn("order_status", F.lit("stale")), path)
    sinks.replace(rows, path)
    return versions.read(ws.spark, path)


@query("sink_replace_failed", _ORDER_LINES)
def _(ws: Workspace):
    """A refresh that fails half way leaves the rows of the one before."""
    path = fresh_path(ws.spark, "replace")
    rows = ws.raw["orders"].select("order_id", "order_status")
    sinks.replace(rows, path)
    broken = F.when(F.pmod(F.xxhash64("order_id"), F.lit(50)) == 0, F.raise_error(F.lit("a bad row"))).otherwise("stale")
    try:
        sinks.replace(rows.withColumn("order_status", broken.cast("string")), path)
    except Exception as failure:
        if "a bad row" not in str(failure):
            raise
    else:
        raise RuntimeError("the refresh was meant to fail")
    return versions.read(ws.spark, path)


@query(
    "sink_csv",
    """SELECT series, ds, round(yhat, 3) AS yhat, round(yhat_lower, 3) AS yhat_lower,
              round(yhat_upper, 3) AS yhat_upper FROM baseline""",
)
def _(ws: Workspace):
    """The forecast extract as CSV, read back with its declared types."""
    path = fresh_path(ws.spark, "forecast-csv")
    sinks.write_csv(baseline(ws).select(FORECAST_CSV.fieldNames()), path)
    rows = readers.scan_csv(ws.spark, path, FORECAST_CSV)
    return rows.select(
        "series", "ds", *[F.round(c, 3).alias(c) for c in ("yhat", "yhat_lower", "yhat_upper")]
    )


@query(
    "sink_metrics_json",
    """SELECT (SELECT count(*) FROM fact_orders) AS total_orders,
              (SELECT CAST(sum(price) AS DOUBLE) FROM fact_orders) AS gmv,
              (SELECT CAST(round(CAST(100.0 * sum(CASE WHEN attrition = 'Yes' THEN 1 ELSE 0 END)
                                      / count(*) AS DECIMAL(18,6)), 1) AS DOUBLE) FROM staff)
                  AS attrition_rate_pct""",
)
def _(ws: Workspace):
    path = fresh_path(ws.spark, "metrics")
    sinks.write_metrics(kpi.insights_summary(ws.star), path)
    schema = "total_orders BIGINT, gmv DECIMAL(28,2), attrition_rate_pct DECIMAL(10,1)"
    return ws.spark.read.schema(schema).json(path)


@query("sink_attrition_metrics")
def _(ws: Workspace):
    """The attrition model's metrics file, read back."""
    from kpiloom.catalog.models import attrition_metrics

    path = fresh_path(ws.spark, "attrition-metrics")
    sinks.write_metrics(attrition_metrics(ws), path)
    schema = (
        "accuracy DOUBLE, roc_auc DOUBLE, cv_roc_auc_mean DOUBLE, cv_roc_auc_std DOUBLE, "
        "feature_importance MAP<STRING, DOUBLE>"
    )
    back = ws.spark.read.schema(schema).json(path)
    return back.select("*", F.explode("feature_importance").alias("feature", "importance")).drop(
        "feature_importance"
    )


@query(
    "sink_forecast_metrics",
    """SELECT series, count(*) AS forecast_horizon_days, round(avg(y), 1) AS avg_predicted,
              round(max(y), 1) AS peak_predicted
       FROM (SELECT series, round_even(greatest(yhat, 0), 1) AS y FROM baseline WHERE is_future)
       GROUP BY series""",
)
def _(ws: Workspace):
    """The forecast metrics file, one line per series, read back."""
    path = fresh_path(ws.spark, "forecast-metrics")
    sinks.write_metrics(forecast.forecast_metrics(forecast.clipped_future(baseline(ws))), path)
    schema = (
        "series STRING, forecast_horizon_days BIGINT, avg_predicted DOUBLE, peak_predicted DOUBLE"
    )
    return ws.spark.read.schema(schema).json(path)


@query("sink_anomaly_csv")
def _(ws: Workspace):
    """The anomalous orders as CSV, read back with their declared types."""
    from kpiloom.catalog.models import flagged_orders

    path = fresh_path(ws.spark, "anomaly-csv")
    sinks.write_csv(anomaly.anomaly_extract(flagged_orders(ws)), path)
    return readers.scan_csv(ws.spark, path, ANOMALY_CSV)


@query("sink_anomaly_metrics")
def _(ws: Workspace):
    """The anomaly report as a metrics file, read back."""
    from kpiloom.catalog.models import flagged_orders

    path = fresh_path(ws.spark, "anomaly-metrics")
    report = anomaly.anomaly_report(flagged_orders(ws))
    sinks.write_metrics(report, path)
    return ws.spark.read.schema(report.schema).json(path)


def _stored_scores(ws: Workspace):
    """Every test row scored by the fitted model after it was saved and loaded again."""
    from kpiloom.catalog.models import attrition_model, attrition_rows

    path = fresh_path(ws.spark, "attrition-model")
    attrition.save_model(ws.spark, attrition_model(ws), path)
    loaded = attrition.load_model(ws.spark, path)
    return attrition.score(loaded, attrition_rows(ws).where("is_test"), ["source_key", "target"])


@query("model_store")
def _(ws: Workspace):
    """Save the fitted model, load it again, score every test row with it."""
    return _stored_scores(ws)


@query("model_store_rows", "SELECT source_key, target, true AS as_fitted FROM split_staff WHERE is_test")
def _(ws: Workspace):
    """Whether the saved model scores every test row as the fitted one does."""
    from kpiloom.catalog.models import attrition_model, attrition_rows

    direct = attrition.score(attrition_model(ws), attrition_rows(ws).where("is_test"), ["source_key"])
    direct = direct.select(F.col("source_key").alias("_key"), F.col("probability").alias("_fitted"))
    stored = _stored_scores(ws)
    return stored.join(direct, stored["source_key"] == direct["_key"], "left").select(
        "source_key", "target", F.coalesce(F.abs(F.col("probability") - F.col("_fitted")) < 1e-12, F.lit(False)).alias("as_fitted")
    )


@query(
    "cached_query",
    "SELECT order_status, count(*) AS n FROM fact_orders GROUP BY order_status",
)
def _(ws: Workspace):
    def build():
        return ws.star["fact_orders"].groupBy("order_status").agg(F.count(F.lit(1)).alias("n"))

    return extracts.cached_query(ws.spark, ("orders by status", ws.sf_dir), build)


@query("create_tables", _COUNTS)
def _(ws: Workspace):
    """Declared tables created if missing, then filled from the stored star."""
    source, _counts = ws.stored
    root = fresh_path(ws.spark, "warehouse")
    database = f"kpiloom_{uuid.uuid4().hex[:8]}"
    sizes = []
    for table in sinks.create_tables(ws.spark, database, root):
        name = table.split(".")[1]
        conform(versions.read(ws.spark, f"{source}/{name}"), name).write.insertInto(table)
        sizes.append((name, ws.spark.table(table).count()))
    sinks.drop_tables(ws.spark, database)
    return sinks.counts_frame(ws.spark, dict(sizes))
