"""Every named query against its SQL definition, and the plans behind them."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry
from kpiloom.catalog import oracle_sql, queries
from kpiloom.catalog.registry import workspace
from kpiloom.plans import kpi
from tools.compare import connect, differences, normal

NAMES = list(queries())


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, con, name):
    frame = queries()[name](spark, small)
    rows = frame.collect()
    sql = oracle_sql().get(name)
    if sql is None:
        assert rows
    else:
        assert differences(frame, rows, con, sql) == []


def test_entry(spark):
    assert entry(spark).columns == ["category_name", "revenue", "orders"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().explainString(
        df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


FACT_QUERIES = [
    "kpi_total_orders", "kpi_gmv", "kpi_flagged_orders", "revenue_by_month", "orders_by_status",
    "revenue_by_category", "revenue_by_state", "payment_mix", "delivery_histogram",
    "attrition_by_department", "income_by_attrition", "ask_top10_customers", "fact_orders",
    "insights_summary", "stratified_split", "audit_fk",
]


@pytest.mark.parametrize("name", FACT_QUERIES)
def test_plans_avoid_cross_joins_and_python(spark, small, name):
    plan = plan_of(queries()[name](spark, small))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "MapInPandas"):
        assert operator not in plan


def test_unused_branches_are_not_read(spark, small):
    """A count touches the order key only; revenue never reads payments."""
    star = workspace(spark, small).built
    count = plan_of(kpi.total_orders(star))
    assert count.count("Location: ") == 1 and "ReadSchema: struct<o_orderkey:bigint>" in count
    gmv = plan_of(kpi.gmv(star))
    assert "o_orderpriority" not in gmv and "l_shipdate" not in gmv and "customer.parquet" not in gmv


def test_the_cut_of_the_scores_is_not_made_by_one_task(spark, small):
    """``percentile`` brings every distinct score to one task; it was a scalar subquery of the plan."""
    plan = queries()["isolation_forest_score_rows"](spark, small)._jdf.queryExecution().toString()
    assert "percentile(" not in plan


def test_filters_reach_the_scan(spark, small):
    lines = workspace(spark, small).table("lineitem").where(F.col("l_quantity") > 45)
    assert re.search(r"PushedFilters: \[.*GreaterThan\(l_quantity,45", plan_of(lines))


REPEATED = [
    "fact_orders", "revenue_by_category", "revenue_by_state", "income_by_attrition", "eval_auc",
    "stratified_split", "surrogate_key", "forecast_baseline", "keep_first",
]


@pytest.mark.parametrize("name", REPEATED)
def test_result_does_not_depend_on_partitions_or_broadcast(spark, small, name):
    def run():
        frame = queries()[name](spark, small)
        return normal(frame.columns, frame.collect())

    want = run()
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert run() == want
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
