from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kpiloom.plans import audit, star
from kpiloom.schemas import TABLES
from tests.golden import raw_frames


@pytest.fixture(scope="module")
def built(spark):
    return star.build_star(spark, raw_frames(spark), number_ids=True)


def by(df, key):
    return {row[key]: row for row in df.collect()}


def test_orders_edges(built):
    rows = by(built["fact_orders"], "order_id")
    assert set(rows) == {"o1", "o2", "o3", "o4", "o5"}
    assert (rows["o1"].delivery_days, rows["o2"].delivery_days, rows["o3"].delivery_days) == (1, -1, None)
    assert rows["o1"].product_id == "p2"
    assert rows["o1"].price == Decimal("30.50") and rows["o1"].freight_value == Decimal("3.50")
    assert rows["o2"].price == 0 and rows["o2"].freight_value == 0
    assert rows["o1"].review_score == 2 and rows["o2"].review_score == 4
    assert rows["o4"].review_score is None
    assert (rows["o1"].payment_type, rows["o1"].payment_installments) == ("card", 3)
    assert (rows["o2"].payment_type, rows["o2"].payment_installments) == ("boleto", 2)
    assert rows["o3"].price is None and rows["o3"].payment_type is None


def test_duplicate_order_keeps_first_purchase(built):
    row = by(built["fact_orders"], "order_id")["o4"]
    assert (row.customer_id, row.order_status, row.delivery_days) == ("c2", "delivered", 21)
    assert row.product_id == "p3"


def test_missing_purchase_and_customer(built):
    row = by(built["fact_orders"], "order_id")["o5"]
    assert row.date_id is None and row.geo_id is None and row.delivery_days is None


def test_dates(built):
    rows = built["dim_date"].orderBy("date_id").collect()
    assert [r.date_id for r in rows] == [1, 2, 3, 4, 5]  # a duplicated order counts too
    first = rows[0]
    assert first.full_date == date(2016, 1, 1)
    assert (first.week, first.day_of_week, first.month_name, first.quarter) == (53, "Friday", "January", 1)


def test_customers_and_places(built):
    customers = by(built["dim_customer"], "customer_id")
    assert len(customers) == 3 and customers["c1"].city == "sao paulo"
    assert customers["c2"].rfm_segment is None
    regions = {r.state: r.region for r in built["dim_geography"].collect()}
    assert regions["SP"] == "Southeast" and regions["PT"] == "Other" and regions[None] == "Other"
    ids = sorted(r.geo_id for r in built["dim_geography"].collect())
    assert ids == [1, 2, 3, 4]
    orders = by(built["fact_orders"], "order_id")
    places = by(built["dim_geography"], "geo_id")
    assert places[orders["o1"].geo_id].city == "sao paulo"
    assert places[orders["o3"].geo_id].state is None  # NULL place matches NULL place


def test_products(built):
    rows = by(built["dim_product"], "product_id")
    assert len(rows) == 3
    assert rows["p1"].weight_kg == Decimal("1.01") and rows["p1"].product_name == "beauty"
    assert rows["p2"].category_name is None
    assert rows["p3"].weight_kg is None


def test_labels(built):
    rows = built["dim_attrition_label"].orderBy("label_id").collect()
    assert [(r.attrition, r.risk_tier) for r in rows][:4] == [
        ("Yes", "High"), ("Yes", "Medium"), ("Yes", "Low"), ("No", "High"),
    ]


def test_employees(built):
    rows = by(built["fact_employees"], "source_key")
    assert [rows[k].employee_id for k in (11, 12, 15, 19)] == [1, 2, 3, 4]
    labels = {r.label_id: (r.attrition, r.risk_tier) for r in built["dim_attrition_label"].collect()}
    assert labels[rows[11].label_id] == ("Yes", "Medium")
    assert rows[19].label_id is None
    assert {r.date_id for r in rows.values()} == {1}
    departments = by(built["dim_department"], "department_id")
    assert departments[rows[15].department_id].department_name == "R&D"
    assert departments[rows[19].department_id].department_name is None


def test_conform_types(built):
    for name, table in TABLES.items():
        frame = star.conform(built[name], name)
        assert [(f.name, f.dataType) for f in frame.schema] == [
            (f.name, f.dataType) for f in table.schema
        ]


def test_clean_star_has_no_violations(built):
    keys = audit.audit_pk(audit.star_keys(built)).collect()
    assert len(keys) == 8 and all(r.duplicate_keys == 0 and r.null_keys == 0 for r in keys)
    orphans = {(r.table_name, r.column_name): r.orphan_rows for r in audit.audit_fk(built).collect()}
    assert orphans.pop(("fact_orders", "customer_id")) == 1  # "cx" is not a customer
    assert set(orphans.values()) == {0}
    assert all(r.violations == 0 for r in audit.audit_bounds(built).collect())


def test_planted_violations(spark, built):
    dates = built["dim_date"]
    doubled = dates.unionByName(dates.where("date_id = 1"))
    gone = dates.limit(1).withColumn("date_id", F.lit(None).cast("int")).withColumn(
        "full_date", F.lit(None).cast("date")
    )
    bad = {**built, "dim_date": doubled.unionByName(gone)}
    row = audit.audit_pk({"dim_date": (bad["dim_date"], ["date_id"])}).first()
    assert (row.duplicate_keys, row.null_keys) == (1, 1)
    row = audit.audit_unique(bad).first()
    assert (row.duplicate_keys, row.null_keys) == (1, 1)
    assert audit.audit_not_null(bad).first().null_rows == 1

    wide = built["fact_orders"].withColumn("order_status", F.repeat(F.lit("x"), 51)).withColumn(
        "price", F.lit(Decimal("123456789.00"))
    )
    found = {
        (r.table_name, r.column_name): r.violations
        for r in audit.audit_bounds({"fact_orders": wide}).collect()
    }
    assert found[("fact_orders", "order_status")] == 5
    assert found[("fact_orders", "price")] == 5
    assert found[("fact_orders", "order_id")] == 0

    lost = {**built, "dim_product": built["dim_product"].where("product_id <> 'p1'")}
    orphans = {r.column_name: r for r in audit.audit_fk(lost).collect()}
    assert orphans["product_id"].orphan_keys == 1 and orphans["product_id"].orphan_rows == 1
