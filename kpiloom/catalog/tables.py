"""Star-schema builders and constraint audits as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiloom.catalog.registry import Workspace, query
from kpiloom.plans import audit, star
from kpiloom.sources import sinks
from kpiloom.sources.extracts import written

_COUNTS = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}"
    for t in (
        "dim_date", "dim_customer", "dim_product", "dim_geography", "dim_department",
        "dim_attrition_label", "fact_orders", "fact_employees",
    )
)


@query("dim_date", "SELECT * FROM dim_date")
def _(ws: Workspace):
    return ws.built["dim_date"]


@query(
    "dim_customer",
    "SELECT CAST(customer_id AS VARCHAR) AS customer_id, city, state, rfm_segment FROM dim_customer",
)
def _(ws: Workspace):
    return star.conform(ws.built["dim_customer"], "dim_customer")


@query(
    "dim_product",
    """SELECT CAST(product_id AS VARCHAR) AS product_id, category_name, product_name,
              CAST(weight_kg AS DOUBLE) AS weight_kg FROM dim_product""",
)
def _(ws: Workspace):
    return star.conform(ws.built["dim_product"], "dim_product")


@query("dim_geography", "SELECT * FROM dim_geography")
def _(ws: Workspace):
    return ws.built["dim_geography"]


@query("dim_department", "SELECT * FROM dim_department")
def _(ws: Workspace):
    return ws.built["dim_department"]


@query(
    "dim_attrition_label",
    """SELECT l.label_id, l.attrition, l.risk_tier, count(source_key) AS employees
       FROM dim_attrition_label l LEFT JOIN fact_employees e ON l.label_id = e.label_id
       GROUP BY l.label_id, l.attrition, l.risk_tier""",
)
def _(ws: Workspace):
    """The fixed labels with the number of employees that carry each."""
    used = ws.star["fact_employees"].groupBy("label_id").agg(F.count(F.lit(1)).alias("_n"))
    return ws.built["dim_attrition_label"].join(used, "label_id", "left").select(
        "label_id", "attrition", "risk_tier", F.coalesce("_n", F.lit(0)).alias("employees")
    )


@query(
    "fact_orders",
    """SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id,
              CAST(product_id AS VARCHAR) AS product_id, date_id, geo_id, order_status,
              payment_type, payment_installments, CAST(price AS DOUBLE) AS price,
              CAST(freight_value AS DOUBLE) AS freight_value, review_score, delivery_days
       FROM fact_orders""",
)
def _(ws: Workspace):
    return star.conform(ws.built["fact_orders"], "fact_orders")


@query(
    "fact_employees",
    """SELECT employee_id, department_id, date_id, label_id, age, gender,
              CAST(monthly_income AS DOUBLE) AS monthly_income, job_satisfaction,
              years_at_company, overtime, distance_from_home, education,
              environment_satisfaction, performance_rating FROM fact_employees""",
)
def _(ws: Workspace):
    joined = written(ws.spark, "employee-rows", ws.built["fact_employees"])
    return star.conform(star.number_employees(joined), "fact_employees")


@query("build_star", _COUNTS)
def _(ws: Workspace):
    """All eight tables written in dependency order, with observed row counts."""
    _, counts = ws.stored
    return sinks.counts_frame(ws.spark, counts)


# -- audits -----------------------------------------------------------------

@query(
    "audit_pk",
    " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, '{",".join(key)}' AS key_columns,
                   count(*) FILTER (WHERE n > 1 AND NOT missing) AS duplicate_keys,
                   CAST(coalesce(sum(n) FILTER (WHERE missing), 0) AS BIGINT) AS null_keys
            FROM (SELECT count(*) AS n, {" OR ".join(f"{k} IS NULL" for k in key)} AS missing
                  FROM {table} GROUP BY {",".join(key)})"""
        for table, key in (
            ("dim_date", ["date_id"]), ("dim_customer", ["customer_id"]),
            ("dim_product", ["product_id"]), ("dim_geography", ["geo_id"]),
            ("dim_department", ["department_id"]), ("dim_attrition_label", ["label_id"]),
            ("fact_orders", ["order_id"]), ("fact_employees", ["employee_id"]),
            ("raw_orders", ["order_id"]), ("raw_items", ["order_id", "order_item_id"]),
        )
    ),
)
def _(ws: Workspace):
    frames = audit.star_keys(ws.star)
    frames["raw_orders"] = (ws.raw["orders"], ["order_id"])
    frames["raw_items"] = (ws.raw["items"], ["order_id", "order_item_id"])
    return audit.audit_pk(frames)


@query(
    "audit_unique",
    """SELECT 'dim_date' AS table_name, 'full_date' AS key_columns,
              count(*) FILTER (WHERE n > 1 AND full_date IS NOT NULL) AS duplicate_keys,
              CAST(coalesce(sum(n) FILTER (WHERE full_date IS NULL), 0) AS BIGINT) AS null_keys
       FROM (SELECT full_date, count(*) AS n FROM dim_date GROUP BY full_date)""",
)
def _(ws: Workspace):
    return audit.audit_unique(ws.star)


@query(
    "audit_not_null",
    """SELECT 'dim_date' AS table_name, 'full_date' AS column_name,
              count(*) FILTER (WHERE full_date IS NULL) AS null_rows FROM dim_date""",
)
def _(ws: Workspace):
    return audit.audit_not_null(ws.star)


@query(
    "audit_fk",
    " UNION ALL ".join(
        f"""SELECT '{fact}' AS table_name, '{column}' AS column_name,
                   '{dim}' AS references_table, count(DISTINCT {column}) AS orphan_keys,
                   count(*) AS orphan_rows
            FROM {fact} WHERE {column} IS NOT NULL
              AND {column} NOT IN (SELECT {key} FROM {dim})"""
        for fact, column, dim, key in (
            ("fact_orders", "customer_id", "dim_customer", "customer_id"),
            ("fact_orders", "product_id", "dim_product", "product_id"),
            ("fact_orders", "date_id", "dim_date", "date_id"),
            ("fact_orders", "geo_id", "dim_geography", "geo_id"),
            ("fact_employees", "department_id", "dim_department", "department_id"),
            ("fact_employees", "date_id", "dim_date", "date_id"),
            ("fact_employees", "label_id", "dim_attrition_label", "label_id"),
        )
    ),
)
def _(ws: Workspace):
    return audit.audit_fk(ws.star)


_LENGTHS = {
    "dim_date": {"month_name": 20, "day_of_week": 20},
    "dim_customer": {"customer_id": 50, "city": 100, "state": 100, "rfm_segment": 30},
    "dim_product": {"product_id": 50, "category_name": 100, "product_name": 200},
    "dim_geography": {"city": 100, "state": 100, "region": 100},
    "dim_department": {"department_name": 100, "job_role": 100},
    "dim_attrition_label": {"attrition": 5, "risk_tier": 20},
    "fact_orders": {
        "order_id": 50, "customer_id": 50, "product_id": 50, "order_status": 50,
        "payment_type": 50,
    },
    "fact_employees": {"gender": 10, "overtime": 5},
}
_DIGITS = {
    "dim_product": {"weight_kg": 6},
    "fact_orders": {"price": 8, "freight_value": 8},
    "fact_employees": {"monthly_income": 8},
}


@query(
    "audit_bounds",
    " UNION ALL ".join(
        [
            f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
                       count(*) FILTER (WHERE length(CAST({c} AS VARCHAR)) > {n}) AS violations
                FROM {t}"""
            for t, columns in _LENGTHS.items()
            for c, n in columns.items()
        ]
        + [
            f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
                       count(*) FILTER (WHERE abs({c}) >= {10**n}) AS violations FROM {t}"""
            for t, columns in _DIGITS.items()
            for c, n in columns.items()
        ]
    ),
)
def _(ws: Workspace):
    return audit.audit_bounds(ws.star)
