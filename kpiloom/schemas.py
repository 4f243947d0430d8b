"""Declared schemas of the raw files and of the eight warehouse tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "DATE": T.DateType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
    "WEIGHT": T.DecimalType(8, 2),
    "MONEY": T.DecimalType(10, 2),
}


def struct(columns: str) -> T.StructType:
    """Schema from ``name TYPE`` pairs; needs no running session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW = {
    "orders": struct(
        "order_id STRING, customer_id STRING, order_status STRING, "
        "order_purchase_timestamp TIMESTAMP_NTZ, order_delivered_customer_date TIMESTAMP_NTZ, "
        "order_estimated_delivery_date TIMESTAMP_NTZ"
    ),
    "items": struct(
        "order_id STRING, order_item_id INT, product_id STRING, "
        "price MONEY, freight_value MONEY"
    ),
    "payments": struct(
        "order_id STRING, payment_sequential INT, payment_type STRING, payment_installments INT"
    ),
    "reviews": struct("order_id STRING, review_score INT"),
    "customers": struct("customer_id STRING, customer_city STRING, customer_state STRING"),
    "products": struct(
        "product_id STRING, product_category_name STRING, product_weight_g DOUBLE"
    ),
    "translation": struct(
        "product_category_name STRING, product_category_name_english STRING"
    ),
    "employees": struct(
        "EmployeeNumber BIGINT, Department STRING, JobRole STRING, Attrition STRING, "
        "Gender STRING, OverTime STRING, Age INT, MonthlyIncome MONEY, "
        "JobSatisfaction INT, YearsAtCompany INT, DistanceFromHome INT, Education INT, "
        "EnvironmentSatisfaction INT, PerformanceRating INT"
    ),
}


@dataclass(frozen=True)
class Table:
    """One warehouse table: columns, keys and declared bounds."""

    name: str
    schema: T.StructType
    primary_key: str
    foreign_keys: tuple[tuple[str, str, str], ...] = ()  # (column, table, referenced column)
    unique: tuple[str, ...] = ()
    not_null: tuple[str, ...] = ()
    max_length: tuple[tuple[str, int], ...] = ()

    @property
    def numerics(self) -> list[tuple[str, T.DecimalType]]:
        return [(f.name, f.dataType) for f in self.schema if isinstance(f.dataType, T.DecimalType)]


# Dimensions first, facts last: the order in which they are written and copied.
TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table(
            "dim_date",
            struct(
                "date_id INT, full_date DATE, year INT, quarter INT, month INT, "
                "month_name STRING, week INT, day_of_week STRING"
            ),
            "date_id",
            unique=("full_date",),
            not_null=("full_date",),
            max_length=(("month_name", 20), ("day_of_week", 20)),
        ),
        Table(
            "dim_customer",
            struct("customer_id STRING, city STRING, state STRING, rfm_segment STRING"),
            "customer_id",
            max_length=(("customer_id", 50), ("city", 100), ("state", 100), ("rfm_segment", 30)),
        ),
        Table(
            "dim_product",
            struct(
                "product_id STRING, category_name STRING, product_name STRING, "
                "weight_kg WEIGHT"
            ),
            "product_id",
            max_length=(("product_id", 50), ("category_name", 100), ("product_name", 200)),
        ),
        Table(
            "dim_geography",
            struct("geo_id INT, city STRING, state STRING, region STRING"),
            "geo_id",
            max_length=(("city", 100), ("state", 100), ("region", 100)),
        ),
        Table(
            "dim_department",
            struct("department_id INT, department_name STRING, job_role STRING"),
            "department_id",
            max_length=(("department_name", 100), ("job_role", 100)),
        ),
        Table(
            "dim_attrition_label",
            struct("label_id INT, attrition STRING, risk_tier STRING"),
            "label_id",
            max_length=(("attrition", 5), ("risk_tier", 20)),
        ),
        Table(
            "fact_orders",
            struct(
                "order_id STRING, customer_id STRING, product_id STRING, date_id INT, geo_id INT, "
                "order_status STRING, payment_type STRING, payment_installments INT, "
                "price MONEY, freight_value MONEY, review_score INT, "
                "delivery_days INT"
            ),
            "order_id",
            foreign_keys=(
                ("customer_id", "dim_customer", "customer_id"),
                ("product_id", "dim_product", "product_id"),
                ("date_id", "dim_date", "date_id"),
                ("geo_id", "dim_geography", "geo_id"),
            ),
            max_length=(
                ("order_id", 50),
                ("customer_id", 50),
                ("product_id", 50),
                ("order_status", 50),
                ("payment_type", 50),
            ),
        ),
        Table(
            "fact_employees",
            struct(
                "employee_id BIGINT, department_id INT, date_id INT, label_id INT, age INT, "
                "gender STRING, monthly_income MONEY, job_satisfaction INT, "
                "years_at_company INT, overtime STRING, distance_from_home INT, education INT, "
                "environment_satisfaction INT, performance_rating INT"
            ),
            "employee_id",
            foreign_keys=(
                ("department_id", "dim_department", "department_id"),
                ("date_id", "dim_date", "date_id"),
                ("label_id", "dim_attrition_label", "label_id"),
            ),
            max_length=(("gender", 10), ("overtime", 5)),
        ),
    )
}
