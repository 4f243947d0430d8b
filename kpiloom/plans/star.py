"""Star-schema loaders: raw frames in, dimension and fact frames out.

Every loader is one lazy DataFrame. Id columns keep the type the raw frame
gives them (joins on BIGINT keys stay cheap); :func:`conform` casts to the
declared warehouse types when a table is written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiloom.functions import columns as C
from kpiloom.functions import lookups as L
from kpiloom.operators.keys import (
    first_non_null,
    keep_first,
    ordered_number,
    serial_id,
)
from kpiloom.schemas import TABLES

Frames = dict[str, DataFrame]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project and cast to the declared columns of a warehouse table."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].schema])


# -- dimensions -------------------------------------------------------------

def dim_date(orders: DataFrame) -> DataFrame:
    """Distinct purchase dates with calendar attributes, numbered in date order.

    The unpartitioned window runs over distinct calendar days only, a few
    thousand rows however large the orders table is.
    """
    days = (
        orders.select(F.to_date("order_purchase_timestamp").alias("full_date"))
        .where(F.col("full_date").isNotNull())
        .distinct()
    )
    parts = C.date_parts(F.col("full_date"))
    return days.select(
        F.row_number().over(Window.orderBy("full_date")).alias("date_id"),
        "full_date",
        *[expr.alias(name) for name, expr in parts.items()],
    )


def dim_customer(customers: DataFrame) -> DataFrame:
    renamed = customers.select(
        "customer_id",
        F.col("customer_city").alias("city"),
        F.col("customer_state").alias("state"),
    )
    return keep_first(renamed, "customer_id", ["city", "state"]).withColumn(
        "rfm_segment", F.lit(None).cast("string")
    )


def translate_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Left join of products to their English category; unmatched stay NULL."""
    names = keep_first(
        translation.select("product_category_name", "product_category_name_english"),
        "product_category_name",
        ["product_category_name_english"],
    )
    return products.join(names, "product_category_name", "left")


def dim_product(products: DataFrame, translation: DataFrame) -> DataFrame:
    category = F.col("product_category_name_english")
    shaped = translate_products(products, translation).select(
        "product_id",
        category.alias("category_name"),
        category.alias("product_name"),
        C.grams_to_kg(F.col("product_weight_g")).alias("weight_kg"),
    )
    return keep_first(shaped, "product_id", ["category_name"])


def dim_geography(customers: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Distinct (city, state) pairs with the state's region.

    ``regions`` (state, region) replaces the built-in 27-code map; a state in
    neither gets the default region.
    """
    places = customers.select(
        F.col("customer_city").alias("city"), F.col("customer_state").alias("state")
    ).distinct()
    numbered = ordered_number(places, "geo_id", lead=["state"], tail=["city"])
    if regions is None:
        region = C.map_values(F.col("state"), L.STATE_REGION, L.DEFAULT_REGION)
        return numbered.select(F.col("geo_id").cast("int"), "city", "state", region.alias("region"))
    known = keep_first(regions.select("state", "region"), "state", ["region"])
    return numbered.join(known, "state", "left").select(
        F.col("geo_id").cast("int"),
        "city",
        "state",
        F.coalesce("region", F.lit(L.DEFAULT_REGION)).alias("region"),
    )


def dim_department(employees: DataFrame) -> DataFrame:
    pairs = employees.select(
        F.col("Department").alias("department_name"), F.col("JobRole").alias("job_role")
    ).distinct()
    numbered = ordered_number(
        pairs, "department_id", lead=["department_name"], tail=["job_role"]
    )
    return numbered.withColumn("department_id", F.col("department_id").cast("int"))


def dim_attrition_label(spark: SparkSession) -> DataFrame:
    """The fixed six rows: attrition value by risk tier."""
    rows = [
        (i * len(L.RISK_TIERS) + j + 1, value, tier)
        for i, value in enumerate(L.ATTRITION_VALUES)
        for j, tier in enumerate(L.RISK_TIERS)
    ]
    return spark.createDataFrame(rows, TABLES["dim_attrition_label"].schema)


# -- order aggregates -------------------------------------------------------

def order_items(items: DataFrame) -> DataFrame:
    """First product and summed money per order; an all-NULL sum is zero."""
    def total(name: str):
        return F.coalesce(F.sum(name), F.lit(0)).alias(name)

    return items.groupBy("order_id").agg(
        first_non_null("product_id", ["order_item_id"]).alias("product_id"),
        total("price"),
        total("freight_value"),
    )


def order_payments(payments: DataFrame) -> DataFrame:
    """First payment type and largest instalment count per order."""
    return payments.groupBy("order_id").agg(
        first_non_null("payment_type", ["payment_sequential"]).alias("payment_type"),
        F.max("payment_installments").alias("payment_installments"),
    )


def order_reviews(reviews: DataFrame) -> DataFrame:
    """Mean review per order, rounded half to even."""
    return reviews.groupBy("order_id").agg(
        C.round_half_even(F.avg("review_score"), 0).cast("int").alias("review_score")
    )


def customer_places(customers: DataFrame, geography: DataFrame) -> DataFrame:
    """customer_id → geo_id by composite (city, state), NULLs matching NULLs."""
    places = geography.select("geo_id", F.col("city").alias("_city"), F.col("state").alias("_state"))
    matched = customers.join(
        places,
        customers["customer_city"].eqNullSafe(places["_city"])
        & customers["customer_state"].eqNullSafe(places["_state"]),
        "left",
    ).select("customer_id", "geo_id", "customer_city", "customer_state")
    # same order as dim_customer, so both pick the same row of a duplicated id
    return keep_first(matched, "customer_id", ["customer_city", "customer_state"]).select(
        "customer_id", "geo_id"
    )


def date_lookup(orders: DataFrame, dates: DataFrame) -> DataFrame:
    """Left join to dim_date on the purchase day; the calendar is broadcast."""
    days = dates.select("date_id", F.col("full_date").alias("_day"))
    return orders.join(
        F.broadcast(days), F.to_date(orders["order_purchase_timestamp"]) == days["_day"], "left"
    ).drop("_day")


# -- facts ------------------------------------------------------------------

ORDER_COLUMNS = [f.name for f in TABLES["fact_orders"].schema]


def fact_orders(raw: Frames, dates: DataFrame, geography: DataFrame) -> DataFrame:
    """One row per order with item, payment, review, date and place attached.

    Keep-first and the three aggregates are keyed by order_id, as the raw orders are,
    so they share one partitioning; the customer key is visited last, by rows that carry
    a day's number in place of timestamps. A customer has one place, so it cannot change
    which row of a repeated order is the first. Each right side is unique on its join
    key, hence a query that ignores, say, payments does not read them at all.
    """
    orders = raw["orders"].select(
        "order_id",
        "customer_id",
        "order_status",
        "order_purchase_timestamp",
        "order_delivered_customer_date",
    )
    unique = keep_first(
        orders, "order_id", ["order_purchase_timestamp", "customer_id", "order_status"]
    )
    joined = reduce(
        lambda left, right: left.join(right, "order_id", "left"),
        [order_items(raw["items"]), order_payments(raw["payments"]), order_reviews(raw["reviews"])],
        unique,
    )
    dated = date_lookup(joined, dates)
    days = C.elapsed_days(
        F.col("order_purchase_timestamp"), F.col("order_delivered_customer_date")
    )
    timed = dated.withColumn("delivery_days", days).select(*[c for c in ORDER_COLUMNS if c != "geo_id"])
    placed = timed.join(customer_places(raw["customers"], geography), "customer_id", "left")
    return placed.select(*ORDER_COLUMNS)


EMPLOYEE_FIELDS = {
    "age": "Age",
    "gender": "Gender",
    "monthly_income": "MonthlyIncome",
    "job_satisfaction": "JobSatisfaction",
    "years_at_company": "YearsAtCompany",
    "overtime": "OverTime",
    "distance_from_home": "DistanceFromHome",
    "education": "Education",
    "environment_satisfaction": "EnvironmentSatisfaction",
    "performance_rating": "PerformanceRating",
}


def medium_labels(labels: DataFrame) -> DataFrame:
    """Label rows of the placeholder tier, filtered before the join."""
    return labels.where(F.col("risk_tier") == "Medium").select(
        "label_id", F.col("attrition").alias("_attrition")
    )


def earliest_date_id(dates: DataFrame) -> DataFrame:
    return dates.agg(F.min_by("date_id", "full_date").alias("date_id"))


def fact_employees(
    employees: DataFrame, departments: DataFrame, labels: DataFrame, dates: DataFrame
) -> DataFrame:
    """Employee facts with department, label and placeholder date.

    ``source_key`` keeps the raw key so that :func:`number_employees` can give
    serial ids; it is not part of the warehouse table.
    """
    dept = departments.select(
        "department_id",
        F.col("department_name").alias("_dept"),
        F.col("job_role").alias("_role"),
    )
    tier = medium_labels(labels)  # two rows
    joined = employees.join(
        dept,
        employees["Department"].eqNullSafe(dept["_dept"])
        & employees["JobRole"].eqNullSafe(dept["_role"]),
        "left",
    ).join(F.broadcast(tier), employees["Attrition"] == tier["_attrition"], "left")
    return joined.select(
        F.col("EmployeeNumber").alias("source_key"),
        "department_id",
        earliest_date_id(dates).scalar().alias("date_id"),
        "label_id",
        *[F.col(src).alias(dst) for dst, src in EMPLOYEE_FIELDS.items()],
    )


def number_employees(employees: DataFrame) -> DataFrame:
    """Add the dense serial ``employee_id`` in source-key order."""
    return serial_id(employees, "employee_id", "source_key")


# -- everything -------------------------------------------------------------

def build_dimensions(spark: SparkSession, raw: Frames) -> Frames:
    return {
        "dim_date": dim_date(raw["orders"]),
        "dim_customer": dim_customer(raw["customers"]),
        "dim_product": dim_product(raw["products"], raw["translation"]),
        "dim_geography": dim_geography(raw["customers"], raw.get("regions")),
        "dim_department": dim_department(raw["employees"]),
        "dim_attrition_label": dim_attrition_label(spark),
    }


def build_facts(raw: Frames, dims: Frames, number_ids: bool = False) -> Frames:
    """The two facts, looking keys up in ``dims`` (lazy or already written).

    ``number_ids`` adds ``employee_id``; it costs one small estimation job.
    """
    staff = fact_employees(
        raw["employees"], dims["dim_department"], dims["dim_attrition_label"], dims["dim_date"]
    )
    return {
        "fact_orders": fact_orders(raw, dims["dim_date"], dims["dim_geography"]),
        "fact_employees": number_employees(staff) if number_ids else staff,
    }


def build_star(spark: SparkSession, raw: Frames, number_ids: bool = False) -> Frames:
    """All eight tables as one lazy graph, dimensions first."""
    dims = build_dimensions(spark, raw)
    return {**dims, **build_facts(raw, dims, number_ids)}
