"""Raw frames derived from the given TPC-H-like tables.

Only this module knows those tables. The bindings exercise the operators; they
carry no business meaning (there are no reviews, payments or HR records in the
given data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = {"F": "delivered", "O": "shipped", "P": "processing"}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    arrived = lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.max("l_shipdate").alias("order_delivered_customer_date")
    )
    status = F.when(F.col("o_orderstatus") == "F", STATUS["F"])
    status = status.when(F.col("o_orderstatus") == "O", STATUS["O"]).otherwise(STATUS["P"])
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        status.alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
    ).join(arrived, "order_id", "left")


def raw_items(lineitem: DataFrame) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    freight = F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2).cast("decimal(12,2)")
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        price.alias("price"),
        freight.alias("freight_value"),
    )


def raw_payments(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One payment per order that has lines; lines are folded before the join."""
    lines = lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.max("l_linenumber").alias("payment_installments")
    )
    types = orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("payment_type")
    )
    return lines.join(types, "order_id").select(
        "order_id",
        F.lit(1).alias("payment_sequential"),
        "payment_type",
        "payment_installments",
    )


def raw_reviews(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.ceil(F.col("l_quantity") / 10).cast("int").alias("review_score"),
    )


def raw_customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    # nation is the fixed 25-row table
    named = customer.join(
        F.broadcast(nation), customer["c_nationkey"] == nation["n_nationkey"], "left"
    )
    return named.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("n_name").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )


def raw_regions(nation: DataFrame, region: DataFrame) -> DataFrame:
    return nation.join(
        F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"]
    ).select(F.col("n_name").alias("state"), F.col("r_name").alias("region"))


def raw_products(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("product_category_name"),
        (F.col("p_size") * 25 + 5).cast("double").alias("product_weight_g"),
    )


def raw_translation(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_type").alias("product_category_name"),
        F.initcap("p_type").alias("product_category_name_english"),
    ).distinct()


def raw_employees(customer: DataFrame, orders: DataFrame, nation: DataFrame) -> DataFrame:
    """One HR-like record per customer, from the customer's order history."""
    day = F.to_date("o_orderdate")
    history = orders.groupBy(F.col("o_custkey").alias("_cust")).agg(
        F.min(day).alias("_first"),
        F.max(day).alias("_last"),
        F.count(F.lit(1)).alias("_orders"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("_urgent"),
        F.count_if(F.col("o_orderstatus") == "F").alias("_f"),
        F.count_if(F.col("o_orderstatus") == "O").alias("_o"),
    )
    today = orders.agg(F.max(day).alias("_today")).scalar()
    key = F.col("c_custkey")
    counted = lambda name: F.coalesce(F.col(name), F.lit(0))
    base = customer.join(
        F.broadcast(nation), customer["c_nationkey"] == nation["n_nationkey"], "left"
    ).join(history, customer["c_custkey"] == history["_cust"], "left")
    churned = F.col("_last") < F.date_sub(today, 365)
    return base.select(
        key.alias("EmployeeNumber"),
        F.col("c_mktsegment").alias("Department"),
        F.col("n_name").alias("JobRole"),
        F.when(churned, "Yes").otherwise("No").alias("Attrition"),
        F.when(key % 2 == 1, "Male").otherwise("Female").alias("Gender"),
        F.when(counted("_urgent") >= 3, "Yes").otherwise("No").alias("OverTime"),
        (18 + key % 43).cast("int").alias("Age"),
        F.col("c_acctbal").cast("decimal(10,2)").alias("MonthlyIncome"),
        (1 + counted("_f") % 4).cast("int").alias("JobSatisfaction"),
        F.floor(F.datediff(today, F.col("_first")) / 365).cast("int").alias("YearsAtCompany"),
        (1 + F.col("c_nationkey")).cast("int").alias("DistanceFromHome"),
        (1 + F.col("n_regionkey")).cast("int").alias("Education"),
        (1 + counted("_o") % 4).cast("int").alias("EnvironmentSatisfaction"),
        F.when(counted("_orders") > 10, 4).otherwise(3).alias("PerformanceRating"),
    )


GIVEN_TABLES = ("orders", "lineitem", "customer", "nation", "region", "part")
# the given tables each raw frame is made of
RAW_TABLES = {
    "orders": ("orders", "lineitem"),
    "items": ("lineitem",),
    "payments": ("orders", "lineitem"),
    "reviews": ("lineitem",),
    "customers": ("customer", "nation"),
    "regions": ("nation", "region"),
    "products": ("part",),
    "translation": ("part",),
    "employees": ("customer", "orders", "nation"),
}


def raw_frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = {name: given(spark, sf_dir, name) for name in GIVEN_TABLES}
    return {
        "orders": raw_orders(t["orders"], t["lineitem"]),
        "items": raw_items(t["lineitem"]),
        "payments": raw_payments(t["orders"], t["lineitem"]),
        "reviews": raw_reviews(t["lineitem"]),
        "customers": raw_customers(t["customer"], t["nation"]),
        "regions": raw_regions(t["nation"], t["region"]),
        "products": raw_products(t["part"]),
        "translation": raw_translation(t["part"]),
        "employees": raw_employees(t["customer"], t["orders"], t["nation"]),
    }
