"""Example business questions as named queries over the star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiloom.functions import columns as C
from kpiloom.plans import kpi
from kpiloom.plans.kpi import Star


def top5_categories(star: Star) -> DataFrame:
    return kpi.top_categories(star, 5).select("category_name", "revenue")


def top_attrition_department(star: Star) -> DataFrame:
    counts = kpi.leavers_by_department(star)
    # the exact share decides, the rounded one is shown
    share = F.try_divide(F.col("_left").cast("decimal(19,0)"), F.col("_all").cast("decimal(19,0)"))
    return (
        counts.orderBy(share.desc_nulls_last(), "department_name")
        .limit(1)
        .select("department_name", C.percent_of(F.col("_left"), F.col("_all")).alias("rate"))
    )


def delivery_by_state(star: Star) -> DataFrame:
    return (
        kpi.revenue_by_place(star)
        .join(star["dim_geography"].select("geo_id", "state"), "geo_id")
        .groupBy("state")
        .agg(
            F.try_divide(F.sum("_days").cast("double"), F.sum("_timed").cast("double")).alias(
                "avg_delivery_days"
            )
        )
    )


def orders_on(star: Star, days: DataFrame) -> DataFrame:
    """Orders bought on ``days``, rows of the calendar.

    Date ids follow the calendar, so the least and largest of them bound what is read:
    stored orders are in ranges of ``date_id`` and the scan skips the others.
    """
    ids = days.select("date_id")
    inside = F.col("date_id").between(
        ids.agg(F.min("date_id")).scalar(), ids.agg(F.max("date_id")).scalar()
    )
    return star["fact_orders"].where(inside).join(F.broadcast(ids), "date_id")


def delivered_in_year(star: Star, year: int = 2018) -> DataFrame:
    days = star["dim_date"].where(F.col("year") == year)
    return orders_on(star, days).where(F.col("order_status") == kpi.DELIVERED).agg(
        F.count(F.lit(1)).alias("delivered_orders")
    )


def state_most_customers(star: Star) -> DataFrame:
    counts = star["dim_customer"].groupBy("state").agg(F.count(F.lit(1)).alias("customers"))
    return counts.orderBy(F.desc("customers"), F.asc_nulls_last("state")).limit(1)


def top10_customers(star: Star) -> DataFrame:
    spent = star["fact_orders"].groupBy("customer_id").agg(F.sum("price").alias("order_value"))
    return spent.orderBy(F.desc_nulls_last("order_value"), "customer_id").limit(10)


def top_category_quarter(star: Star, year: int = 2017, quarter: int = 4) -> DataFrame:
    days = star["dim_date"].where((F.col("year") == year) & (F.col("quarter") == quarter))
    per_product = (
        orders_on(star, days)
        .where(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.sum("price").alias("_revenue"), F.count("order_id").alias("_orders"))
    )
    totals = kpi.category_totals(star, per_product)
    return totals.orderBy(F.desc_nulls_last("revenue"), "category_name").limit(1).select(
        "category_name", "revenue"
    )


# Question text → query, used by the outcome report.
QUESTIONS = {
    "What are the top 5 product categories by total revenue?": top5_categories,
    "Which department has the highest attrition rate?": top_attrition_department,
    "What is the average delivery time by state?": delivery_by_state,
    "How many orders were delivered in 2018?": delivered_in_year,
    "Which state has the most customers?": state_most_customers,
    "What are the top 10 customers by order value?": top10_customers,
}


def answer(star: Star, question: str) -> DataFrame:
    """The query behind a known question; blank or unknown text is refused."""
    if not question.strip():
        raise ValueError("question cannot be empty")
    if question not in QUESTIONS:
        raise KeyError(f"no query is registered for: {question}")
    return QUESTIONS[question](star)


__all__ = ["QUESTIONS", "answer", "top_category_quarter"] + [f.__name__ for f in QUESTIONS.values()]
