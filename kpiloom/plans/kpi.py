"""KPI and dashboard queries over a dict of star-schema frames.

Where a fact meets a dimension that can grow, the fact is aggregated by the
foreign key first and joined after: the join then sees one row per key, so a
product or place holding a third of all orders cannot overload a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiloom.functions import columns as C
from kpiloom.operators.quantiles import exact_percentiles

Star = dict[str, DataFrame]

DELIVERED = "delivered"
HIGH_PRICE = 500.0
LATE_DAYS = 20
DELAY_DAYS = 30


# -- shared joins -----------------------------------------------------------

def dated_orders(star: Star) -> DataFrame:
    """Orders that have a known purchase date (inner join to the calendar)."""
    return star["fact_orders"].join(F.broadcast(star["dim_date"]), "date_id")


def labelled_staff(star: Star) -> DataFrame:
    """Employees with their attrition value; the label table has six rows."""
    labels = star["dim_attrition_label"].select("label_id", "attrition")
    return star["fact_employees"].join(F.broadcast(labels), "label_id")


def staff_by_department(star: Star) -> DataFrame:
    """Employees with department and attrition label (three-way star join)."""
    return labelled_staff(star).join(star["dim_department"], "department_id")


def left_company() -> Column:
    return F.col("attrition") == "Yes"


# -- reusable shapes --------------------------------------------------------

def counts_with_share(df: DataFrame, key: str) -> DataFrame:
    """Count per value (NULL included) and its share of all rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.try_divide(F.col("n").cast("double"), total))


def histogram(df: DataFrame, value: str, low: int, high: int, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins over the integers low..high inclusive."""
    width = (high + 1 - low) / bins
    inside = df.where(F.col(value).between(low, high))
    position = F.width_bucket(
        F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high + 1)), F.lit(bins)
    )
    counted = inside.groupBy(position.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "bin", (F.lit(float(low)) + (F.col("bin") - 1) * F.lit(width)).alias("bin_start"), "n"
    )


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles and 1.5-IQR whiskers per class; the classes are a closed set."""
    v = F.col(value).cast("double")
    quartiles = exact_percentiles(df, value, [0.25, 0.5, 0.75], by=[by]).select(
        F.col(by).alias("_by"),
        F.col("p0").alias("q1"),
        F.col("p1").alias("median"),
        F.col("p2").alias("q3"),
        "n",
    )
    tagged = df.select(by, v.alias("_v")).join(
        F.broadcast(quartiles), F.col(by).eqNullSafe(F.col("_by"))
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("_v").between(F.col("q1") - reach, F.col("q3") + reach)
    return tagged.groupBy(by, "n", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def grid_counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def revenue_by_product(star: Star) -> DataFrame:
    """Revenue and order count per product: the pre-aggregate of category queries."""
    return (
        star["fact_orders"]
        .where(F.col("product_id").isNotNull())
        .groupBy("product_id")
        .agg(F.sum("price").alias("_revenue"), F.count("order_id").alias("_orders"))
    )


def revenue_by_place(star: Star) -> DataFrame:
    return (
        star["fact_orders"]
        .where(F.col("geo_id").isNotNull())
        .groupBy("geo_id")
        .agg(
            F.sum("price").alias("_revenue"),
            F.sum("delivery_days").alias("_days"),
            F.count("delivery_days").alias("_timed"),
        )
    )


def state_totals(star: Star) -> DataFrame:
    return (
        revenue_by_place(star)
        .join(star["dim_geography"].select("geo_id", "state"), "geo_id")
        .groupBy("state")
        .agg(F.sum("_revenue").alias("revenue"))
    )


def category_totals(star: Star, per_product: DataFrame | None = None) -> DataFrame:
    products = star["dim_product"].where(F.col("category_name").isNotNull())
    return (
        (per_product if per_product is not None else revenue_by_product(star))
        .join(products.select("product_id", "category_name"), "product_id")
        .groupBy("category_name")
        .agg(F.sum("_revenue").alias("revenue"), F.sum("_orders").alias("orders"))
    )


def top_categories(star: Star, limit: int) -> DataFrame:
    return category_totals(star).orderBy(F.desc_nulls_first("revenue"), "category_name").limit(limit)


# -- overview and commerce --------------------------------------------------

def total_orders(star: Star) -> DataFrame:
    return star["fact_orders"].agg(F.count(F.lit(1)).alias("total_orders"))


def gmv(star: Star) -> DataFrame:
    return star["fact_orders"].agg(F.sum("price").alias("gmv"))


def attrition_rate(star: Star) -> DataFrame:
    return labelled_staff(star).agg(C.percent_where(left_company()).alias("attrition_rate"))


def flagged_orders(
    star: Star, price_above: float = HIGH_PRICE, days_above: int = LATE_DAYS
) -> DataFrame:
    late = (F.col("price") > F.lit(price_above)) & (F.col("delivery_days") > days_above)
    return dated_orders(star).where(late).agg(F.count(F.lit(1)).alias("flagged_orders"))


def avg_review(star: Star) -> DataFrame:
    scored = star["fact_orders"].where(F.col("review_score").isNotNull())
    return scored.agg(
        C.ratio_half_up(F.sum("review_score"), F.count("review_score"), 2).alias("avg_review")
    )


def revenue_by_month(star: Star) -> DataFrame:
    delivered = star["fact_orders"].where(F.col("order_status") == DELIVERED)
    daily = delivered.groupBy("date_id").agg(F.sum("price").alias("_revenue"))
    months = daily.join(F.broadcast(star["dim_date"]), "date_id").groupBy("year", "month")
    return (
        months.agg(F.sum("_revenue").alias("revenue"))
        .withColumn("period", C.period_label(F.col("year"), F.col("month")))
        .orderBy("year", "month")
    )


def orders_by_status(star: Star) -> DataFrame:
    return counts_with_share(star["fact_orders"], "order_status").orderBy(F.desc("n"), "order_status")


def attrition_by_department(star: Star) -> DataFrame:
    return leavers_by_department(star).select(
        "department_name", C.percent_of(F.col("_left"), F.col("_all")).alias("rate")
    )


def leavers_by_department(star: Star) -> DataFrame:
    """Exact counts: department_name, _left, _all."""
    hits = labelled_staff(star).groupBy("department_id").agg(
        F.count_if(left_company()).alias("_left"), F.count(F.lit(1)).alias("_all")
    )
    return (
        hits.join(star["dim_department"], "department_id")
        .groupBy("department_name")
        .agg(F.sum("_left").alias("_left"), F.sum("_all").alias("_all"))
    )


def avg_order_value(star: Star) -> DataFrame:
    return star["fact_orders"].agg(C.exact_avg(F.col("price")).alias("avg_order_value"))


def delay_rate(star: Star, days_above: int = DELAY_DAYS) -> DataFrame:
    timed = star["fact_orders"].where(F.col("delivery_days").isNotNull())
    return timed.agg(C.percent_where(F.col("delivery_days") > days_above).alias("delay_rate"))


def revenue_by_category(star: Star, limit: int = 15) -> DataFrame:
    return top_categories(star, limit)


def payment_mix(star: Star) -> DataFrame:
    return counts_with_share(star["fact_orders"], "payment_type").orderBy(F.desc("n"), "payment_type")


def delivery_histogram(star: Star) -> DataFrame:
    return histogram(star["fact_orders"], "delivery_days", 1, 60, 30).orderBy("bin")


def revenue_by_state(star: Star) -> DataFrame:
    return state_totals(star).orderBy(F.desc_nulls_first("revenue"), "state")


# -- workforce --------------------------------------------------------------

def total_employees(star: Star) -> DataFrame:
    return star["fact_employees"].agg(F.count(F.lit(1)).alias("total_employees"))


def attrition_count(star: Star) -> DataFrame:
    return labelled_staff(star).where(left_company()).agg(
        F.count(F.lit(1)).alias("attrition_count")
    )


def avg_income(star: Star) -> DataFrame:
    return star["fact_employees"].agg(C.exact_avg(F.col("monthly_income")).alias("avg_income"))


def avg_tenure(star: Star) -> DataFrame:
    return star["fact_employees"].agg(C.exact_avg(F.col("years_at_company")).alias("avg_tenure"))


def attrition_by_overtime(star: Star) -> DataFrame:
    return labelled_staff(star).groupBy("overtime").agg(
        F.sum(F.when(left_company(), 1).otherwise(0)).alias("left_co"),
        F.sum(F.when(F.col("attrition") == "No", 1).otherwise(0)).alias("stayed"),
    )


def income_by_attrition(star: Star) -> DataFrame:
    return box_stats(labelled_staff(star), "monthly_income", "attrition")


def satisfaction_grid(star: Star) -> DataFrame:
    return grid_counts(
        labelled_staff(star), "job_satisfaction", "environment_satisfaction", "attrition"
    )


def insights_summary(star: Star) -> DataFrame:
    """Orders, GMV and attrition rate in one row."""
    return star["fact_orders"].agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.round(F.sum("price"), 2).alias("gmv"),
    ).withColumn("attrition_rate_pct", attrition_rate(star).scalar())
