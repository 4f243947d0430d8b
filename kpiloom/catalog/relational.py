"""Projections, filters, joins, aggregates, windows, sorts and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiloom.catalog.registry import Workspace, query
from kpiloom.functions import columns as C
from kpiloom.models import attrition, forecast
from kpiloom.operators import keys
from kpiloom.operators.quantiles import exact_percentiles
from kpiloom.plans import guard, kpi, star
from kpiloom.sources import extracts

# Thresholds that select something on the given tables (prices are larger there).
PRICE_ABOVE = 300_000
DAYS_ABOVE = 20


def daily_orders(ws: Workspace):
    """The daily series, one row per calendar day, written once for all uses."""
    return extracts.extract(
        ws.spark, ws.sf_dir, "daily-orders", lambda: forecast.daily_orders(ws.star)
    )


def series_frame(ws: Workspace):
    return forecast.long_series(daily_orders(ws))


def baseline(ws: Workspace):
    return forecast.baseline_forecast(series_frame(ws))


def loaded_staff(ws: Workspace):
    """Employee facts from raw records and the stored dimensions."""
    dims = ws.star
    return star.fact_employees(
        ws.raw["employees"], dims["dim_department"], dims["dim_attrition_label"], dims["dim_date"]
    )


def query_log(ws: Workspace):
    """A query log derived from every order: some rows unsafe, all fenced."""
    key = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("DROP TABLE t"), key))
    text = text.when(
        F.col("o_orderkey") % 11 == 0,
        F.concat(F.lit("SELECT created_at FROM t WHERE id = "), key),
    ).otherwise(F.concat(F.lit("SELECT price FROM t WHERE id = "), key))
    fenced = F.concat(F.lit("```sql\n"), text, F.lit("\n```"))
    return ws.table("orders").select(
        F.col("o_orderkey").alias("log_id"), fenced.alias("sql_text")
    )


# -- projections and filters ------------------------------------------------

@query(
    "project_rename",
    """SELECT Age AS age, Gender AS gender, CAST(MonthlyIncome AS DOUBLE) AS monthly_income,
              JobSatisfaction AS job_satisfaction, YearsAtCompany AS years_at_company,
              OverTime AS overtime, DistanceFromHome AS distance_from_home,
              Education AS education, EnvironmentSatisfaction AS environment_satisfaction,
              PerformanceRating AS performance_rating FROM raw_employees""",
)
def _(ws: Workspace):
    return ws.raw["employees"].select(
        *[F.col(src).alias(dst) for dst, src in star.EMPLOYEE_FIELDS.items()]
    )


@query(
    "add_constant",
    """SELECT customer_id, CAST(NULL AS VARCHAR) AS rfm_segment, customer_state AS state_copy,
              'retail' AS channel FROM raw_customers""",
)
def _(ws: Workspace):
    return ws.raw["customers"].select(
        "customer_id",
        F.lit(None).cast("string").alias("rfm_segment"),
        F.col("customer_state").alias("state_copy"),
        F.lit("retail").alias("channel"),
    )


@query(
    "filter_eq",
    "SELECT order_id, order_status FROM fact_orders WHERE order_status = 'delivered'",
)
def _(ws: Workspace):
    return ws.star["fact_orders"].where(F.col("order_status") == kpi.DELIVERED).select(
        "order_id", "order_status"
    )


@query(
    "filter_range",
    f"""SELECT order_id, CAST(price AS DOUBLE) AS price, delivery_days FROM fact_orders
        WHERE (price > {PRICE_ABOVE} AND delivery_days > {DAYS_ABOVE})
           OR delivery_days BETWEEN 1 AND 60""",
)
def _(ws: Workspace):
    late = (F.col("price") > PRICE_ABOVE) & (F.col("delivery_days") > DAYS_ABOVE)
    return ws.star["fact_orders"].where(late | F.col("delivery_days").between(1, 60)).select(
        "order_id", "price", "delivery_days"
    )


@query(
    "filter_not_null",
    """SELECT order_id, delivery_days FROM fact_orders
       WHERE price IS NOT NULL AND delivery_days IS NOT NULL""",
)
def _(ws: Workspace):
    return ws.star["fact_orders"].dropna(subset=["price", "delivery_days"]).select(
        "order_id", "delivery_days"
    )


@query(
    "filter_bool_split",
    f"""SELECT count(*) FILTER (WHERE flag) AS n_flagged,
               count(*) FILTER (WHERE NOT flag) AS n_normal,
               CAST(sum(price) FILTER (WHERE flag) AS DOUBLE)
                   / count(price) FILTER (WHERE flag) AS avg_price_flagged,
               CAST(sum(price) FILTER (WHERE NOT flag) AS DOUBLE)
                   / count(price) FILTER (WHERE NOT flag) AS avg_price_normal
        FROM (SELECT price, coalesce(price > {PRICE_ABOVE} AND delivery_days > {DAYS_ABOVE}, false)
                         AS flag FROM fact_orders)""",
)
def _(ws: Workspace):
    late = (F.col("price") > PRICE_ABOVE) & (F.col("delivery_days") > DAYS_ABOVE)
    flag = F.coalesce(late, F.lit(False))
    return ws.star["fact_orders"].agg(
        F.count_if(flag).alias("n_flagged"),
        F.count_if(~flag).alias("n_normal"),
        C.exact_avg(F.when(flag, F.col("price"))).alias("avg_price_flagged"),
        C.exact_avg(F.when(~flag, F.col("price"))).alias("avg_price_normal"),
    )


@query(
    "filter_last_horizon",
    """SELECT series, ds, round(yhat, 3) AS yhat FROM baseline
       WHERE ds > (SELECT max(ds) FROM baseline) - 90""",
)
def _(ws: Workspace):
    return forecast.last_days(baseline(ws)).select("series", "ds", F.round("yhat", 3).alias("yhat"))


# -- joins ------------------------------------------------------------------

@query(
    "join_left_translate",
    """SELECT product_id, product_category_name_english
       FROM raw_products LEFT JOIN raw_translation USING (product_category_name)""",
)
def _(ws: Workspace):
    return star.translate_products(ws.raw["products"], ws.raw["translation"]).select(
        "product_id", "product_category_name_english"
    )


@query("join_left_composite", "SELECT customer_id, geo_id FROM customer_places")
def _(ws: Workspace):
    return star.customer_places(ws.raw["customers"], ws.star["dim_geography"])


@query(
    "join_left_aggregates",
    """SELECT order_id, product_id, CAST(price AS DOUBLE) AS price, payment_type, review_score
       FROM raw_orders LEFT JOIN order_items USING (order_id)
       LEFT JOIN order_payments USING (order_id) LEFT JOIN order_reviews USING (order_id)""",
)
def _(ws: Workspace):
    orders = ws.raw["orders"].select("order_id")
    for part in (
        star.order_items(ws.raw["items"]).select("order_id", "product_id", "price"),
        star.order_payments(ws.raw["payments"]).select("order_id", "payment_type"),
        star.order_reviews(ws.raw["reviews"]),
    ):
        orders = orders.join(part, "order_id", "left")
    return orders


@query(
    "join_left_date_lookup",
    """SELECT order_id, date_id FROM raw_orders
       LEFT JOIN dim_date ON CAST(order_purchase_timestamp AS DATE) = full_date""",
)
def _(ws: Workspace):
    return star.date_lookup(ws.raw["orders"], ws.star["dim_date"]).select("order_id", "date_id")


@query(
    "join_left_customer_geo",
    "SELECT order_id, geo_id FROM raw_orders LEFT JOIN customer_places USING (customer_id)",
)
def _(ws: Workspace):
    places = star.customer_places(ws.raw["customers"], ws.star["dim_geography"])
    return ws.raw["orders"].join(places, "customer_id", "left").select("order_id", "geo_id")


@query(
    "join_left_filtered_dim",
    """SELECT EmployeeNumber AS source_key, label_id FROM raw_employees e
       LEFT JOIN (SELECT * FROM dim_attrition_label WHERE risk_tier = 'Medium') l
         ON e.Attrition = l.attrition""",
)
def _(ws: Workspace):
    return loaded_staff(ws).select("source_key", "label_id")


@query(
    "join_cross_scalar",
    """SELECT EmployeeNumber AS source_key,
              (SELECT arg_min(date_id, full_date) FROM dim_date) AS date_id FROM raw_employees""",
)
def _(ws: Workspace):
    """One looked-up value on every row, as a scalar subquery, not a join."""
    return loaded_staff(ws).select("source_key", "date_id")


@query("join_inner_date", "SELECT order_id, full_date, day_of_week FROM dated_orders")
def _(ws: Workspace):
    return kpi.dated_orders(ws.star).select("order_id", "full_date", "day_of_week")


@query(
    "join_inner_product",
    "SELECT order_id, category_name FROM fact_orders JOIN dim_product USING (product_id)",
)
def _(ws: Workspace):
    return ws.star["fact_orders"].join(ws.star["dim_product"], "product_id").select(
        "order_id", "category_name"
    )


@query(
    "join_inner_geo",
    "SELECT order_id, state, region FROM fact_orders JOIN dim_geography USING (geo_id)",
)
def _(ws: Workspace):
    return ws.star["fact_orders"].join(ws.star["dim_geography"], "geo_id").select(
        "order_id", "state", "region"
    )


@query("join_inner_label", "SELECT source_key, attrition FROM staff")
def _(ws: Workspace):
    return kpi.labelled_staff(ws.star).select("source_key", "attrition")


@query(
    "join_star_3way",
    """SELECT source_key, department_name, job_role, attrition
       FROM staff JOIN dim_department USING (department_id)""",
)
def _(ws: Workspace):
    return kpi.staff_by_department(ws.star).select(
        "source_key", "department_name", "job_role", "attrition"
    )


# -- aggregates -------------------------------------------------------------

@query("agg_global_count", "SELECT count(*) AS n FROM fact_employees")
def _(ws: Workspace):
    return ws.star["fact_employees"].agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_global_sum_avg",
    """SELECT CAST(sum(price) AS DOUBLE) AS total, CAST(sum(price) AS DOUBLE) / count(price) AS mean,
              avg(review_score) AS mean_review FROM fact_orders""",
)
def _(ws: Workspace):
    return ws.star["fact_orders"].agg(
        F.sum("price").alias("total"),
        C.exact_avg(F.col("price")).alias("mean"),
        F.avg("review_score").alias("mean_review"),
    )


@query(
    "agg_conditional_rate",
    """SELECT order_status,
              CAST(round(CAST(100.0 * sum(CASE WHEN delivery_days > 30 THEN 1 ELSE 0 END) / count(*)
                         AS DECIMAL(18,6)), 1) AS DOUBLE) AS rate
       FROM fact_orders GROUP BY order_status""",
)
def _(ws: Workspace):
    return ws.star["fact_orders"].groupBy("order_status").agg(
        C.percent_where(F.col("delivery_days") > kpi.DELAY_DAYS).alias("rate")
    )


@query(
    "agg_conditional_counts",
    """SELECT order_status,
              CAST(sum(CASE WHEN delivery_days > 30 THEN 1 ELSE 0 END) AS BIGINT) AS late,
              CAST(sum(CASE WHEN delivery_days <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS on_time
       FROM fact_orders GROUP BY order_status""",
)
def _(ws: Workspace):
    return ws.star["fact_orders"].groupBy("order_status").agg(
        F.count_if(F.col("delivery_days") > 30).alias("late"),
        F.count_if(F.col("delivery_days") <= 30).alias("on_time"),
    )


@query(
    "agg_group_count",
    "SELECT payment_type, count(*) AS n FROM fact_orders GROUP BY payment_type",
)
def _(ws: Workspace):
    return ws.star["fact_orders"].groupBy("payment_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg_group_sum_count",
    """SELECT order_status, CAST(sum(price) AS DOUBLE) AS revenue, count(order_id) AS orders
       FROM fact_orders GROUP BY order_status""",
)
def _(ws: Workspace):
    return ws.star["fact_orders"].groupBy("order_status").agg(
        F.sum("price").alias("revenue"), F.count("order_id").alias("orders")
    )


@query(
    "agg_first_sum",
    """SELECT order_id, product_id, CAST(price AS DOUBLE) AS price,
              CAST(freight_value AS DOUBLE) AS freight_value FROM order_items""",
)
def _(ws: Workspace):
    return star.order_items(ws.raw["items"])


@query("agg_first_max", "SELECT * FROM line_payments")
def _(ws: Workspace):
    """First type and largest count per order, over several rows per order."""
    lines = ws.table("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.col("l_returnflag").alias("payment_type"),
        F.col("l_linenumber").alias("payment_installments"),
    )
    return star.order_payments(lines)


@query("agg_mean_round_even", "SELECT * FROM order_reviews")
def _(ws: Workspace):
    return star.order_reviews(ws.raw["reviews"])


@query(
    "agg_distinct",
    "SELECT DISTINCT Department AS department_name, JobRole AS job_role FROM raw_employees",
)
def _(ws: Workspace):
    return ws.raw["employees"].select(
        F.col("Department").alias("department_name"), F.col("JobRole").alias("job_role")
    ).distinct()


@query(
    "agg_median",
    """SELECT CAST(median(review_score) AS DOUBLE) AS median_review,
              count(review_score) AS reviews FROM fact_orders""",
)
def _(ws: Workspace):
    return exact_percentiles(ws.star["fact_orders"], "review_score", [0.5]).select(
        F.col("p0").alias("median_review"), F.col("n").alias("reviews")
    )


@query(
    "agg_min_max",
    "SELECT min(ds) AS first_day, max(ds) AS last_day, count(ds) AS days FROM daily",
)
def _(ws: Workspace):
    return forecast.series_range(daily_orders(ws))


@query(
    "agg_argmax",
    """SELECT order_status, first(full_date ORDER BY n DESC, full_date) AS peak_day,
              max(n) AS peak_orders
       FROM (SELECT order_status, full_date, count(*) AS n FROM dated_orders
             GROUP BY order_status, full_date) GROUP BY order_status""",
)
def _(ws: Workspace):
    """Busiest day per status; the earliest day wins a tie."""
    per_day = (
        kpi.dated_orders(ws.star)
        .groupBy("order_status", "full_date")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rank = F.struct(F.col("n"), (-F.unix_date("full_date")).alias("early"))
    return per_day.groupBy("order_status").agg(
        F.max_by("full_date", rank).alias("peak_day"), F.max("n").alias("peak_orders")
    )


@query(
    "agg_histogram",
    """SELECT CAST((age - 18) // 3 + 1 AS INTEGER) AS bin,
              CAST(18 + 3 * ((age - 18) // 3) AS DOUBLE) AS bin_start, count(*) AS n
       FROM fact_employees WHERE age BETWEEN 18 AND 59 GROUP BY ALL""",
)
def _(ws: Workspace):
    return kpi.histogram(ws.star["fact_employees"], "age", 18, 59, 14)


def _box_sql(value: str, by: str) -> str:
    return f"""
        SELECT {by}, n, q1, median, q3,
               min(v) FILTER (WHERE inside) AS whisker_low,
               max(v) FILTER (WHERE inside) AS whisker_high,
               count(*) FILTER (WHERE NOT inside) AS outliers
        FROM (SELECT *, v BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside
              FROM (SELECT {by}, CAST({value} AS DOUBLE) AS v FROM staff)
              JOIN (SELECT {by}, count({value}) AS n,
                           quantile_cont(CAST({value} AS DOUBLE), 0.25) AS q1,
                           quantile_cont(CAST({value} AS DOUBLE), 0.5) AS median,
                           quantile_cont(CAST({value} AS DOUBLE), 0.75) AS q3
                    FROM staff GROUP BY {by}) USING ({by}))
        GROUP BY {by}, n, q1, median, q3"""


def rounded_box(ws: Workspace, value: str, by: str):
    stats = kpi.box_stats(kpi.labelled_staff(ws.star), value, by)
    return stats.select(
        by,
        "n",
        *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")],
        "whisker_low",
        "whisker_high",
        "outliers",
    )


def rounded_box_sql(value: str, by: str) -> str:
    return f"""SELECT {by}, n, round(q1, 4) AS q1, round(median, 4) AS median,
                      round(q3, 4) AS q3, whisker_low, whisker_high, outliers
               FROM ({_box_sql(value, by)})"""


@query("agg_box_stats", rounded_box_sql("years_at_company", "overtime"))
def _(ws: Workspace):
    return rounded_box(ws, "years_at_company", "overtime")


@query(
    "agg_scatter_density",
    """SELECT education, performance_rating, attrition, count(*) AS n FROM staff
       GROUP BY education, performance_rating, attrition""",
)
def _(ws: Workspace):
    return kpi.grid_counts(
        kpi.labelled_staff(ws.star), "education", "performance_rating", "attrition"
    )


@query(
    "agg_share",
    """SELECT overtime, count(*) AS n,
              CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM fact_employees) AS share
       FROM fact_employees GROUP BY overtime""",
)
def _(ws: Workspace):
    return kpi.counts_with_share(ws.star["fact_employees"], "overtime")


# -- windows ----------------------------------------------------------------

@query("surrogate_key", "SELECT employee_id, source_key FROM fact_employees")
def _(ws: Workspace):
    return keys.serial_id(ws.star["fact_employees"].select("source_key"), "employee_id", "source_key")


@query(
    "keep_first",
    """SELECT customer_id, order_id, order_purchase_timestamp, order_status FROM raw_orders
       QUALIFY row_number() OVER (
           PARTITION BY customer_id ORDER BY order_purchase_timestamp, order_id) = 1""",
)
def _(ws: Workspace):
    orders = ws.raw["orders"].select(
        "customer_id", "order_id", "order_purchase_timestamp", "order_status"
    )
    return keys.keep_first(orders, "customer_id", ["order_purchase_timestamp", "order_id"])


@query(
    "share_of_total",
    """SELECT state, CAST(sum(price) AS DOUBLE) AS revenue,
              CAST(sum(price) AS DOUBLE) / CAST(sum(sum(price)) OVER () AS DOUBLE) AS share
       FROM fact_orders JOIN dim_geography USING (geo_id) GROUP BY state""",
)
def _(ws: Workspace):
    revenue = kpi.state_totals(ws.star)
    total = revenue.agg(F.sum("revenue").cast("double")).scalar()
    return revenue.withColumn("share", F.col("revenue").cast("double") / total)


@query("stratified_number", "SELECT source_key, target, rn FROM ranked_staff")
def _(ws: Workspace):
    rows = kpi.labelled_staff(ws.star).select("source_key", "attrition")
    return attrition.numbered_by_class(rows, "source_key").select("source_key", "target", "rn")


# -- sorts and limits -------------------------------------------------------

@query(
    "sort",
    """SELECT order_id, order_status, delivery_days FROM fact_orders
       ORDER BY order_status, delivery_days DESC NULLS LAST, order_id""",
)
def _(ws: Workspace):
    return ws.star["fact_orders"].select("order_id", "order_status", "delivery_days").orderBy(
        "order_status", F.desc_nulls_last("delivery_days"), "order_id"
    )


@query(
    "topk_limit",
    """SELECT product_id, CAST(sum(price) AS DOUBLE) AS revenue FROM fact_orders
       WHERE product_id IS NOT NULL GROUP BY product_id
       ORDER BY revenue DESC NULLS FIRST, product_id LIMIT 15""",
)
def _(ws: Workspace):
    ranked = kpi.revenue_by_product(ws.star).select("product_id", F.col("_revenue").alias("revenue"))
    return ranked.orderBy(F.desc_nulls_first("revenue"), "product_id").limit(15)


@query(
    "nsmallest",
    """SELECT order_id, CAST(price AS DOUBLE) AS price, delivery_days FROM fact_orders
       WHERE price IS NOT NULL ORDER BY price, order_id LIMIT 20""",
)
def _(ws: Workspace):
    priced = ws.star["fact_orders"].where(F.col("price").isNotNull())
    return priced.orderBy("price", "order_id").limit(20).select("order_id", "price", "delivery_days")


@query("first_row", "SELECT date_id FROM dim_date ORDER BY full_date LIMIT 1")
def _(ws: Workspace):
    return star.earliest_date_id(ws.star["dim_date"])


@query(
    "head_tail",
    """SELECT * FROM (SELECT 'head' AS part, ds, order_count FROM daily ORDER BY ds LIMIT 10)
       UNION ALL
       SELECT * FROM (SELECT 'tail' AS part, ds, order_count FROM daily ORDER BY ds DESC LIMIT 90)""",
)
def _(ws: Workspace):
    daily = daily_orders(ws).select("ds", "order_count")
    head = daily.orderBy("ds").limit(10).select(F.lit("head").alias("part"), "ds", "order_count")
    tail = daily.orderBy(F.desc("ds")).limit(90)
    return head.unionByName(tail.select(F.lit("tail").alias("part"), "ds", "order_count"))


@query(
    "union_history_future",
    "SELECT ds, is_future FROM baseline_days WHERE series = 'orders'",
)
def _(ws: Workspace):
    return forecast.history_and_future(daily_orders(ws))


# -- scalar functions -------------------------------------------------------

@query(
    "date_parts",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(year(d) AS INTEGER) AS year,
              CAST(quarter(d) AS INTEGER) AS quarter, CAST(month(d) AS INTEGER) AS month,
              monthname(d) AS month_name, CAST(week(d) AS INTEGER) AS week,
              dayname(d) AS day_of_week
       FROM (SELECT *, CAST(l_shipdate AS DATE) AS d FROM lineitem)""",
)
def _(ws: Workspace):
    parts = C.date_parts(F.to_date("l_shipdate"))
    return ws.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", *[e.alias(n) for n, e in parts.items()]
    )


@query(
    "to_date",
    "SELECT order_id, CAST(order_purchase_timestamp AS DATE) AS purchase_date FROM raw_orders",
)
def _(ws: Workspace):
    return ws.raw["orders"].select(
        "order_id", F.to_date("order_purchase_timestamp").alias("purchase_date")
    )


@query(
    "elapsed_days",
    """SELECT e.event_id,
              CAST(floor(epoch(e.ts - (SELECT max(o_orderdate) FROM orders)) / 86400) AS INTEGER)
                  AS days_since_last_order,
              CAST(floor(epoch(TIMESTAMP '2024-02-01 12:34:56' - e.ts) / 86400) AS INTEGER)
                  AS days_to_mark
       FROM events e""",
)
def _(ws: Workspace):
    last = ws.table("orders").agg(F.max("o_orderdate")).scalar()
    mark = F.lit("2024-02-01 12:34:56").cast("timestamp_ntz")
    return ws.table("events").select(
        "event_id",
        C.elapsed_days(last, F.col("ts")).alias("days_since_last_order"),
        C.elapsed_days(F.col("ts"), mark).alias("days_to_mark"),
    )


@query(
    "date_shift",
    """SELECT order_id, CAST(order_purchase_timestamp AS DATE) - 90 AS cutoff FROM raw_orders""",
)
def _(ws: Workspace):
    return ws.raw["orders"].select(
        "order_id", C.days_before(F.to_date("order_purchase_timestamp"), 90).alias("cutoff")
    )


@query(
    "date_series",
    """SELECT CAST(unnest(generate_series(last_day + INTERVAL 1 DAY, last_day + INTERVAL 90 DAY,
                                          INTERVAL 1 DAY)) AS DATE) AS ds
       FROM (SELECT max(ds) AS last_day FROM daily)""",
)
def _(ws: Workspace):
    return forecast.future_days(daily_orders(ws))


@query(
    "round_modes",
    """SELECT l_quantity, count(*) AS n, round(l_quantity / 4, 1) AS half_up,
              round_even(l_quantity / 4, 1) AS half_even
       FROM lineitem GROUP BY l_quantity""",
)
def _(ws: Workspace):
    counted = ws.table("lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))
    quarter = F.col("l_quantity") / 4
    return counted.select(
        "l_quantity",
        "n",
        C.round_half_up(quarter, 1).alias("half_up"),
        C.round_half_even(quarter, 1).alias("half_even"),
    )


@query(
    "arith_ratio",
    """SELECT order_id, CAST(freight_value AS DOUBLE) / (CAST(price AS DOUBLE) + 1) AS freight_ratio
       FROM fact_orders""",
)
def _(ws: Workspace):
    return ws.star["fact_orders"].select(
        "order_id", C.freight_ratio(F.col("freight_value"), F.col("price")).alias("freight_ratio")
    )


@query(
    "fill_missing",
    """SELECT order_id,
              coalesce(CAST(review_score AS DOUBLE), (SELECT median(review_score) FROM fact_orders))
                  AS review_score,
              coalesce(payment_installments, 0) AS payment_installments
       FROM fact_orders""",
)
def _(ws: Workspace):
    """Missing reviews become the exact median, missing instalments zero."""
    orders = ws.star["fact_orders"]
    median = exact_percentiles(orders, "review_score", [0.5]).select("p0").scalar()
    return orders.select(
        "order_id",
        C.fill_missing(F.col("review_score").cast("double"), median).alias("review_score"),
        C.fill_missing(F.col("payment_installments"), 0).alias("payment_installments"),
    )


@query(
    "dict_map",
    """SELECT source_key, CASE gender WHEN 'Male' THEN 1 ELSE 0 END AS gender_code,
              CASE overtime WHEN 'Yes' THEN 1 ELSE 0 END AS overtime_code,
              CASE department_name WHEN 'Human Resources' THEN 0 WHEN 'Sales' THEN 2 ELSE 1 END
                  AS department_code, 6 AS role_code
       FROM staff JOIN dim_department USING (department_id)""",
)
def _(ws: Workspace):
    """Scoring codes; roles of the given tables are all unknown, so default."""
    return attrition.encode_for_scoring(kpi.staff_by_department(ws.star)).select(
        "source_key", "gender_code", "overtime_code", "department_code", "role_code"
    )


@query(
    "case_when",
    """SELECT order_id, CASE WHEN price > 300000 THEN 'large' WHEN price > 100000 THEN 'medium'
                             ELSE 'small' END AS size FROM fact_orders""",
)
def _(ws: Workspace):
    bounds = ((300_000, "large"), (100_000, "medium"))
    return ws.star["fact_orders"].select(
        "order_id", C.tiered(F.col("price"), bounds, "small").alias("size")
    )


@query(
    "clip_lower",
    "SELECT order_id, greatest(CAST(delivery_days AS DOUBLE), 0) AS days FROM fact_orders "
    "WHERE delivery_days IS NOT NULL",
)
def _(ws: Workspace):
    timed = ws.star["fact_orders"].where(F.col("delivery_days").isNotNull())
    return timed.select("order_id", C.clip_lower(F.col("delivery_days").cast("double")).alias("days"))


@query(
    "cast",
    """SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(price AS DOUBLE) AS price,
              TRY_CAST(payment_type AS INTEGER) AS bad_number,
              TRY_CAST(payment_type[1:1] AS INTEGER) AS priority
       FROM fact_orders""",
)
def _(ws: Workspace):
    return ws.star["fact_orders"].select(
        F.col("order_id").cast("string").alias("order_id"),
        F.col("price").cast("double").alias("price"),
        C.to_int_or_null(F.col("payment_type")).alias("bad_number"),
        C.to_int_or_null(F.substring("payment_type", 1, 1)).alias("priority"),
    )


@query(
    "period_label",
    """SELECT strftime(order_purchase_timestamp, '%Y-%m') AS period, count(*) AS n
       FROM raw_orders GROUP BY period""",
)
def _(ws: Workspace):
    day = F.col("order_purchase_timestamp")
    return ws.raw["orders"].groupBy(
        C.period_label(F.year(day), F.month(day)).alias("period")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "strip_fences",
    """SELECT doc_id, trim(regexp_replace(text, '```(sql)?', '', 'g'),
                           ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS clean
       FROM documents""",
)
def _(ws: Workspace):
    return ws.table("documents").select("doc_id", C.strip_fences(F.col("text")).alias("clean"))


@query(
    "is_blank",
    """SELECT role, count(*) AS n,
              count(*) FILTER (WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '') AS blank
       FROM conversations GROUP BY role""",
)
def _(ws: Workspace):
    return ws.table("conversations").groupBy("role").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(C.is_blank(F.col("text"))).alias("blank")
    )


_WORDS = ("drop", "delete", "insert", "update", "alter", "truncate", "create", "grant")
_ANY_WORD = " OR ".join(f"contains(lower(%s), '{w}')" for w in _WORDS)


@query(
    "contains_any",
    f"""SELECT doc_id, {_ANY_WORD.replace('%s', 'text')} AS blocked,
               contains(lower(text), 'the') OR contains(lower(text), 'der') AS common
        FROM documents""",
)
def _(ws: Workspace):
    text = F.col("text")
    return ws.table("documents").select(
        "doc_id",
        C.contains_any(text, guard.BLOCKED_WORDS).alias("blocked"),
        C.contains_any(text, ("the", "der")).alias("common"),
    )


@query(
    "flag_unsafe_sql",
    f"SELECT log_id, {_ANY_WORD.replace('%s', 'sql_text')} AS blocked FROM query_log",
)
def _(ws: Workspace):
    return guard.flag_unsafe(query_log(ws), "sql_text").select("log_id", "blocked")


@query(
    "clean_sql_text",
    """SELECT log_id, trim(regexp_replace(sql_text, '```(sql)?', '', 'g'), ' ' || chr(10)) AS clean
       FROM query_log""",
)
def _(ws: Workspace):
    return guard.clean_sql(query_log(ws), "sql_text").select("log_id", "clean")
