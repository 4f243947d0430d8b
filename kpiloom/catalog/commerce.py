"""Dashboard KPIs, business questions and guarded SQL as named queries."""

from __future__ import annotations

from functools import partial

from kpiloom.catalog.registry import Workspace, query
from kpiloom.catalog.relational import DAYS_ABOVE, PRICE_ABOVE, rounded_box, rounded_box_sql
from kpiloom.plans import guard, kpi, questions

# The given orders span 1995 to 2001.
YEAR = 1998


def _rate(condition: str) -> str:
    return (
        f"CAST((2000 * count(*) FILTER ({condition}) + count(*)) // (2 * count(*)) AS DOUBLE) / 10"
    )


def _share_sql(key: str) -> str:
    return f"""SELECT {key}, count(*) AS n,
                      CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM fact_orders) AS share
               FROM fact_orders GROUP BY {key} ORDER BY n DESC, {key}"""


def _star_query(name: str, sql: str, build) -> None:
    query(name, sql)(lambda ws: build(ws.star))


_DEPARTMENT_RATES = f"""
    SELECT department_name, {_rate("attrition = 'Yes'")} AS rate
    FROM staff JOIN dim_department USING (department_id) GROUP BY department_name"""
_TOP = """
    SELECT category_name, CAST(revenue AS DOUBLE) AS revenue{extra} FROM category_revenue
    ORDER BY category_revenue.revenue DESC NULLS FIRST, category_name LIMIT {n}"""

# -- overview and commerce --------------------------------------------------

_star_query("kpi_total_orders", "SELECT count(*) AS total_orders FROM fact_orders", kpi.total_orders)
_star_query("kpi_gmv", "SELECT CAST(sum(price) AS DOUBLE) AS gmv FROM fact_orders", kpi.gmv)
_star_query(
    "kpi_attrition_rate",
    f"""SELECT {_rate("attrition = 'Yes'")} AS attrition_rate FROM staff""",
    kpi.attrition_rate,
)
_star_query(
    "kpi_flagged_orders",
    f"""SELECT count(*) AS flagged_orders FROM dated_orders
        WHERE price > {PRICE_ABOVE} AND delivery_days > {DAYS_ABOVE}""",
    partial(kpi.flagged_orders, price_above=PRICE_ABOVE, days_above=DAYS_ABOVE),
)
_star_query(
    "kpi_avg_review",
    """SELECT CAST(floor(200 * sum(review_score) / (2 * count(review_score)) + 0.5) AS DOUBLE) / 100 AS avg_review
       FROM fact_orders WHERE review_score IS NOT NULL""",
    kpi.avg_review,
)
_star_query(
    "revenue_by_month",
    """SELECT year, month, CAST(sum(price) AS DOUBLE) AS revenue,
              year || '-' || lpad(CAST(month AS VARCHAR), 2, '0') AS period
       FROM dated_orders WHERE order_status = 'delivered'
       GROUP BY year, month ORDER BY year, month""",
    kpi.revenue_by_month,
)
_star_query("orders_by_status", _share_sql("order_status"), kpi.orders_by_status)
_star_query("attrition_by_department", _DEPARTMENT_RATES, kpi.attrition_by_department)
_star_query(
    "kpi_avg_order_value",
    "SELECT CAST(sum(price) AS DOUBLE) / count(price) AS avg_order_value FROM fact_orders",
    kpi.avg_order_value,
)
_star_query(
    "kpi_delay_rate",
    f"""SELECT {_rate("delivery_days > 30")} AS delay_rate FROM fact_orders
        WHERE delivery_days IS NOT NULL""",
    kpi.delay_rate,
)
_star_query("revenue_by_category", _TOP.format(extra=", orders", n=15), kpi.revenue_by_category)
_star_query("payment_mix", _share_sql("payment_type"), kpi.payment_mix)
_star_query(
    "delivery_histogram",
    """SELECT CAST((delivery_days - 1) // 2 + 1 AS INTEGER) AS bin,
              CAST(1 + 2 * ((delivery_days - 1) // 2) AS DOUBLE) AS bin_start, count(*) AS n
       FROM fact_orders WHERE delivery_days BETWEEN 1 AND 60 GROUP BY ALL ORDER BY bin""",
    kpi.delivery_histogram,
)
_star_query(
    "revenue_by_state",
    """SELECT state, CAST(sum(price) AS DOUBLE) AS revenue
       FROM fact_orders JOIN dim_geography USING (geo_id)
       GROUP BY state ORDER BY revenue DESC NULLS FIRST, state""",
    kpi.revenue_by_state,
)

# -- workforce --------------------------------------------------------------

_star_query(
    "kpi_total_employees",
    "SELECT count(*) AS total_employees FROM fact_employees",
    kpi.total_employees,
)
_star_query(
    "kpi_attrition_count",
    "SELECT count(*) AS attrition_count FROM staff WHERE attrition = 'Yes'",
    kpi.attrition_count,
)
_star_query(
    "kpi_avg_income",
    """SELECT CAST(sum(monthly_income) AS DOUBLE) / count(monthly_income) AS avg_income
       FROM fact_employees""",
    kpi.avg_income,
)
_star_query(
    "kpi_avg_tenure",
    """SELECT CAST(sum(years_at_company) AS DOUBLE) / count(years_at_company) AS avg_tenure
       FROM fact_employees""",
    kpi.avg_tenure,
)
_star_query(
    "attrition_by_overtime",
    """SELECT overtime, CAST(sum(CASE WHEN attrition = 'Yes' THEN 1 ELSE 0 END) AS BIGINT) AS left_co,
              CAST(sum(CASE WHEN attrition = 'No' THEN 1 ELSE 0 END) AS BIGINT) AS stayed
       FROM staff GROUP BY overtime""",
    kpi.attrition_by_overtime,
)
query("income_by_attrition", rounded_box_sql("monthly_income", "attrition"))(
    lambda ws: rounded_box(ws, "monthly_income", "attrition")
)
_star_query(
    "satisfaction_grid",
    """SELECT job_satisfaction, environment_satisfaction, attrition, count(*) AS n
       FROM staff GROUP BY job_satisfaction, environment_satisfaction, attrition""",
    kpi.satisfaction_grid,
)
_star_query(
    "insights_summary",
    f"""SELECT count(*) AS total_orders, CAST(round(sum(price), 2) AS DOUBLE) AS gmv,
               (SELECT {_rate("attrition = 'Yes'")} FROM staff) AS attrition_rate_pct
        FROM fact_orders""",
    kpi.insights_summary,
)

# -- questions --------------------------------------------------------------

_star_query("ask_top5_categories", _TOP.format(extra="", n=5), questions.top5_categories)
_star_query(
    "ask_top_attrition_department",
    f"""SELECT department_name, {_rate("attrition = 'Yes'")} AS rate
        FROM staff JOIN dim_department USING (department_id) GROUP BY department_name
        ORDER BY count(*) FILTER (attrition = 'Yes') / count(*) DESC, department_name LIMIT 1""",
    questions.top_attrition_department,
)
_star_query(
    "ask_delivery_by_state",
    """SELECT state, avg(delivery_days) AS avg_delivery_days
       FROM fact_orders JOIN dim_geography USING (geo_id) GROUP BY state""",
    questions.delivery_by_state,
)
_star_query(
    "ask_delivered_in_year",
    f"""SELECT count(*) AS delivered_orders FROM dated_orders
        WHERE order_status = 'delivered' AND year = {YEAR}""",
    partial(questions.delivered_in_year, year=YEAR),
)
_star_query(
    "ask_state_most_customers",
    """SELECT state, count(*) AS customers FROM dim_customer GROUP BY state
       ORDER BY customers DESC, state LIMIT 1""",
    questions.state_most_customers,
)
_star_query(
    "ask_top10_customers",
    """SELECT customer_id, CAST(sum(price) AS DOUBLE) AS order_value FROM fact_orders
       GROUP BY customer_id ORDER BY sum(price) DESC NULLS LAST, customer_id LIMIT 10""",
    questions.top10_customers,
)
_star_query(
    "ask_top_category_quarter",
    """SELECT category_name, CAST(sum(price) AS DOUBLE) AS revenue
       FROM dated_orders JOIN dim_product USING (product_id)
       WHERE year = 1997 AND quarter = 4 AND category_name IS NOT NULL
       GROUP BY category_name ORDER BY sum(price) DESC NULLS LAST, category_name LIMIT 1""",
    partial(questions.top_category_quarter, year=1997),
)

# -- guarded SQL ------------------------------------------------------------


@query(
    "guarded_sql",
    """SELECT category_name, CAST(revenue AS DOUBLE) AS revenue FROM category_revenue
       ORDER BY category_revenue.revenue DESC, category_name LIMIT 5""",
)
def _(ws: Workspace):
    """A question's SQL text, checked and run on the star views."""
    text = guard.QUESTION_SQL["What are the top 5 product categories by total revenue?"]
    return guard.guarded_sql(ws.spark, text, ws.star)


def _outcome_sql() -> str:
    """Each statement's own row count, counted by the other engine."""
    lines = []
    for question, sql in guard.QUESTION_SQL.items():
        shown = " ".join(sql.split()).replace("'", "''")
        lines.append(
            f"SELECT '{question}' AS question, '{shown}' AS sql, "
            f"(SELECT count(*) FROM ({sql})) AS row_count, CAST(NULL AS VARCHAR) AS error"
        )
    refused = "unsafe SQL: the statement contains a blocked word"
    lines.append(f"SELECT 'Remove the old orders', '', 0, '{refused}'")
    lines.append("SELECT ' ', '', 0, 'question cannot be empty'")
    return " UNION ALL ".join(lines)


@query("query_outcomes", _outcome_sql())
def _(ws: Workspace):
    """Every example question plus one refused statement and one blank question."""
    statements = {
        **guard.QUESTION_SQL,
        "Remove the old orders": "DELETE FROM fact_orders",
        " ": "SELECT 1",
    }
    return guard.query_outcomes(ws.spark, ws.star, statements)
