"""SQL definitions of the raw and star tables over the given tables.

They restate the data model independently of the DataFrame code: each named
query's SQL selects from these, and only the ones it mentions are attached.
"""

from __future__ import annotations

import re

TABLES: dict[str, str] = {
    "raw_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                    ELSE 'processing' END AS order_status,
               o_orderdate AS order_purchase_timestamp,
               delivered AS order_delivered_customer_date
        FROM orders LEFT JOIN (
            SELECT l_orderkey, max(l_shipdate) AS delivered FROM lineitem GROUP BY l_orderkey
        ) ON o_orderkey = l_orderkey""",
    "raw_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
               CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)), 2)
                    AS DECIMAL(12,2)) AS freight_value
        FROM lineitem""",
    "raw_payments": """
        SELECT l_orderkey AS order_id, 1 AS payment_sequential, o_orderpriority AS payment_type,
               max(l_linenumber) AS payment_installments
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        GROUP BY l_orderkey, o_orderpriority""",
    "line_payments": """
        SELECT l_orderkey AS order_id,
               first(l_returnflag ORDER BY l_linenumber, l_returnflag)
                   FILTER (WHERE l_returnflag IS NOT NULL) AS payment_type,
               max(l_linenumber) AS payment_installments
        FROM lineitem GROUP BY l_orderkey""",
    "raw_reviews": """
        SELECT l_orderkey AS order_id, CAST(ceil(l_quantity / 10) AS INTEGER) AS review_score
        FROM lineitem""",
    "raw_customers": """
        SELECT c_custkey AS customer_id, n_name AS customer_city, n_name AS customer_state
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "raw_regions": """
        SELECT n_name AS state, r_name AS region
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "raw_products": """
        SELECT p_partkey AS product_id, p_type AS product_category_name,
               p_size * 25 + 5 AS product_weight_g
        FROM part""",
    "raw_translation": """
        SELECT DISTINCT p_type AS product_category_name,
               upper(p_type[1:1]) || lower(p_type[2:]) AS product_category_name_english
        FROM part""",
    "raw_employees": """
        SELECT c_custkey AS EmployeeNumber, c_mktsegment AS Department, n_name AS JobRole,
               CASE WHEN last_day < today - 365 THEN 'Yes' ELSE 'No' END AS Attrition,
               CASE WHEN c_custkey % 2 = 1 THEN 'Male' ELSE 'Female' END AS Gender,
               CASE WHEN coalesce(urgent, 0) >= 3 THEN 'Yes' ELSE 'No' END AS OverTime,
               CAST(18 + c_custkey % 43 AS INTEGER) AS Age,
               CAST(c_acctbal AS DECIMAL(10,2)) AS MonthlyIncome,
               CAST(1 + coalesce(f_orders, 0) % 4 AS INTEGER) AS JobSatisfaction,
               CAST(floor((today - first_day) / 365) AS INTEGER) AS YearsAtCompany,
               CAST(1 + c_nationkey AS INTEGER) AS DistanceFromHome,
               CAST(1 + n_regionkey AS INTEGER) AS Education,
               CAST(1 + coalesce(o_orders, 0) % 4 AS INTEGER) AS EnvironmentSatisfaction,
               CASE WHEN coalesce(n_orders, 0) > 10 THEN 4 ELSE 3 END AS PerformanceRating
        FROM customer
        LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (
            SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS first_day,
                   CAST(max(o_orderdate) AS DATE) AS last_day, count(*) AS n_orders,
                   count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent,
                   count(*) FILTER (WHERE o_orderstatus = 'F') AS f_orders,
                   count(*) FILTER (WHERE o_orderstatus = 'O') AS o_orders
            FROM orders GROUP BY o_custkey
        ) ON c_custkey = o_custkey
        CROSS JOIN (SELECT CAST(max(o_orderdate) AS DATE) AS today FROM orders)""",
    "dim_date": """
        SELECT CAST(row_number() OVER (ORDER BY full_date) AS INTEGER) AS date_id, full_date,
               CAST(year(full_date) AS INTEGER) AS year,
               CAST(quarter(full_date) AS INTEGER) AS quarter,
               CAST(month(full_date) AS INTEGER) AS month, monthname(full_date) AS month_name,
               CAST(week(full_date) AS INTEGER) AS week, dayname(full_date) AS day_of_week
        FROM (SELECT DISTINCT CAST(order_purchase_timestamp AS DATE) AS full_date
              FROM raw_orders WHERE order_purchase_timestamp IS NOT NULL)""",
    "dim_customer": """
        SELECT customer_id, customer_city AS city, customer_state AS state,
               CAST(NULL AS VARCHAR) AS rfm_segment
        FROM raw_customers
        QUALIFY row_number() OVER (
            PARTITION BY customer_id ORDER BY customer_city, customer_state) = 1""",
    "dim_product": """
        SELECT product_id, product_category_name_english AS category_name,
               product_category_name_english AS product_name,
               CAST(CAST(product_weight_g AS DECIMAL(12,0)) * CAST(0.001 AS DECIMAL(4,3))
                    AS DECIMAL(8,2)) AS weight_kg
        FROM raw_products LEFT JOIN raw_translation USING (product_category_name)
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY category_name, weight_kg) = 1""",
    "dim_geography": """
        SELECT CAST(row_number() OVER (ORDER BY state, city) AS INTEGER) AS geo_id, city, state,
               coalesce(region, 'Other') AS region
        FROM (SELECT DISTINCT customer_city AS city, customer_state AS state FROM raw_customers)
        LEFT JOIN raw_regions USING (state)""",
    "dim_department": """
        SELECT CAST(row_number() OVER (ORDER BY department_name, job_role) AS INTEGER)
                   AS department_id, department_name, job_role
        FROM (SELECT DISTINCT Department AS department_name, JobRole AS job_role
              FROM raw_employees)""",
    "dim_attrition_label": """
        SELECT * FROM (VALUES (1, 'Yes', 'High'), (2, 'Yes', 'Medium'), (3, 'Yes', 'Low'),
                              (4, 'No', 'High'), (5, 'No', 'Medium'), (6, 'No', 'Low'))
            AS t(label_id, attrition, risk_tier)""",
    "order_items": """
        SELECT order_id,
               first(product_id ORDER BY order_item_id, product_id)
                   FILTER (WHERE product_id IS NOT NULL) AS product_id,
               coalesce(sum(price), 0) AS price,
               coalesce(sum(freight_value), 0) AS freight_value
        FROM raw_items GROUP BY order_id""",
    "order_payments": """
        SELECT order_id,
               first(payment_type ORDER BY payment_sequential, payment_type)
                   FILTER (WHERE payment_type IS NOT NULL) AS payment_type,
               max(payment_installments) AS payment_installments
        FROM raw_payments GROUP BY order_id""",
    "order_reviews": """
        SELECT order_id, CAST(round_even(avg(review_score), 0) AS INTEGER) AS review_score
        FROM raw_reviews GROUP BY order_id""",
    "customer_places": """
        SELECT customer_id, geo_id
        FROM raw_customers LEFT JOIN dim_geography
          ON customer_city IS NOT DISTINCT FROM city AND customer_state IS NOT DISTINCT FROM state
        QUALIFY row_number() OVER (
            PARTITION BY customer_id ORDER BY customer_city, customer_state) = 1""",
    "fact_orders": """
        SELECT o.order_id, o.customer_id, product_id, date_id, geo_id, order_status, payment_type,
               payment_installments, price, freight_value, review_score,
               CAST(floor(epoch(order_delivered_customer_date - order_purchase_timestamp) / 86400)
                    AS INTEGER) AS delivery_days
        FROM (SELECT * FROM raw_orders
              QUALIFY row_number() OVER (
                  PARTITION BY order_id
                  ORDER BY order_purchase_timestamp, customer_id, order_status) = 1) o
        LEFT JOIN order_items USING (order_id)
        LEFT JOIN order_payments USING (order_id)
        LEFT JOIN order_reviews USING (order_id)
        LEFT JOIN dim_date ON CAST(order_purchase_timestamp AS DATE) = full_date
        LEFT JOIN customer_places p ON o.customer_id = p.customer_id""",
    "fact_employees": """
        SELECT row_number() OVER (ORDER BY EmployeeNumber) AS employee_id,
               EmployeeNumber AS source_key, department_id,
               (SELECT arg_min(date_id, full_date) FROM dim_date) AS date_id, label_id,
               Age AS age, Gender AS gender, MonthlyIncome AS monthly_income,
               JobSatisfaction AS job_satisfaction, YearsAtCompany AS years_at_company,
               OverTime AS overtime, DistanceFromHome AS distance_from_home,
               Education AS education, EnvironmentSatisfaction AS environment_satisfaction,
               PerformanceRating AS performance_rating
        FROM raw_employees e
        LEFT JOIN dim_department ON Department = department_name AND JobRole = job_role
        LEFT JOIN (SELECT * FROM dim_attrition_label WHERE risk_tier = 'Medium') l
          ON e.Attrition = l.attrition""",
    "dated_orders": "SELECT * FROM fact_orders JOIN dim_date USING (date_id)",
    "staff": """
        SELECT * FROM fact_employees JOIN dim_attrition_label USING (label_id)""",
    "category_revenue": """
        SELECT category_name, sum(price) AS revenue, count(order_id) AS orders
        FROM fact_orders JOIN dim_product USING (product_id)
        WHERE category_name IS NOT NULL GROUP BY category_name""",
    "query_log": """
        SELECT o_orderkey AS log_id,
               '```sql' || chr(10)
               || CASE WHEN o_orderkey % 7 = 0 THEN 'DROP TABLE t' || o_orderkey
                       WHEN o_orderkey % 11 = 0
                           THEN 'SELECT created_at FROM t WHERE id = ' || o_orderkey
                       ELSE 'SELECT price FROM t WHERE id = ' || o_orderkey END
               || chr(10) || '```' AS sql_text
        FROM orders""",
    "ranked_staff": """
        SELECT s.*, CASE WHEN attrition = 'Yes' THEN 1 ELSE 0 END AS target,
               row_number() OVER (
                   PARTITION BY attrition = 'Yes'
                   ORDER BY md5('42:' || source_key), source_key) AS rn,
               count(*) OVER (PARTITION BY attrition = 'Yes') AS class_size
        FROM staff s""",
    "split_staff": """
        SELECT *, rn <= round(class_size * 0.2) AS is_test FROM ranked_staff""",
    "score_table": """
        SELECT *, CASE WHEN probability > 0.5 THEN 1 ELSE 0 END AS prediction
        FROM (SELECT source_key, overtime, monthly_income,
                     CASE WHEN attrition = 'Yes' THEN 1 ELSE 0 END AS target,
                     (CAST((source_key * 37) % 1000 AS DOUBLE)
                      + CASE WHEN attrition = 'Yes' THEN 300 ELSE 0 END) / 1300.0 AS probability
              FROM staff)""",
    "daily": """
        SELECT full_date AS ds, count(order_id) AS order_count, sum(price) AS revenue
        FROM dated_orders WHERE order_status = 'delivered' GROUP BY full_date""",
    "series": """
        SELECT 'orders' AS series, ds, CAST(order_count AS DOUBLE) AS y FROM daily
        UNION ALL
        SELECT 'revenue', ds, CAST(revenue AS DOUBLE) FROM daily WHERE revenue IS NOT NULL""",
    "line": """
        SELECT series, first_day, last_day, regr_slope(y, t) AS slope,
               regr_intercept(y, t) AS base
        FROM (SELECT *, CAST(ds - first_day AS DOUBLE) AS t FROM (
                SELECT *, min(ds) OVER (PARTITION BY series) AS first_day,
                       max(ds) OVER (PARTITION BY series) AS last_day FROM series))
        GROUP BY series, first_day, last_day""",
    "weekday_index": """
        SELECT series, dayofweek(ds) AS wd,
               avg(y / nullif(base + slope * (ds - first_day), 0)) AS idx
        FROM series JOIN line USING (series) GROUP BY series, wd""",
    "baseline_days": """
        SELECT series, ds, false AS is_future, y FROM series
        UNION ALL
        SELECT series, CAST(unnest(generate_series(last_day + INTERVAL 1 DAY,
                                                   last_day + INTERVAL 90 DAY,
                                                   INTERVAL 1 DAY)) AS DATE), true, NULL
        FROM line""",
    "baseline": """
        SELECT *, yhat - 1.2815515655446004 * sd AS yhat_lower,
               yhat + 1.2815515655446004 * sd AS yhat_upper
        FROM (SELECT *, stddev_pop(y - yhat) OVER (PARTITION BY series) AS sd
              FROM (SELECT series, ds, is_future, y,
                           (base + slope * (ds - first_day)) * coalesce(idx, 1.0) AS yhat
                    FROM baseline_days JOIN line USING (series)
                    LEFT JOIN weekday_index w
                      ON w.series = baseline_days.series AND w.wd = dayofweek(ds)))""",
    "anomaly_base": """
        SELECT order_id, CAST(price AS DOUBLE) AS price,
               CAST(freight_value AS DOUBLE) AS freight_value, payment_installments,
               CAST(review_score AS DOUBLE) AS review_score, delivery_days, day_of_week, month
        FROM dated_orders
        WHERE price IS NOT NULL AND delivery_days IS NOT NULL AND delivery_days > 0""",
    "anomaly_features": """
        SELECT order_id, price, coalesce(freight_value, 0) AS freight_value,
               coalesce(freight_value / (price + 1), 0) AS freight_ratio,
               coalesce(payment_installments, 0) AS payment_installments,
               coalesce(review_score, (SELECT median(review_score) FROM anomaly_base), 0)
                   AS review_score,
               delivery_days,
               CASE day_of_week WHEN 'Monday' THEN 0 WHEN 'Tuesday' THEN 1 WHEN 'Wednesday' THEN 2
                    WHEN 'Thursday' THEN 3 WHEN 'Friday' THEN 4 WHEN 'Saturday' THEN 5
                    WHEN 'Sunday' THEN 6 ELSE 0 END AS dow_num,
               month
        FROM anomaly_base""",
}


def with_definitions(sql: str) -> str:
    """Prefix ``sql`` with the definitions it needs, in dependency order."""

    def mentioned(text: str) -> set[str]:
        return {name for name in TABLES if re.search(rf"\b{name}\b", text)}

    needed = mentioned(sql)
    pending = list(needed)
    while pending:
        fresh = mentioned(TABLES[pending.pop()]) - needed
        needed |= fresh
        pending += fresh
    if not needed:
        return sql
    parts = [f"{name} AS ({TABLES[name]})" for name in TABLES if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + sql
