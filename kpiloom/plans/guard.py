"""Guarded read-only SQL over the star views, and the outcome report."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.functions import columns as C
from kpiloom.functions.lookups import BLOCKED_WORDS
from kpiloom.sources.readers import register_views

_BLOCKED = re.compile("|".join(map(re.escape, BLOCKED_WORDS)), re.IGNORECASE)

# The example questions, and the SQL each resolves to on the star views.
QUESTION_SQL = {
    "What are the top 5 product categories by total revenue?": """
        SELECT dp.category_name, SUM(fo.price) AS revenue
        FROM fact_orders fo JOIN dim_product dp ON fo.product_id = dp.product_id
        WHERE dp.category_name IS NOT NULL
        GROUP BY dp.category_name ORDER BY revenue DESC, dp.category_name LIMIT 5""",
    "Which department has the highest attrition rate?": """
        SELECT dd.department_name,
               AVG(CASE WHEN dal.attrition = 'Yes' THEN 100.0 ELSE 0.0 END) AS rate
        FROM fact_employees fe
        JOIN dim_department dd ON fe.department_id = dd.department_id
        JOIN dim_attrition_label dal ON fe.label_id = dal.label_id
        GROUP BY dd.department_name ORDER BY rate DESC, dd.department_name LIMIT 1""",
    "What is the average delivery time by state?": """
        SELECT dg.state, AVG(fo.delivery_days) AS avg_delivery_days
        FROM fact_orders fo JOIN dim_geography dg ON fo.geo_id = dg.geo_id
        GROUP BY dg.state ORDER BY dg.state""",
    "How many orders were delivered in 2018?": """
        SELECT COUNT(*) AS delivered_orders
        FROM fact_orders fo JOIN dim_date dd ON fo.date_id = dd.date_id
        WHERE fo.order_status = 'delivered' AND dd.year = 2018""",
    "Which state has the most customers?": """
        SELECT dc.state, COUNT(*) AS customers
        FROM dim_customer dc GROUP BY dc.state ORDER BY customers DESC, dc.state LIMIT 1""",
    "What are the top 10 customers by order value?": """
        SELECT fo.customer_id, SUM(fo.price) AS order_value
        FROM fact_orders fo GROUP BY fo.customer_id
        ORDER BY order_value DESC NULLS LAST, fo.customer_id LIMIT 10""",
}


def blocked_word(sql: str) -> str | None:
    """The first blocked word inside a statement, also inside other words (``created_at``)."""
    found = _BLOCKED.search(sql)
    return found[0].lower() if found else None


def flag_unsafe(log: DataFrame, column: str) -> DataFrame:
    """The same test over a column of a query log."""
    return log.withColumn("blocked", C.contains_any(F.col(column), BLOCKED_WORDS))


def clean_sql(log: DataFrame, column: str) -> DataFrame:
    return log.withColumn("clean", C.strip_fences(F.col(column)))


# What a read-only statement may stand on: nothing at all, values written out, and the views.
_LEAVES = {"OneRowRelation", "UnresolvedInlineTable", "LocalRelation"}
_NAMED = "UnresolvedRelation"
# Nodes of the parsed statement that only arrange rows; anything else is refused.
_SHAPES = {
    "Project", "Filter", "Join", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Distinct", "Union",
    "Intersect", "Except", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedHaving", "UnresolvedWith", "Window",
    "WithWindowDefinition", "Generate", "LateralJoin", "Pivot", "Unpivot", "Deduplicate", "Tail", "UnresolvedHint",
}


def _items(sequence):
    return [sequence.apply(i) for i in range(sequence.size())]


def _refusal(plan, views: set[str], known: frozenset[str] = frozenset()) -> str | None:
    """Why a parsed plan is not a read of the views alone, or None. ``known`` are names it defines itself."""
    kind = plan.nodeName() if plan.getClass().getSimpleName() == "" else plan.getClass().getSimpleName()
    if kind == "UnresolvedWith":
        # each definition sees the earlier ones; in a recursive one a name may stand on itself
        for pair in _items(plan.cteRelations()):
            name = pair._1().lower()
            why = _refusal(pair._2(), views, known | ({name} if plan.allowRecursion() else frozenset()))
            if why is not None:
                return why
            known = known | {name}
        return _refusal(plan.child(), views, known)
    children, nested = _items(plan.children()), _items(plan.subqueries())
    if kind == _NAMED:
        name = ".".join(_items(plan.multipartIdentifier())).lower()
        if name not in views and name not in known:
            return f"{name} is none of the views"
    elif not children and kind not in _LEAVES:
        return f"{kind} is not a read of the views"
    elif children and kind not in _SHAPES:
        return f"{kind} does not only arrange rows"
    for below in [*children, *nested]:
        why = _refusal(below, views, known)
        if why is not None:
            return why
    return None


def unsafe_reason(spark: SparkSession, sql: str, views: Iterable[str]) -> str | None:
    """Why a statement may not run, or None: decided on its parsed plan, before anything is run or resolved.

    It must be one query whose sources are the views (and names it defines itself, and
    rows written out): no commands, no files by path, no other tables, no table functions,
    no scripts, also not inside subqueries. A statement that does not parse has no reason
    here; running it will say what is wrong.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:
        return None
    why = _refusal(plan, {v.lower() for v in views})
    if why is None and _UNSAFE_CALL.search(sql):
        why = "it calls a function that reaches outside the rows"
    return why


# Functions that run code by name, or tell of the session.
_UNSAFE_CALL = re.compile(r"\b(?:reflect|try_reflect|java_method|current_catalog|current_database|current_schema|input_file_name|version)\s*\(", re.IGNORECASE)


def guarded_sql(
    spark: SparkSession, sql: str, star: Mapping[str, DataFrame]
) -> DataFrame:
    """Run a statement on the star views and return all of its rows.

    A blocked word refuses it, as the word test has it, also inside a literal. What
    passes is parsed, and refused unless it is one query over the views alone
    (``unsafe_reason``). How many rows come back is for the statement to say.
    """
    if blocked_word(sql) is not None:
        raise ValueError("unsafe SQL: the statement contains a blocked word")
    why = unsafe_reason(spark, sql, star)
    if why is not None:
        raise ValueError(f"unsafe SQL: {why}")
    register_views(star)
    return spark.sql(sql)


def query_outcomes(
    spark: SparkSession, star: Mapping[str, DataFrame], statements: Mapping[str, str]
) -> DataFrame:
    """One envelope row per question: sql, row_count, error.

    Each statement runs once and only its row count comes back, so a
    statement that fails at run time is reported instead of stopping the rest.
    """
    report = []
    for question, sql in statements.items():
        try:
            if not question.strip():
                raise ValueError("question cannot be empty")
            rows = guarded_sql(spark, sql, star).agg(F.count(F.lit(1))).first()[0]
            report.append((question, " ".join(sql.split()), rows, None))
        except Exception as failure:  # any failure belongs in the report
            report.append((question, "", 0, str(failure).splitlines()[0]))
    return spark.createDataFrame(
        report, "question STRING, sql STRING, row_count BIGINT, error STRING"
    )
