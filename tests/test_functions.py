import pytest
from pyspark.sql import functions as F

from kpiloom.functions import columns as C
from kpiloom.plans import guard


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("start", "end", "days"),
    [
        ("2020-01-01 23:00:00", "2020-01-03 01:00:00", 1),
        ("2020-01-03 01:00:00", "2020-01-02 23:00:00", -1),
        ("2020-01-01 00:00:00", "2020-01-02 00:00:00", 1),
        ("2020-01-01 00:00:00.000001", "2020-01-02 00:00:00", 0),
        ("2020-01-01 00:00:00.5", "2020-01-01 00:00:00", -1),
    ],
)
def test_elapsed_days(spark, start, end, days):
    a, b = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    assert one(spark, C.elapsed_days(a, b)) == days


def test_rounding(spark):
    assert float(one(spark, C.round_half_up(F.lit(2.5), 0))) == 3.0
    assert float(one(spark, C.percent_of(F.lit(1_234_999_997), F.lit(10**10)))) == 12.3
    assert float(one(spark, C.percent_of(F.lit(1_235_000_000), F.lit(10**10)))) == 12.4
    assert one(spark, C.percent_of(F.lit(1), F.lit(0))) is None
    assert one(spark, C.round_half_even(F.lit(2.5), 0)) == 2.0
    assert float(one(spark, C.grams_to_kg(F.lit(1005.0)))) == 1.01


def test_rate_of_nothing_is_null(spark):
    empty = spark.range(0).agg(C.percent_where(F.col("id") > 1).alias("r"))
    assert empty.first()["r"] is None


def test_period_and_tiers(spark):
    assert one(spark, C.period_label(F.lit(2018), F.lit(3))) == "2018-03"
    bounds = ((0.6, "High"), (0.35, "Medium"))
    got = [one(spark, C.tiered(F.lit(p), bounds, "Low")) for p in (0.35, 0.36, 0.60, 0.61)]
    assert got == ["Low", "Medium", "Medium", "High"]


def test_map_values(spark):
    assert one(spark, C.map_values(F.lit("x"), {"a": 1}, 7)) == 7
    assert one(spark, C.map_values(F.lit(None).cast("string"), {"a": 1}, 7)) == 7


TEXTS = ["```sql\nSELECT 1\n```", "   SELECT 2\xa0", "```\n```", " \t\n", "a```sqlb", ""]


def test_text_helpers_match_python(spark):
    import re

    df = spark.createDataFrame([(t,) for t in TEXTS], "t STRING")
    got = df.select(C.strip_fences(F.col("t")).alias("c"), C.is_blank(F.col("t")).alias("b")).collect()
    assert [r.c for r in got] == [re.sub(r"```sql|```", "", t.strip()).strip() for t in TEXTS]
    assert [r.b for r in got] == [not t.strip() for t in TEXTS]


@pytest.mark.parametrize(
    ("sql", "safe"),
    [
        ("SELECT 1", True),
        ("select created_at from t", False),
        ("DROP TABLE t", False),
        ("SELECT updated FROM t", False),
        ("SELECT 'Granted'", False),
    ],
)
def test_guard_words(spark, sql, safe):
    assert (guard.blocked_word(sql) is None) is safe
    log = spark.createDataFrame([(sql,)], "q STRING")
    assert guard.flag_unsafe(log, "q").first()["blocked"] is not safe
