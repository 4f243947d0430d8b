import time

import pytest
from pyspark.sql import functions as F

from kpiloom import schemas
from kpiloom.plans import guard, questions, star
from kpiloom.sources import extracts, readers, sinks, versions
from tests.golden import ROWS, raw_frames


@pytest.fixture(scope="module")
def raw(spark):
    return raw_frames(spark)


@pytest.mark.parametrize("name", sorted(ROWS))
def test_csv_round_trip(raw, spark, tmp_path, name):
    path = str(tmp_path / name)
    sinks.write_csv(raw[name], path)
    back = readers.scan_csv(spark, path, schemas.RAW[name])
    key = str
    assert sorted(back.collect(), key=key) == sorted(raw[name].collect(), key=key)


def test_wide_csv_keeps_wanted_columns(raw, spark, tmp_path):
    path = str(tmp_path / "wide")
    sinks.write_csv(raw["orders"], path)
    wanted = schemas.struct("order_purchase_timestamp TIMESTAMP_NTZ, order_id STRING")
    back = readers.scan_wide_csv(spark, path, wanted)
    assert back.columns == ["order_purchase_timestamp", "order_id"]
    assert back.where("order_purchase_timestamp IS NOT NULL").count() == 5


def test_star_from_csv_equals_star_from_frames(raw, spark, tmp_path):
    """The whole batch build: CSV files → star tables on disk → copy."""
    read = {}
    for name, frame in raw.items():
        sinks.write_csv(frame, str(tmp_path / "raw" / name))
        read[name] = readers.scan_csv(spark, str(tmp_path / "raw" / name), schemas.RAW[name])
    counts = sinks.load_star(spark, read, str(tmp_path / "star"), declared=True)
    assert counts == {
        "dim_date": 5, "dim_customer": 3, "dim_product": 3, "dim_geography": 4,
        "dim_department": 3, "dim_attrition_label": 6, "fact_orders": 5, "fact_employees": 4,
    }
    copied = sinks.copy_tables(spark, str(tmp_path / "star"), str(tmp_path / "copy"))
    assert copied == counts
    direct = star.build_star(spark, raw, number_ids=True)
    for name in counts:
        stored = versions.read(spark, str(tmp_path / "copy" / name))
        want = star.conform(direct[name], name)
        assert sorted(map(str, stored.collect())) == sorted(map(str, want.collect()))


def test_star_from_a_folder_of_files(raw, spark, tmp_path):
    """The eight files under their published names, wider than declared, with quoted line breaks."""
    extra = {"reviews": F.lit('said "fine",\nthen left'), "products": F.lit(3)}
    for name, file in readers.RAW_FILES.items():
        wide = raw[name].withColumn("something_else", extra.get(name, F.lit("x")))
        sinks.write_csv(wide, str(tmp_path / "raw" / file))
    root = str(tmp_path / "star")
    counts = sinks.load_star_from_csv(spark, str(tmp_path / "raw"), root)
    direct = star.build_star(spark, raw, number_ids=True)
    assert set(counts) == set(direct)
    for name in counts:
        stored = versions.read(spark, f"{root}/{name}")
        want = star.conform(direct[name], name)
        assert sorted(map(str, stored.collect())) == sorted(map(str, want.collect()))


def test_a_loaded_star_is_attached_and_only_stale_tables_are_loaded(raw, spark, tmp_path):
    root, source = str(tmp_path / "star"), tmp_path / "in"
    for name, frame in raw.items():
        frame.write.parquet(str(source / name))

    def attach(code=""):
        frames = {name: spark.read.parquet(str(source / name)) for name in raw}
        marks = {name: versions.source_mark(spark, [str(source / name)]) for name in raw}
        return sinks.attach_star(spark, frames, root, marks, code)

    counts, loaded = attach()
    assert set(loaded) == set(sinks.STAR_SOURCES) == set(counts) and counts["fact_orders"] == 5
    before = {t: versions.current(spark, f"{root}/{t}") for t in counts}
    assert attach() == (counts, [])
    raw["products"].limit(1).write.mode("overwrite").parquet(str(source / "products"))
    again, loaded = attach()
    assert loaded == ["dim_product"] and again["dim_product"] == 1
    raw["orders"].where("order_id <> 'o1'").write.mode("overwrite").parquet(str(source / "orders"))
    again, loaded = attach()
    assert loaded == ["dim_date", "fact_orders", "fact_employees"] and again["fact_orders"] == 4
    after = {t: versions.current(spark, f"{root}/{t}") for t in counts}
    assert {t for t in counts if before[t] != after[t]} == {"dim_product", *loaded}
    assert attach("other code")[1] == list(sinks.STAR_SOURCES)
    # every table is made of what a whole load reads
    frames = {name: spark.read.parquet(str(source / name)) for name in raw}
    direct = star.build_star(spark, frames, number_ids=True)
    for name in counts:
        stored = star.conform(versions.read(spark, f"{root}/{name}"), name)
        assert sorted(map(str, stored.collect())) == sorted(map(str, star.conform(direct[name], name).collect()))


def test_stored_orders_follow_the_calendar(raw, spark, tmp_path):
    root = str(tmp_path / "star")
    counts = sinks.load_star(spark, raw, root)
    stored = {name: versions.read(spark, f"{root}/{name}") for name in counts}
    ranges = stored["fact_orders"].groupBy(F.input_file_name().alias("file")).agg(
        F.min("date_id").alias("low"), F.max("date_id").alias("high")
    ).where("low IS NOT NULL").orderBy("low").collect()
    assert all(a.high <= b.low for a, b in zip(ranges, ranges[1:]))
    days = stored["dim_date"].where("year = 2016 AND month = 1")
    assert {r.order_id for r in questions.orders_on(stored, days).collect()} == {"o1", "o2"}
    plan = questions.delivered_in_year(stored, 2016)._jdf.queryExecution().toString()
    assert plan.count("scalar-subquery") >= 2


def test_append_and_replace(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append(spark.range(3), path)
    sinks.append(spark.range(2), path)
    assert spark.read.parquet(path).count() == 5
    sinks.replace(spark.range(1), path)
    assert versions.read(spark, path).count() == 1
    sinks.append(spark.range(4), path)
    assert versions.read(spark, path).count() == 5


def test_a_reader_finishes_on_the_version_it_began_with(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace(spark.range(10), path)
    begun = versions.read(spark, path)
    sinks.replace(spark.range(10, 13), path)
    assert begun.count() == 10 and versions.read(spark, path).count() == 3
    # a table may be made from itself
    sinks.replace(versions.read(spark, path).selectExpr("id + 1 AS id"), path)
    assert sorted(r.id for r in versions.read(spark, path).collect()) == [11, 12, 13]
    assert len(versions.drop_old(spark, path)) == 2 and versions.drop_old(spark, path) == []
    assert versions.read(spark, path).count() == 3


def test_a_failing_load_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace(spark.range(10), path)
    bad = spark.range(100).selectExpr("CASE WHEN id = 77 THEN raise_error('no') ELSE id END AS id")
    with pytest.raises(Exception, match="no"):
        sinks.replace(bad, path)
    assert sorted(r.id for r in versions.read(spark, path).collect()) == list(range(10))
    assert versions.current(spark, str(tmp_path / "nothing")) == str(tmp_path / "nothing")


def test_create_tables_is_idempotent(spark, tmp_path):
    for _ in range(2):
        names = sinks.create_tables(spark, "kpiloom_test", str(tmp_path / "wh"))
    assert len(names) == 8
    place = spark.sql("DESCRIBE DATABASE kpiloom_test").where("info_name = 'Location'").first()["info_value"]
    assert place.endswith(str(tmp_path / "wh" / "database"))
    table = spark.table("kpiloom_test.fact_orders")
    assert table.schema["price"].dataType.simpleString() == "decimal(10,2)"
    spark.createDataFrame([(None,) * len(table.schema)], table.schema).write.insertInto("kpiloom_test.fact_orders")
    sinks.drop_tables(spark, "kpiloom_test")
    assert not spark.catalog.databaseExists("kpiloom_test")
    assert spark.read.parquet(str(tmp_path / "wh" / "fact_orders")).count() == 1


def test_metrics_json(spark, tmp_path):
    path = str(tmp_path / "m")
    df = spark.range(1).select(F.lit(0.5).alias("auc"), F.create_map(F.lit("a"), F.lit(1.0)).alias("w"))
    sinks.write_metrics(df, path)
    row = spark.read.schema("auc DOUBLE, w MAP<STRING, DOUBLE>").json(path).first()
    assert row.auc == 0.5 and row.w == {"a": 1.0}


def test_timed_cache():
    built, dropped = [], []
    cache = extracts.TimedCache(ttl=0.05, on_expire=dropped.append)
    make = lambda: built.append(1) or len(built)
    assert cache.get("k", make) == 1 and cache.get("k", make) == 1
    time.sleep(0.06)
    assert cache.get("k", make) == 2 and dropped == [1]


def test_guarded_sql(spark, raw):
    built = star.build_star(spark, raw)
    rows = guard.guarded_sql(spark, "SELECT explode(sequence(1, 33)) AS n", built).collect()
    assert len(rows) == 33
    for text in ("DROP VIEW fact_orders", "SELECT created_at FROM fact_orders"):
        with pytest.raises(ValueError, match="unsafe"):
            guard.guarded_sql(spark, text, built)


SAFE = [
    "SELECT count(*) AS n FROM fact_orders",
    "SELECT * FROM (SELECT order_status, count(*) AS n FROM Fact_Orders GROUP BY order_status HAVING count(*) > 0) ORDER BY n LIMIT 3",
    "WITH a AS (SELECT * FROM dim_date), b AS (SELECT * FROM a) SELECT max(year) FROM b",
    "SELECT (SELECT max(price) FROM fact_orders) AS m, 1 AS one",
    "SELECT * FROM dim_geography g WHERE EXISTS (SELECT 1 FROM fact_orders f WHERE f.geo_id = g.geo_id)",
    "SELECT order_id, row_number() OVER (PARTITION BY order_status ORDER BY price) FROM fact_orders",
    "SELECT v.x, e FROM VALUES (1), (2) AS v(x) LATERAL VIEW explode(sequence(1, x)) AS e",
    "SELECT state FROM dim_geography UNION ALL SELECT state FROM dim_customer EXCEPT SELECT 'SP'",
    "SELECT DISTINCT d.year FROM fact_orders f JOIN dim_date d USING (date_id) WHERE f.price BETWEEN 1 AND 1e9",
]
UNSAFE = [
    "SELECT * FROM parquet.`/etc/passwd`", "SELECT * FROM csv.`/root`", "SELECT (SELECT max(value) FROM text.`/etc/hosts`)",
    "SELECT * FROM fact_orders WHERE order_id IN (SELECT value FROM text.`/etc/hosts`)",
    "WITH fact AS (SELECT * FROM json.`/x`) SELECT * FROM fact", "SELECT * FROM other_table", "SELECT * FROM default.fact_orders",
    "SET spark.sql.ansi.enabled=false", "SET", "RESET", "SHOW TABLES", "DESCRIBE fact_orders", "USE default", "CACHE TABLE fact_orders",
    "EXPLAIN SELECT 1", "ADD JAR '/x.jar'", "REFRESH TABLE fact_orders", "ANALYZE TABLE fact_orders COMPUTE STATISTICS",
    "SELECT * FROM range(10)", "SELECT TRANSFORM(order_id) USING 'cat' FROM fact_orders", "LOAD DATA INPATH '/x' INTO TABLE fact_orders",
    "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "SELECT java_method ('java.lang.System', 'exit', 1)",
    "FROM fact_orders SELECT 1 UNION SELECT 1 FROM avro.`/x`", "SELECT * FROM fact_orders, LATERAL (SELECT * FROM orc.`/x`)",
]


@pytest.mark.parametrize("sql", SAFE)
def test_reads_of_the_views_run(spark, raw, sql):
    assert guard.guarded_sql(spark, sql, star.build_star(spark, raw)).collect() is not None


@pytest.mark.parametrize("sql", UNSAFE)
def test_statements_that_reach_outside_the_views_are_refused(spark, raw, sql):
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    with pytest.raises(ValueError, match="unsafe SQL"):
        guard.guarded_sql(spark, sql, star.build_star(spark, raw))
    assert spark.conf.get("spark.sql.ansi.enabled") == ansi


def test_a_name_a_statement_defines_does_not_open_others(spark, raw):
    built = star.build_star(spark, raw)
    # defined after its use, or in another part of the statement
    for sql in (
        "WITH a AS (SELECT * FROM b), b AS (SELECT 1 AS x) SELECT * FROM a",
        "SELECT * FROM (WITH t AS (SELECT 1 AS x) SELECT * FROM t) JOIN t",
    ):
        with pytest.raises(ValueError, match="none of the views"):
            guard.guarded_sql(spark, sql, built)


def test_outcomes(spark, raw):
    built = star.build_star(spark, raw)
    statements = {
        "how many": "SELECT COUNT(*) FROM fact_orders",
        "bad": "DELETE FROM fact_orders",
        "broken": "SELECT nothing FROM nowhere",
        "fails late": "SELECT 1 / (COUNT(*) - 5) FROM fact_orders",
        "": "SELECT 1",
    }
    rows = {r.question: r for r in guard.query_outcomes(spark, built, statements).collect()}
    assert rows["how many"].row_count == 1 and rows["how many"].error is None
    for name in ("bad", "broken", ""):
        assert rows[name].row_count == 0 and rows[name].sql == "" and rows[name].error


def test_questions(spark, raw):
    built = star.build_star(spark, raw)
    assert guard.QUESTION_SQL.keys() == questions.QUESTIONS.keys()
    top = questions.answer(built, "What are the top 5 product categories by total revenue?").collect()
    assert [r.category_name for r in top] == ["beauty"]
    best = questions.answer(built, "What are the top 10 customers by order value?").collect()
    assert best[0].customer_id == "c2"  # the kept row of o4 is theirs
    with pytest.raises(ValueError, match="empty"):
        questions.answer(built, "  ")


def test_a_query_loads_only_the_tables_it_reads(raw, spark, tmp_path):
    root, marks = str(tmp_path / "star"), {name: "1" for name in raw}
    counts, loaded = sinks.attach_star(spark, raw, root, marks, tables=["fact_employees"])
    assert loaded == ["dim_date", "dim_department", "dim_attrition_label", "fact_employees"] == list(counts)
    counts, loaded = sinks.attach_star(spark, raw, root, marks, tables=["fact_orders"])
    assert loaded == ["dim_geography", "fact_orders"] and counts["fact_orders"] == 5
    counts, loaded = sinks.attach_star(spark, raw, root, marks)
    assert loaded == ["dim_customer", "dim_product"] and set(counts) == set(sinks.STAR_SOURCES)
    direct = star.build_star(spark, raw, number_ids=True)
    for name in counts:
        stored = star.conform(versions.read(spark, f"{root}/{name}"), name)
        assert sorted(map(str, stored.collect())) == sorted(map(str, star.conform(direct[name], name).collect()))


def test_a_workspace_loads_a_table_when_it_is_asked_for(raw, spark, monkeypatch):
    from kpiloom.catalog import registry

    asked = []
    monkeypatch.setattr(registry, "attach_star", lambda *a, tables, **k: (asked.append(list(tables)), ({}, []))[1])
    monkeypatch.setattr(registry.versions, "read", lambda spark, path: path.rsplit("/", 1)[-1])
    ws = registry.Workspace(spark, "/nowhere")
    ws.__dict__.update(marks={}, raw=raw)
    assert ws.star["dim_date"] == ws.star["dim_date"] == "dim_date" and asked == [["dim_date"]]
    assert set(ws.star) == set(sinks.STAR_SOURCES) and "orders" not in ws.star


def test_orders_are_joined_once_before_they_are_dealt_to_ranges(raw, spark, tmp_path, monkeypatch):
    kept = []
    plain = sinks.written
    monkeypatch.setattr(sinks, "written", lambda s, name, df: (kept.append((name, df.columns)), plain(s, name, df))[1])
    sinks.load_star(spark, raw, str(tmp_path / "star"))
    assert ("order-rows", star.ORDER_COLUMNS) in kept
