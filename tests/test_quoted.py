"""CSV with quoted line breaks: byte ranges against the reader that takes a file whole."""

import random

import pytest
from pyspark.sql import functions as F

from kpiloom import schemas
from kpiloom.sources import quoted, readers

SCHEMA = schemas.struct("id INT, text STRING, day DATE, note STRING")
HEADER = "id,text,day,note"


def field(value):
    if value is None:
        return ""
    if value == "" or any(c in value for c in ',"\n'):
        return '"' + value.replace('"', '""') + '"'
    return value


def many_rows(n):
    rng = random.Random(3)
    parts = ["word", '"', "\n", ",", "é", "\n\n", " ", '""', "x" * 30, "中文", "'", ";", "\t"]
    rows = []
    for i in range(n):
        text = rng.choice([None, "plain", "a " + "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) + "z"])
        rows.append(f"{i},{field(text)},2020-01-{1 + i % 28:02d},{field(rng.choice(['', None, 'q', 'two' + chr(10) + 'lines']))}")
    return rows


@pytest.fixture
def ranges(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]

    def of(size):
        spark.conf.set(keys[0], size)
        spark.conf.set(keys[1], 0)

    yield of
    for k, v in zip(keys, old, strict=True):
        spark.conf.set(k, v)


def whole(spark, path):
    return readers.scan_csv(spark, path, SCHEMA, multiline=True)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("size", [50, 97, 1000, 1 << 20])
def test_ranges_give_the_rows_of_the_whole_file(spark, tmp_path, ranges, size):
    for k in (0, 1):
        (tmp_path / f"part{k}.csv").write_text("\n".join([HEADER, *many_rows(60 + k)]) + "\n" * k)
    path = str(tmp_path)
    want = rows_of(whole(spark, path))
    assert len(want) == 121
    ranges(size)
    lines = quoted.physical_lines(spark, path)
    assert lines.select("path", "start").distinct().count() >= min(20, 4000 // size) and lines.rdd.getNumPartitions() >= min(8, 4000 // size)
    got = quoted.scan_quoted_csv(spark, path, SCHEMA, **readers.field_options(readers.TIMESTAMP_FORMAT))
    assert rows_of(got) == want and got.columns == SCHEMA.fieldNames()


def test_one_record_over_many_ranges(spark, tmp_path, ranges):
    long = "\n".join(f'line {k} says ""so"", really' for k in range(200))
    (tmp_path / "a.csv").write_text(f'{HEADER}\n1,"{long}",2020-01-01,x\n2,"{long}",,"{long}"\n3,short,,\n')
    want = rows_of(whole(spark, str(tmp_path)))
    assert len(want) == 3 and want[0][1].count("\n") == 199
    ranges(64)
    assert rows_of(quoted.scan_quoted_csv(spark, str(tmp_path), SCHEMA, escape='"')) == want


def test_quoted_header_other_line_ends_and_empty_lines(spark, tmp_path, ranges):
    text = '"id","te\nxt","day","note"\r\n1,"a\r\nb",2020-01-01,x\r\n\r\n2,b,2020-01-02,"y"\r\n'
    (tmp_path / "a.csv").write_bytes(text.encode())
    (tmp_path / "empty.csv").write_text("")
    ranges(50)
    got = rows_of(quoted.scan_quoted_csv(spark, str(tmp_path), SCHEMA, escape='"'))
    assert [r[:2] for r in got] == [(1, "a\nb"), (2, "b")] and [r[3] for r in got] == ["x", "y"]


def test_wide_scan_takes_the_wanted_columns(spark, tmp_path, ranges):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *many_rows(30)]))
    ranges(80)
    wanted = schemas.struct("note STRING, id INT")
    got = readers.scan_wide_csv(spark, str(tmp_path / "a.csv"), wanted, quoted_breaks=True)
    assert got.columns == ["note", "id"]
    assert rows_of(got) == rows_of(whole(spark, str(tmp_path / "a.csv")).select("note", "id"))


def test_only_open_pieces_are_brought_together(spark, tmp_path, ranges):
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *many_rows(80)]))
    ranges(200)
    lines = quoted.physical_lines(spark, str(tmp_path))
    opened = quoted.open_ranges(lines)
    spans = lines.select("path", "start").distinct().count()
    marked = lines.join(F.broadcast(opened.withColumn("inside", F.lit(True))), ["path", "start"], "left")
    pieces = marked.select("line", "path", "start", F.coalesce("inside", F.lit(False)).alias("inside")).mapInArrow(quoted._cut, quoted._PIECES)
    kinds = {r["kind"]: r["n"] for r in pieces.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds[quoted.END] <= spans and kinds[quoted.BEGINNING] <= spans and kinds[quoted.WHOLE] > 40
    assert pieces.groupBy("path", "start", "kind").count().where(f"kind <> {quoted.WHOLE} and count > 1").count() == 0
