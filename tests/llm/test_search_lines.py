"""Ranked search and line deduplication against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kpiloom.llm import lexical, lines, queries
from kpiloom.llm.common import table
from tools.compare import connect, differences

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def brute_search(docs, items, top):
    """docs (id, text) and items (id, text) as lists; rows (item_id, rank, doc_id, score)."""
    each = [Counter(found_terms(t)) for _, t in docs]
    sizes = [c.total() for c in each]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in each for t in c)
    out = []
    for item_id, text in items:
        rows = []
        for (doc_id, _), c, size in zip(docs, each, sizes, strict=True):
            score = 0
            for t in found_terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (25 + 75 * size * n // total)))
            if score:
                rows.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(rows)[:top])]
    return out


ITEMS = [
    (1, "the river stone cloud"), (2, "paper market winter garden letter the the"), (3, None), (4, " .,"), (5, "zebra"),
    (6, "ÉTÉ été 12AB don t"), (2, "a river"), (None, "of and in to a is for on with"), (7, "quite alone here"),
]


@pytest.mark.parametrize("params", [
    lexical.SearchParams(), lexical.SearchParams(top=3, shard=500, block=4), lexical.SearchParams(top=100, shard=1 << 14),
])
def test_search_matches_brute_force(spark, odd_docs, odd_rows, params):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = lexical.search(odd_docs.repartition(3), items, params).collect()
    want = brute_search([r[:2] for r in odd_rows], ITEMS, params.top)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_search_of_empty_tables_and_other_columns(spark, odd_docs, clashing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = spark.createDataFrame([], odd_docs.schema)
    assert lexical.search(none, items).collect() == []
    assert lexical.search(odd_docs, items.limit(0)).collect() == []
    assert lexical.search(odd_docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    wide = items.select("*", *[F.lit("x").alias(c) for c in ("item", "rank", "doc_id", "score")])
    clash = clashing.select("*", *[F.lit("x").alias(c) for c in ("item", "rank", "ids", "term")])
    assert sorted(lexical.search(clash, wide).collect(), key=str) == sorted(lexical.search(odd_docs, items).collect(), key=str)


def test_accumulators_are_limited_and_survivors_exact():
    # one rare and long common postings: after the rare term no other document can reach the best
    n = 2000
    doc = np.concatenate([np.arange(50), np.arange(n)]).astype(np.int32)
    row = {
        "ids": list(range(n)), "sizes": np.full(n, 20, np.int64), "term": np.array([0, 1], np.int32),
        "starts": np.array([0, 50, 50 + n], np.int32), "doc": doc, "tf": np.ones(len(doc), np.int32),
    }
    item = lexical.Item(0, np.array([0, 1]), np.array([5000, 1]))
    found, scores, made = lexical.Shard(row, n, 20 * n).best(item, 0, 10)
    assert made == 50 and set(found) <= set(range(50)) and len(set(scores.tolist())) == 1
    # the common term still counts for those that were let in
    impact = 10**9 // (1000 + 8 * (25 + 75))
    assert scores[0] == 5001 * impact


def test_equal_bounds_keep_documents_that_win_by_id():
    # the second term alone ties with the first: smaller ids must not be shut out
    row = {
        "ids": [9, 8, 1, 2], "sizes": np.full(4, 5, np.int64), "term": np.array([0, 1], np.int32),
        "starts": np.array([0, 2, 4], np.int32), "doc": np.array([0, 1, 2, 3], np.int32), "tf": np.ones(4, np.int32),
    }
    found, _, _ = lexical.Shard(row, 4, 20).best(lexical.Item(0, np.array([0, 1]), np.array([7, 7])), 0, 2)
    assert sorted(found.tolist()) == [0, 1, 2, 3]


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute_lines(rows, least_chars=40, least_docs=5):
    holders = defaultdict(list)
    for doc_id, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= least_chars:
                holders[k].append((doc_id is not None, doc_id or 0))
    out = []
    for doc_id, text in rows:
        all_lines = (text or "").split("\n")
        kept = [
            x for x in all_lines
            if len(holders[key(x)]) < least_docs or max(holders[key(x)]) == (doc_id is not None, doc_id or 0)
        ]
        out.append((doc_id, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def line_rows():
    shared = [f"shared line number {k} that is long enough to count here" for k in range(12)]
    rows = []
    for i in range(90):
        own = [f"a line of document {i} alone which nobody else has at all"]
        some = [shared[k] if (i + k) % 3 else f"  {shared[k].upper()}\t" for k in range(12) if i % (k + 2) == 0]
        rows.append((i, "\n".join([*own, *some, *some[:1], "short", "short"])))
    rows += [(200, None), (201, ""), (202, "\n\n"), (3, shared[0]), (None, shared[0]), (None, "\r " + shared[11])]
    rows += [(203 + i, "é" * 39 + "\n" + "É" * 40) for i in range(6)] + [(220, shared[1] + "\n" + "x" * 500_000)]
    rows += [(230 + i % 2, "held only by two ids but in six rows, which count") for i in range(6)]
    return rows


@pytest.mark.parametrize("params", [
    lines.LineParams(), lines.LineParams(least_chars=5, least_docs=2, batches=7, fanout=2), lines.LineParams(batches=1),
    lines.LineParams(batches=9, fanout=3),
])
def test_lines_match_brute_force(spark, line_rows, params):
    docs = spark.createDataFrame(line_rows, "doc_id long, text string")
    got = lines.drop_repeated_lines(docs, params).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_lines(line_rows, params.least_chars, params.least_docs), key=str)


def test_lines_keep_other_columns_and_take_empty_tables(spark, line_rows):
    docs = spark.createDataFrame(line_rows, "doc_id long, text string")
    names = ["_gone", "_gone_id", "_left", "h", "top", "batch", "n_lines"]
    wide = docs.select("*", *[F.lit(n).alias(n) for n in names])
    got = lines.drop_repeated_lines(wide)
    assert got.columns == ["doc_id", "text", *names, "kept_text", "n_dropped"]
    assert got.where(" and ".join(f"{n} = '{n}'" for n in names[:-1])).count() == len(line_rows)
    assert lines.drop_repeated_lines(docs.limit(0)).collect() == []
    ids = spark.createDataFrame([("b", "y" * 50)] * 5 + [("a", "y" * 50)], "doc_id string, text string")
    assert sorted(r["n_dropped"] for r in lines.drop_repeated_lines(ids).collect()) == [0] * 5 + [1]


def test_every_hash_lies_in_one_run_and_runs_are_joined_in_place(spark, line_rows):
    docs = spark.createDataFrame(line_rows, "doc_id long, text string").where("doc_id is not null")
    rows = docs.select("doc_id", F.explode(F.array_distinct(F.transform(lines.line_keys(F.col("text")), lines._digest))).alias("h"))
    state = lines.LineRuns(spark, fanout=2)
    for k in range(5):
        state.add(rows.where(F.col("doc_id") % 5 == k))
    held = state.runs()
    assert [len(level) for level in state.levels] == [1, 2]
    hashes = [r["h"] for run in held for r in run.select("h").collect()]
    assert len(hashes) == len({bytes(h) for h in hashes})
    both = state._merge(held[0], held[1])
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = {(bytes(r["h"]), r["n"], r["top"]) for r in rows.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("top")).collect()}
    assert {(bytes(r["h"]), r["n"], r["top"]) for r in state.totals(1).collect()} == want
    state.forget()


@pytest.mark.parametrize("name", ["op12_search", "op13_lines"])
def test_queries_match_their_sql(spark, small, name):
    frame = getattr(queries, name)(spark, small)
    assert differences(frame, frame.collect(), connect(small), queries.oracle_sql()[name]) == []


def test_lines_on_the_given_documents(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    want = [(d, n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, n, gone, t in brute_lines(rows)]
    assert sorted(map(tuple, queries.op13_lines(spark, small).collect())) == sorted(want)
