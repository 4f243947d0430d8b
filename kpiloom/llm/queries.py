"""Named queries over the corpus tables, and their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiloom.llm import chat, crosstok, decontam, langid, lexical, licenses, lines, packing, quality, rules, simhash, toxicity, warc
from kpiloom.llm.common import held_out, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan_documents(table(spark, sf_dir, "documents"))
    places = F.transform("base", lambda b: b["first_word"])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    found = F.transform("found", lambda d: d["label"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, found))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0))
        .otherwise(F.coalesce(F.array_max(F.transform("found", lambda d: d["certainty"])), F.lit(0.0)))
        .alias("score"),
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.read_back(chat.windows(turns.unionByName(probe)))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = rules.rule_documents(table(spark, sf_dir, "documents"))
    return ruled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.align_documents(table(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_simhash, op2_packing, op3_quality, op4_licenses, op5_chat, op6_decontamination,
            op7_toxicity, op8_language, op9_rules, op10_warc, op11_alignment, op12_search, op13_lines,
        )
    }


_RULES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), spans AS (
  SELECT rid, unnest(range(1, greatest(len(ws) - 6, 1))) AS i, ws FROM w
), hashed AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM spans
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM hashed) WHERE n > 1
), covered AS (
  SELECT rid, sum(least(8, i - before)) AS n
  FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 8) AS before FROM twice) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON w.rid = covered.rid
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_dup_lines // greatest(n_words, 1) AS dup_lines,
    1000 * n_repeat_words // greatest(n_words, 1) AS repeats, 1000 * word_chars // greatest(n_words, 1) AS word_length
  FROM m
), v AS (
  SELECT lang, source, 'symbols' AS metric, 75 AS high, 6 AS fence, 5 AS spread, symbols AS x FROM f WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'dup_lines', 99, 3, 2, dup_lines FROM f WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'repeats', 99, 2, 5, repeats FROM f WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'word_length', 75, 10, 20, word_length FROM f WHERE NOT base_failed
), b AS (
  SELECT lang, source, metric, high, fence, spread,
    CASE WHEN x < 128 THEN x ELSE (x >> greatest(length(bin(x)) - 7, 0)) << greatest(length(bin(x)) - 7, 0) END AS low, count(*) AS n
  FROM v GROUP BY ALL
), c AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY low) AS upto,
    sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM b
), q AS (
  SELECT lang, source, metric, fence, spread, min(low) FILTER (100 * upto >= 50 * total) AS mid,
    min(low) FILTER (100 * upto >= high * total) AS top FROM c GROUP BY ALL
), e AS (
  SELECT lang, source, metric, mid + fence * greatest(top - mid, spread) AS bound FROM q
), most AS (
  SELECT lang, source, max(bound) FILTER (metric = 'symbols') AS s, max(bound) FILTER (metric = 'dup_lines') AS d,
    max(bound) FILTER (metric = 'repeats') AS r, max(bound) FILTER (metric = 'word_length') AS l
  FROM e GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbols <= s AND dup_lines <= d AND repeats <= r AND word_length <= l, false) AS kept
FROM f LEFT JOIN most ON f.lang IS NOT DISTINCT FROM most.lang AND f.source IS NOT DISTINCT FROM most.source
"""

_WARC_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS h FROM pages
), n AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((
      (instr('0123456789abcdef', substr(h, CAST(i * 5 // 4 + 1 AS BIGINT), 1)) - 1) * 16
      + greatest(instr('0123456789abcdef', substr(h || '0', CAST(i * 5 // 4 + 2 AS BIGINT), 1)) - 1, 0)
    ) >> CAST(3 - i * 5 % 4 AS INTEGER)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM n
"""


_SEARCH_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), i AS (
  SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM benchmark
), q AS (
  SELECT iid, item_id, term, count(*) AS times FROM (SELECT iid, item_id, unnest(ts) AS term FROM i) GROUP BY ALL
), p AS (
  SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), c AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, docs
), s AS (
  SELECT iid, item_id, rid, doc_id,
    CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), c GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id, rid) AS rank FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

_LINES_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT rid) >= 5
), g AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id IS DISTINCT FROM f.top AS gone FROM k LEFT JOIN f ON k.key = f.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY rid
"""


def oracle_sql() -> dict[str, str]:
    """The operators whose results SQL can state; the others are tested in tests/llm."""
    return {"op9_rules": _RULES_SQL, "op10_warc": _WARC_SQL, "op12_search": _SEARCH_SQL, "op13_lines": _LINES_SQL}
