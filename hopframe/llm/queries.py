"""The registered queries of this subpackage, over whole tables, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.llm import decontam, license_scan, media, ngram_join, packing, pii, quality, token_counts, toxicity, url_filter
from hopframe.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document; a token that crosses a line's end counts where it begins."""
    return token_counts.attribute(table(spark, sf_dir, "documents"), rule="start")


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), capacity=1024))


def op4_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.withColumn("kept", F.col("score") >= 0.5)


def op5_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.texts_to_media(table(spark, sf_dir, "documents")))


def op6_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.detect(table(spark, sf_dir, "documents")))


def op7_temporal_list_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no date: a page counts as fetched on day ``page_id mod 366`` of 2024."""
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_on"))
    entries = spark.createDataFrame(url_filter.ENTRIES, "pattern string, listed_on string, action string")
    return url_filter.blocked(captures, entries, "page_id", "url", "fetched_on")


_ENTRIES_SQL = ", ".join(f"('{p}', DATE '{d}', '{a}')" for p, d, a in url_filter.ENTRIES)

OP7_SQL = f"""
WITH entries(pattern, valid_from, action) AS (VALUES {_ENTRIES_SQL}),
one AS (SELECT pattern, valid_from, max(action) AS action FROM entries GROUP BY pattern, valid_from),
spans AS (SELECT *, lead(valid_from) OVER (PARTITION BY pattern ORDER BY valid_from) AS valid_to FROM one),
seen AS (
  SELECT page_id,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
    CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched_on
  FROM pages),
met AS (
  SELECT s.page_id, s.host, s.fetched_on, e.pattern, e.action, e.valid_from,
    row_number() OVER (PARTITION BY s.page_id ORDER BY length(e.pattern) DESC NULLS LAST) AS r
  FROM seen s LEFT JOIN spans e
    ON (s.host = e.pattern OR ends_with(s.host, '.' || e.pattern))
    AND e.valid_from <= s.fetched_on AND (e.valid_to IS NULL OR s.fetched_on < e.valid_to))
SELECT page_id, host, fetched_on, pattern, action, valid_from, coalesce(action = 'block', false) AS blocked
FROM met WHERE r = 1
"""


def op8_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), k=5, percent=80).drop("class_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM words, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * m >= 80 * (x.n + y.n - m)),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id
FROM reach r LEFT JOIN sizes z ON z.doc_id = r.doc_id GROUP BY r.doc_id
"""

OP10_SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM items, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(i) WHERE len(w) > 0),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM words, (SELECT DISTINCT k FROM windows), unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
hits AS (SELECT doc_id, p.k, i, item_id FROM places p JOIN windows v ON v.k = p.k AND v.g = p.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM hits, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(f.n, 0) AS n_items,
  sha256(coalesce(f.items, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM words d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_attribution": op2_token_attribution,
    "op3_harmonic_packing": op3_harmonic_packing,
    "op4_quality_cotraining": op4_quality_cotraining,
    "op5_iso_media": op5_iso_media,
    "op6_pii_field": op6_pii_field,
    "op7_temporal_list_join": op7_temporal_list_join,
    "op8_license_diagonals": op8_license_diagonals,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL = {
    "op7_temporal_list_join": OP7_SQL,
    "op9_ngram_jaccard": OP9_SQL,
    "op10_decontamination": OP10_SQL,
}
