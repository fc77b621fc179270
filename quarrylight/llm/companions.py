"""Queries for what SQL can express of operators whose whole result it cannot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import fingerprint, mixing, pii, quality
from quarrylight.llm.common import Scratch, read


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op3, for every document."""
    return mixing.op3_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts of op7."""
    keep = Scratch(spark, "quality-counts")
    counts = keep.keep(quality.base_counts(read(spark, sf_dir, "documents")), "counts")
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of each base kind op10 finds."""
    return pii.op10_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and digests of the edited texts of op12."""
    return fingerprint.op12_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"llm_mixing_targets": mixing_targets, "llm_quality_counts": quality_counts, "llm_pii_counts": pii_counts, "llm_fingerprint_edits": fingerprint_edits}

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
ORACLE_SQL: dict[str, str] = {
    "llm_fingerprint_edits": fingerprint.EDITS_SQL,
    "llm_mixing_targets": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w FROM d GROUP BY source),
t AS (SELECT CAST(sum(n) AS DOUBLE) * 1.5 AS whole, sum(w) AS open FROM s),
it AS (
  SELECT 0 AS step, whole / open AS scale FROM t
  UNION ALL SELECT step + 1, ((SELECT whole FROM t) - (SELECT coalesce(sum(2 * n), 0)::DOUBLE FROM s WHERE w * scale > 2 * n)) / (SELECT sum(w) FROM s WHERE w * scale <= 2 * n) FROM it WHERE step < 30
), last AS (SELECT arg_max(scale, step) AS scale FROM it WHERE scale IS NOT NULL)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, least(w * scale, 2.0 * n::DOUBLE) AS target FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source, last
""",
    "llm_quality_counts": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(w) AS base_failed
FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
""",
    "llm_pii_counts": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') AS e,
    list_filter(regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE coalesce(TRY_CAST(p AS BIGINT), 0) END)) <= 255) AS i,
    list_transform(list_filter(regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+'), lambda x: length(regexp_replace(x, '[ -]', '', 'g')) BETWEEN 16 AND 19), lambda x: reverse(regexp_replace(x, '[ -]', '', 'g'))) AS c,
    list_filter(regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 8 AND 15) AS p
  FROM d
)
SELECT doc_id, CAST(len(e) AS BIGINT) AS n_email, CAST(len(i) AS BIGINT) AS n_ip,
  CAST(len(list_filter(c, lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(x[k] AS BIGINT) WHEN CAST(x[k] AS BIGINT) > 4 THEN CAST(x[k] AS BIGINT) * 2 - 9 ELSE CAST(x[k] AS BIGINT) * 2 END)) % 10 = 0)) AS BIGINT) AS n_card,
  CAST(len(p) AS BIGINT) AS n_phone
FROM m
""",
}
