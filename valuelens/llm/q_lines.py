"""Query op1: line-first quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valuelens.llm._shared import table
from valuelens.llm.line_rules import BOILERPLATE, clean_lines


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")


_BOILER = " OR ".join(f"contains(low, '{x}')" for x in BOILERPLATE)

SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
l AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k
  FROM d),
lw AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w,
         length(regexp_replace(line, '[^!?#*$%&|<>]', '', 'g')) AS marks,
         length(regexp_replace(line, '[^|]', '', 'g')) AS bars,
         regexp_matches(line, '[.!?…]([\x20\x09-\x0D]|$)') AS ends,
         translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         row_number() OVER (PARTITION BY rid, line ORDER BY k) AS nth
  FROM l),
ln AS (
  SELECT rid, count(*) AS n_lines,
         sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS n_dup_lines,
         sum(CASE WHEN NOT ends OR 4 * marks > w OR (bars >= 2 AND 10 * bars >= w) OR {_BOILER} THEN 1 ELSE 0 END) AS n_bad_lines,
         sum(CASE WHEN NOT ends OR 4 * marks > w OR (bars >= 2 AND 10 * bars >= w) OR {_BOILER} THEN 0 ELSE w END) AS n_good_words
  FROM lw WHERE w > 0 GROUP BY rid),
t AS (
  SELECT rid, unnest(generate_series(1, len(words) - 2)) AS k, words FROM d WHERE len(words) >= 3),
g AS (
  SELECT rid, k, count(*) OVER (PARTITION BY rid, words[k], words[k + 1], words[k + 2]) AS n FROM t),
c AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([k, k + 1, k + 2]) AS p FROM g WHERE n > 1) GROUP BY rid),
s AS (
  SELECT d.rid, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_bad_lines, 0) AS n_bad_lines, coalesce(n_good_words, 0) AS n_good_words
  FROM d LEFT JOIN ln USING (rid) LEFT JOIN c USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_good_words >= n_words AS kept,
       n_lines::BIGINT AS n_lines, n_bad_lines::BIGINT AS n_bad_lines, n_good_words::BIGINT AS n_good_words
FROM s
"""
