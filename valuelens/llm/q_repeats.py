"""Query op9: words of repeated 35-word windows in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valuelens.llm._shared import table
from valuelens.llm.recompress import remove_repeats


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT rid, w, unnest(generate_series(1, len(w) - 34)) AS k FROM d WHERE len(w) >= 35),
g AS (SELECT rid, k, count(*) OVER (PARTITION BY array_to_string(w[k:k + 34], ' ')) AS n FROM v),
r AS (
  SELECT rid, list(DISTINCT p) AS gone FROM (SELECT rid, unnest(generate_series(k, k + 34)) AS p FROM g WHERE n > 1) GROUP BY rid),
x AS (SELECT rid, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
t AS (
  SELECT x.rid, string_agg(word, ' ' ORDER BY p) AS kept FROM x LEFT JOIN r USING (rid)
  WHERE r.gone IS NULL OR NOT list_contains(r.gone, x.p) GROUP BY x.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (rid) LEFT JOIN t USING (rid)
"""
