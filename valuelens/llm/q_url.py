"""Query op10: URL rules over all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valuelens.llm._shared import table
from valuelens.llm.url_rules import judge

#: fixed by the contract: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages"), rules)


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

SQL = rf"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {_VALUES}),
u AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT rid, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
m AS (
  SELECT rid, arg_max(r_host || r_path, length(r_host) + length(r_path)) AS rule,
         arg_max(r_verdict, length(r_host) + length(r_path)) AS v
  FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  GROUP BY rid)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM p LEFT JOIN m USING (rid)
"""
