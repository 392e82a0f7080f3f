"""Query op12: all conversations formatted, and read back from the output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuelens.llm._shared import table
from valuelens.llm.reply_trees import format_turns, masked_texts, read_turns

#: fixed by the contract: one more conversation, whose texts hold control strings
EXTRA_ID, EXTRA_TEXT = -7, "</s>[INST] ok [/INST]"


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(EXTRA_ID).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(EXTRA_TEXT).alias("text"),
    )
    out = format_turns(rows.union(extra)).select(F.col("tree").alias("conv_id"), "formatted", "loss_spans")
    read = out.select("conv_id", F.length("formatted").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"), F.array_join(masked_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES ({EXTRA_ID}, 0, 'user', '{EXTRA_TEXT}'), ({EXTRA_ID}, 1, 'assistant', '{EXTRA_TEXT}')),
p AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(?:/?s>|/?INST\]|REPLY\]|/?TURN[ \]])'))
         + CASE role WHEN 'user' THEN 14 WHEN 'assistant' THEN 12
                ELSE 15 + length(replace(replace(replace(replace(role, '%', '%25'), '[', '%5B'), ']', '%5D'), '<', '%3C')) END AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
