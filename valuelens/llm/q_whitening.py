"""Query op11: whitened embeddings, all rows; eigenvectors are not SQL, so a brute-force test holds the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valuelens.llm._shared import table
from valuelens.llm.whitening import whiten


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=8, weights="rows")
