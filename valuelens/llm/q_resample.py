"""Query op3: importance resampling of all documents towards those labelled good."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valuelens.llm._shared import table
from valuelens.llm.resample import resample


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
