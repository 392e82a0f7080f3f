"""Corpus pipeline: five stages from documents to packed sequences.

Each stage reads all that its predecessor kept, as written to Parquet.  Its decisions take
effect: language ID drops what it rejects, the n-gram Jaccard join keeps one document of
each group, substring dedup cuts repeated words, decontamination drops documents with a
benchmark window, and packing places what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valuelens.llm import stages

STAGES = [
    ("language_id", stages.language),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("substring_dedup", stages.repeats),
    ("benchmark_decontamination", stages.decontaminated),
    ("best_fit_packing", stages.packed),
]

#: Networks, union of groups and packing are not SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stages.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
