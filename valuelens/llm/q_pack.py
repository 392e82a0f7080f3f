"""Query op2: pack all documents into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valuelens.llm._shared import table
from valuelens.llm.pack import pack, tokenize


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file (installed on every machine)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(tokenize(table(spark, sf_dir, "documents"), vocabulary()))
