"""The stages of the corpus pipeline: thin calls of the operators that return documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuelens.llm import byte_cnn, pack, partenum, recompress, suffix_match
from valuelens.llm._shared import cut, table
from valuelens.llm.q_pack import vocabulary

written = cut
#: a document whose best language has less than this mean probability is rejected
LEAST_SCORE = 0.5
#: near duplicates share 4/5 of their 5-word shingles
NEAR = partenum.Rule(5, 4, 5)


def _with_text(rows: DataFrame, like: DataFrame, text: str) -> DataFrame:
    """The columns of ``like`` from ``kept_row`` with another text; n_chars, if there, is that of the new text."""
    out = {c: F.col("kept_row")[c] for c in like.columns} | {"text": F.col(text)}
    if "n_chars" in out:
        out["n_chars"] = F.length(text).cast(like.schema["n_chars"].dataType)
    return rows.select(*(v.alias(c) for c, v in out.items()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language: neither ``und`` nor below ``LEAST_SCORE``; learned from this stage's input."""
    found = byte_cnn.identify(docs, byte_cnn.fit(docs), keep_row=True)
    return found.where((F.col("lang_pred") != byte_cnn.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("kept_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, the one with the smallest id."""
    return partenum.keep_first(docs, NEAR)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that occur elsewhere; untouched texts stay as they were, no row goes."""
    cut_rows = recompress.remove_repeats(docs, keep_row=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("kept_row.text"))
    return _with_text(cut_rows.withColumn("new_text", text), docs, "new_text")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return suffix_match.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    return pack.pack(pack.tokenize(docs, vocabulary()))
