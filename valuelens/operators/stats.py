"""Correlation (A1-A3), samples (A9, A10) and regression metrics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuelens.functions.exprs import rnd
from valuelens.operators.gram import gram

# Fixed values from the reference: correlation strength bands.
STRENGTH_BANDS = [(0.9, "very strong"), (0.7, "strong"), (0.5, "moderate"), (0.3, "weak")]


def correlation_matrix(df: DataFrame, columns: Sequence[str], digits: int = 4) -> DataFrame:
    """A1: long matrix (col1, col2, i, j, correlation) over all ordered pairs.

    Pairwise-complete Pearson r from one pass of packed cross products over
    [present, value, value^2] of every column, values shifted by the column
    means (a cheap ``avg`` pass first) and 0 where missing: the products of these
    blocks hold n, S_a, S_b, S_aa, S_bb and S_ab of each pair over the rows where
    both are present.  Values are rounded, and NULL/NaN (constant columns) become
    0 as in the reference.
    """
    cols = list(columns)
    p = len(cols)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    sh = [F.coalesce(F.col(c).cast("double") - F.lit(float(means[f"m{i}"] or 0.0)), F.lit(0.0)) for i, c in enumerate(cols)]
    here = [F.col(c).isNotNull().cast("double") for c in cols]
    sums = gram(df, [*here, *sh, *[x * x for x in sh]])

    def pairs(batches):
        for b in batches:
            for flat in b.column(0).to_pylist():
                g = np.array(flat).reshape(3 * p, 3 * p)
                n, s, ss, ab = g[:p, :p], g[p : 2 * p, :p], g[2 * p :, :p], g[p : 2 * p, p : 2 * p]
                with np.errstate(all="ignore"):
                    mean, var = s / n, ss / n - (s / n) ** 2
                    r = (ab / n - mean * mean.T) / (np.sqrt(np.where(var > 0, var, np.nan)) * np.sqrt(np.where(var.T > 0, var.T, np.nan)))
                i, j = np.divmod(np.arange(p * p), p)
                # one value for both orders of a pair
                v = np.where(i <= j, r.ravel(), r.T.ravel())
                yield pa.record_batch([pa.array([cols[k] for k in i]), pa.array([cols[k] for k in j]), pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                                       pa.array(v)], names=["col1", "col2", "i", "j", "r"])

    out = sums.select("_P").mapInArrow(pairs, "col1 string, col2 string, i int, j int, r double")
    value = F.coalesce(F.nanvl(rnd(F.nanvl("r", F.lit(None).cast("double")), digits), F.lit(None).cast("double")), F.lit(0.0))
    return out.select("col1", "col2", "i", "j", value.alias("correlation"))


def strength(abs_r: Column) -> Column:
    out = F.lit("very weak")
    for lo, label in reversed(STRENGTH_BANDS):
        out = F.when(abs_r >= lo, label).otherwise(out)
    return out


def correlation_pairs(matrix: DataFrame, threshold: float = 0.3, focus: str | None = None) -> DataFrame:
    """A2: significant pairs (i < j, |r| >= threshold), optional focus column."""
    m = matrix.where((F.col("i") < F.col("j")) & (F.abs("correlation") >= threshold))
    if focus:
        m = m.where((F.col("col1") == focus) | (F.col("col2") == focus))
    return m.select(
        "col1", "col2", "correlation",
        strength(F.abs("correlation")).alias("strength"),
        F.when(F.col("correlation") > 0, "positive").otherwise("negative").alias("direction"),
    )


def correlation_focus(matrix: DataFrame, threshold: float, focus: str) -> DataFrame:
    """A3: sub-matrix of the focus column and every column significantly related to it."""
    pairs = correlation_pairs(matrix, threshold, focus)
    rel = pairs.select(F.col("col1").alias("c")).union(pairs.select(F.col("col2").alias("c"))).union(
        matrix.sparkSession.range(1).select(F.lit(focus).alias("c"))).distinct()
    keep = matrix.join(F.broadcast(rel.withColumnRenamed("c", "col1")), "col1", "left_semi")  # <= p rows
    return keep.join(F.broadcast(rel.withColumnRenamed("c", "col2")), "col2", "left_semi").select("col1", "col2", "correlation")


def _key_number(key: str) -> Column:
    """A key as a number: integers as they are, other values by 12 hex digits of their md5, NULL as 0."""
    text = F.col(key).cast("string")
    digest = F.conv(F.substring(F.md5(text), 1, 12), 16, 10)
    return F.coalesce(text.try_cast("long"), digest.cast("long"), F.lit(0).cast("long"))


def deterministic_order(keys: Sequence[str], seed: int = 42) -> Column:
    """Reproducible pseudo-random order from key columns of any type (same arithmetic in SQL); never NULL."""
    h = F.lit(seed).cast("long")
    for k in keys:
        h = F.pmod(h * 1000003 + F.pmod(_key_number(k), F.lit(2147483647)), F.lit(2147483647))
    return h


def scatter_sample(df: DataFrame, col1: str, col2: str, keys: Sequence[str], n: int = 200, seed: int = 42) -> DataFrame:
    """A10: up to n complete (x, y) points in a reproducible pseudo-random order (distributed top-n)."""
    d = df.where(F.col(col1).isNotNull() & F.col(col2).isNotNull())
    return d.orderBy(deterministic_order(keys, seed), *keys).limit(n).select(
        *keys, F.col(col1).cast("double").alias("x"), F.col(col2).cast("double").alias("y"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, group: Sequence[str] = ()) -> DataFrame:
    """R², MAE, MAPE % (a zero actual counts as denominator 1), n — one aggregate."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = y - p
    d = df.where(y.isNotNull() & p.isNotNull())
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(y) * F.count(F.lit(1))).alias("_sst"),  # numerically stable
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(F.abs(e / F.when(y == 0, F.lit(1.0)).otherwise(y))) * 100).alias("mape"),
    ]
    g = d.groupBy(*group).agg(*aggs) if group else d.agg(*aggs)
    return g.select(*group, "n_rows", (1 - F.try_divide(F.col("_sse"), F.col("_sst"))).alias("r2"), "mae", "mape")


def first_rows(df: DataFrame, keys: Sequence[str], n: int = 50) -> DataFrame:
    """First n rows in key order (distributed top-n, no global sort)."""
    return df.orderBy(*keys).limit(n)
