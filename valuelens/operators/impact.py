"""Category impact (A4-A6) and value counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuelens.functions.exprs import rnd, tokens
from valuelens.operators.quantiles import DEFAULT_MAX_GROUP_ROWS, group_quantiles
from valuelens.session import cut

_OVERALL = "\u0000overall"  # pseudo-column name no real column can have


def long_categories(df: DataFrame, columns: Sequence[str], target: str, delimiter: str = "") -> DataFrame:
    """Unpivot categorical columns to (cat_column, cat_value, _t).

    Rows whose category or target is null are dropped (per column).  With a
    delimiter, multi-value cells are split on it (literally), trimmed, and
    blank tokens dropped.  One Expand, no shuffle.
    """
    cols = list(columns)
    wide = df.select(F.col(target).cast("double").alias("_t"), *[F.col(c).cast("string").alias(c) for c in cols])
    long = wide.unpivot(["_t"], cols, "cat_column", "cat_value").where(F.col("cat_value").isNotNull() & F.col("_t").isNotNull())
    if delimiter:
        long = long.withColumn("cat_value", F.explode(tokens("cat_value", delimiter))).where(F.col("cat_value") != "")
    else:
        long = long.withColumn("cat_value", F.trim("cat_value"))
    return long


def category_impact(
    df: DataFrame,
    target: str,
    columns: Sequence[str],
    *,
    delimiter: str = "",
    min_count: int = 5,
    max_group_rows: int = DEFAULT_MAX_GROUP_ROWS,
) -> DataFrame:
    """Per (column, value): mean/median/count/min/max of the target, % vs overall mean.

    Values are rounded as the reference reports them (0 dp half-even, pct 1 dp);
    groups with fewer than ``min_count`` rows are dropped; ``column_spread`` is
    the population std of the rounded group means of the column (0 with <= 1
    group) and orders the columns, ``n_categories`` counts surviving groups.
    """
    df = df.select(*dict.fromkeys([target, *columns])).persist()  # kept wide: unpivoted it would be a row per column
    long = long_categories(df, columns, target, delimiter)
    # the overall statistics ride along as one more "column" of the same passes (no extra scan)
    overall = df.select(F.lit(_OVERALL).alias("cat_column"), F.lit("").alias("cat_value"), F.col(target).cast("double").alias("_t"))
    long = long.unionByName(overall.where(F.col("_t").isNotNull()))
    stats = group_quantiles(
        long,
        ["cat_column", "cat_value"],
        "_t",
        [0.5],
        ["_median"],
        extra={"_mean": "avg", "_min": "min", "_max": "max"},
        max_group_rows=max_group_rows,
        keep=False,
    )
    stats = cut(stats, "impact")  # read three times below
    om = stats.where(F.col("cat_column") == _OVERALL).select(F.col("_mean").alias("_om"), F.col("_median").alias("_omed"))
    g = stats.where((F.col("cat_column") != _OVERALL) & (F.col("_n") >= min_count)).crossJoin(F.broadcast(om))  # om: one row
    g = g.select(
        "cat_column",
        "cat_value",
        rnd("_mean", 0, even=True).alias("mean_target"),
        rnd("_median", 0, even=True).alias("median_target"),
        F.col("_n").alias("n_rows"),
        rnd("_min", 0, even=True).alias("min_target"),
        rnd("_max", 0, even=True).alias("max_target"),
        rnd(F.try_divide(F.col("_mean") - F.col("_om"), F.col("_om")) * 100, 1, even=True).alias("pct_diff"),
        rnd("_om", 0, even=True).alias("overall_mean"),
        rnd("_omed", 0, even=True).alias("overall_median"),
    )
    per_col = g.groupBy("cat_column").agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.when(F.count(F.lit(1)) > 1, F.stddev_pop("mean_target")).otherwise(F.lit(0.0)).alias("_spread"),
    )
    return g.join(per_col, "cat_column").withColumn("column_spread", rnd("_spread", 2, even=True)).drop("_spread")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per category value (nulls ignored), as the reference's value_counts."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
