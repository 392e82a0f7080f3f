"""Dataset management over the tagged table.

The working table is an ordinary DataFrame with ``_source``, ``_file_type``
and ``_sample_weight`` columns; the exclusion set is a small Python list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGS = ["_source", "_file_type", "_sample_weight"]


def tag(df: DataFrame, source: str, file_type: str = "listings", weight: float | None = None) -> DataFrame:
    """Tag every row with its source, type and sample weight (default 3 for sold, else 1)."""
    w = weight if weight is not None else (3.0 if file_type == "sold" else 1.0)
    return df.withColumn("_source", F.lit(source)).withColumn("_file_type", F.lit(file_type)).withColumn("_sample_weight", F.lit(float(w)))


def _reconcile(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns present in both with clashing types become STRING before the union."""
    ta = {f.name: f.dataType for f in a.schema.fields}
    tb = {f.name: f.dataType for f in b.schema.fields}
    clash = [c for c in ta if c in tb and ta[c] != tb[c]]
    for c in clash:
        a = a.withColumn(c, F.col(c).cast(T.StringType()))
        b = b.withColumn(c, F.col(c).cast(T.StringType()))
    return a, b


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name, missing columns filled with NULL."""
    out = frames[0]
    for f in frames[1:]:
        out, f = _reconcile(out, f)
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def append_source(existing: DataFrame | None, new: DataFrame, source: str, file_type: str = "listings", weight: float | None = None) -> DataFrame:
    """Append a tagged dataset; an untagged existing table is retro-tagged primary/listings/1.0."""
    new = tag(new, source, file_type, weight)
    if existing is None:
        return new
    if "_source" not in existing.columns:
        existing = tag(existing, "primary", "listings", 1.0)
    return union_sources([existing, new])


def source_summary(df: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Rows, type, weight, excluded flag per source, plus the active-row total."""
    per = df.groupBy("_source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("_file_type").alias("file_type"),
        F.min("_sample_weight").alias("weight"),
    )
    per = per.withColumn("excluded", F.col("_source").isin(list(excluded)) if excluded else F.lit(False))
    total = per.where(~F.col("excluded")).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("total_active_rows"))
    return per.crossJoin(F.broadcast(total)).withColumnRenamed("_source", "source")  # one row per source, total is one row


def toggle(excluded: Sequence[str], source: str) -> list[str]:
    """Flip a source in/out of the exclusion list."""
    ex = list(excluded)
    return [s for s in ex if s != source] if source in ex else ex + [source]


def remove_source(df: DataFrame, source: str) -> DataFrame:
    """Drop a source's rows; untagged rows stay."""
    return df.where(~F.col("_source").eqNullSafe(source))


def set_weight(df: DataFrame, source: str, weight: float) -> DataFrame:
    """Set the sample weight of one source."""
    return df.withColumn("_sample_weight", F.when(F.col("_source") == source, F.lit(float(weight))).otherwise(F.col("_sample_weight")))
