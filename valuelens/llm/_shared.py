"""Helpers of the operators: checked broadcasts, the read of a table, and the session's cut in the lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuelens import session
from valuelens.session import cut

__all__ = ["cut", "ship_package", "sized_broadcast", "table"]

TEXT_ROWS = 2000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in tasks, and let no batch of whole texts hold more than ``TEXT_ROWS`` rows."""
    session.ship_package(spark)
    rows = int(spark.conf.get(_ROWS_SETTING))
    if rows <= 0 or rows > TEXT_ROWS:
        spark.conf.set(_ROWS_SETTING, str(TEXT_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized_broadcast(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if a count (capped just over the bound) proves it small, else unmarked."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
