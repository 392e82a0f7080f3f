"""Aliases that last (P2): an append-only dimension of private values.

Each commit adds a table of new values, numbered in value order behind the largest number so far, and a
version file that names it.  A version file is made only where there is none, so of two
writers that start from one version one wins; the other reads the winner's values
and tries again.  Old aliases never change, and a table without a version file counts for nobody.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuelens.operators.privacy import KEEP_AS_IS, PREFIX, column_kind, dense_index
from valuelens.session import broadcast_limit_rows

ALIASES = "kind string, value string, number long"
MAX_TRIES = 20


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _claim(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this text if there is none of the name; whether it was made."""
    fs, p = _file(spark, path)
    try:
        out = fs.create(p, False)
    except Exception:
        if fs.exists(p):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _versions(spark: SparkSession, root: str) -> list[dict]:
    """Committed versions in order."""
    fs, p = _file(spark, f"{root}/versions")
    if not fs.exists(p):
        return []
    found = []
    for r in spark.read.text(f"{root}/versions", wholetext=True).select("value").collect():  # one row per commit
        if r["value"]:  # a claim whose text is not there yet is in the making
            found.append(json.loads(r["value"]))
    found.sort(key=lambda v: v["version"])
    return found


def aliases(spark: SparkSession, root: str) -> DataFrame:
    """(kind, value, alias) of all commits."""
    tables = [f"{root}/data/{v['table']}" for v in _versions(spark, root) if v["table"]]
    rows = spark.read.schema(ALIASES).parquet(*tables) if tables else spark.createDataFrame([], ALIASES)
    prefix = F.create_map(*[x for k, v in PREFIX.items() for x in (F.lit(k), F.lit(v))])
    return rows.select("kind", "value", F.concat(prefix[F.col("kind")], F.col("number").cast("string")).alias("alias"))


def private_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(kind, value): the distinct addresses, cities and districts of the text columns."""
    cols = [c for c in (columns or df.columns) if column_kind(c) in PREFIX and isinstance(df.schema[c].dataType, T.StringType)]
    if not cols:
        return df.sparkSession.createDataFrame([], "kind string, value string")
    pairs = F.explode(F.array(*[F.struct(F.lit(column_kind(c)).alias("kind"), F.col(f"`{c}`").alias("value")) for c in cols])).alias("x")
    return df.select(pairs).select("x.*").where((F.col("value").isNotNull()) & (F.col("value") != "") & ~F.col("value").isin(KEEP_AS_IS)).distinct()


def extend(df: DataFrame, root: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Give the frame's new values aliases and return all (kind, value, alias)."""
    spark = df.sparkSession
    wanted = private_values(df, columns)
    for _ in range(MAX_TRIES):
        versions = _versions(spark, root)
        known = aliases(spark, root).select("kind", "value")
        new = wanted.join(known, ["kind", "value"], "left_anti").persist()
        try:
            kinds = sorted(r[0] for r in new.select("kind").distinct().collect())  # three at most
            if not kinds:
                return aliases(spark, root)
            last = versions[-1]["last"] if versions else {}
            parts, most = [], dict(last)
            for kind in kinds:
                numbered = dense_index(new.where(F.col("kind") == kind), "value")
                parts.append(numbered.select(F.lit(kind).alias("kind"), "value", (F.col("_idx") + last.get(kind, 0)).alias("number")))
            table, version = uuid.uuid4().hex, (versions[-1]["version"] if versions else 0) + 1
            reduce(DataFrame.union, parts).write.parquet(f"{root}/data/{table}")
            for r in spark.read.schema(ALIASES).parquet(f"{root}/data/{table}").groupBy("kind").agg(F.max("number").alias("n")).collect():
                most[r["kind"]] = r["n"]
            if _claim(spark, f"{root}/versions/{version:012d}.json", json.dumps({"version": version, "table": table, "last": most})):
                return aliases(spark, root)
        finally:
            new.unpersist()
    raise RuntimeError(f"{MAX_TRIES} other writers committed to {root} in the meantime")


def mask_lasting(df: DataFrame, root: str, enabled: bool = True, round_prediction: str | None = None) -> DataFrame:
    """P3 with aliases kept under ``root``: masking another frame later gives known values the same aliases."""
    from valuelens.operators.privacy import mask

    if not enabled:
        return df
    known = extend(df, root)
    small = known.limit(broadcast_limit_rows(df.sparkSession) + 1).count() <= broadcast_limit_rows(df.sparkSession)
    return mask(df, True, F.broadcast(known) if small else known, round_prediction)
