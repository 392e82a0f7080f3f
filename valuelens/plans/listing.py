"""Bind the driver's TPC-H-like test tables to the listing roles.

This module only builds stand-in input: rows in the listing schema the
operators expect (price, floor area, city, district, free-text fields...).
It does none of the operators' work.  Each column is one SQL expression so
the DuckDB oracle can build the identical view (``LISTING_SQL``).
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

# (name, Spark SQL expression, DuckDB expression or None when identical)
LISTING_COLUMNS: list[tuple[str, str, str | None]] = [
    ("l_orderkey", "l_orderkey", None),
    ("l_linenumber", "l_linenumber", None),
    ("l_partkey", "l_partkey", None),
    ("l_suppkey", "l_suppkey", None),
    ("_source", "l_returnflag", None),
    ("_file_type", "CASE WHEN l_returnflag = 'R' THEN 'sold' ELSE 'listings' END", None),
    ("_sample_weight", "CAST(CASE WHEN l_returnflag = 'R' THEN 3 ELSE 1 END AS DOUBLE)", None),
    ("price", "l_extendedprice", None),
    ("sold_price", "l_extendedprice * (1 - l_discount)", None),
    ("list_price", "p_retailprice", None),
    ("floor_area_sqft", "l_quantity", None),
    ("lot_size_sqft", "CAST(p_size AS DOUBLE) * 100", None),
    ("rooms", "CAST(p_size AS DOUBLE)", None),
    ("bedrooms", "CAST(l_linenumber AS DOUBLE)", None),
    ("bathrooms", "CAST(l_linenumber % 3 AS DOUBLE)", None),
    ("city", "n_name", None),
    ("district", "p_brand", None),
    ("property_type", "p_type", None),
    ("street", "c_name", None),
    ("year_built", "CAST(year(o_orderdate) AS DOUBLE)", None),
    ("maintenance_fee", "c_acctbal", None),
    ("days_on_market", "CAST(datediff(l_shipdate, o_orderdate) AS DOUBLE)",
     "CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS DOUBLE)"),
    ("levels", "CAST(l_linenumber AS DOUBLE)", None),
    ("latitude", "49 + CAST(c_nationkey AS DOUBLE) / 10 + CAST(c_custkey % 97 AS DOUBLE) / 1000", None),
    ("longitude", "-123.5 + CAST(n_regionkey AS DOUBLE) / 10 - CAST(c_custkey % 89 AS DOUBLE) / 1000",
     "CAST(-123.5 AS DOUBLE) + CAST(n_regionkey AS DOUBLE) / 10 - CAST(c_custkey % 89 AS DOUBLE) / 1000"),
    ("view", "CASE o_orderstatus WHEN 'F' THEN 'Water view' WHEN 'O' THEN '' END", None),
    ("fireplace", "CASE l_partkey % 4 WHEN 0 THEN '2 Gas' WHEN 1 THEN 'Wood' WHEN 2 THEN '' END", None),
    ("parking_spaces",
     "CASE WHEN l_linenumber = 7 THEN '3 Garage' ELSE 'Total spaces: ' || CAST(l_linenumber AS STRING) || ' ('"
     " || CAST(l_linenumber % 3 AS STRING) || ' covered)' || CASE o_orderstatus WHEN 'F' THEN ' Garage'"
     " WHEN 'P' THEN ' RV' ELSE '' END END", None),
    ("cooling_features", "CASE WHEN l_discount > 0.05 THEN 'Central Air' ELSE '' END", None),
    ("appliances", "CASE WHEN l_tax > 0.04 THEN 'Dishwasher, Fridge' END", None),
    ("parking_features", "CASE WHEN l_linestatus = 'O' THEN 'Garage, RV' ELSE 'No' END", None),
    ("interior_features", "replace(p_name, ' ', ', ')", None),
    ("l_linestatus", "l_linestatus", None),
    ("o_orderpriority", "o_orderpriority", None),
    ("c_mktsegment", "c_mktsegment", None),
]

_JOIN_SQL = (
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "JOIN part ON l_partkey = p_partkey "
    "JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey"
)

LISTING_SQL = "SELECT " + ", ".join(f"{duck or spark} AS {name}" for name, spark, duck in LISTING_COLUMNS) + " " + _JOIN_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


BROADCAST_ROWS = 200_000  # rows of a table that a join may send to the driver and every executor


def side(df: DataFrame) -> DataFrame:
    """A table as the smaller side of a join: broadcast up to ``BROADCAST_ROWS``, else shuffled and merged.

    The planner would go by file sizes, and a file of repeated values is a tenth of its rows or less.
    """
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def lineitem_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ part."""
    li, p = table(spark, sf_dir, "lineitem"), side(table(spark, sf_dir, "part"))
    return li.join(p, F.col("l_partkey") == F.col("p_partkey"))


def listing_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing-shaped rows over lineitem ⋈ orders ⋈ part ⋈ customer ⋈ nation.

    Customers meet their orders first, so that lineitem, by far the largest, is shuffled once by part
    and once by order.  Only tables that a count proves small are broadcast (``side``), and ``nation`` (25 rows by
    definition).
    """
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    placed = o.join(side(c), o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    j = lineitem_part(spark, sf_dir).join(placed.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.selectExpr(*[f"{spark_expr} AS {name}" for name, spark_expr, _ in LISTING_COLUMNS])


def listing_sql_cte() -> str:
    return f"listing AS ({LISTING_SQL})"


def nearby_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City adjacency stand-in: nations in the same region are nearby (incl. itself)."""
    n = table(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, F.col("a.n_regionkey") == F.col("b.n_regionkey")).select(
        F.col("a.n_name").alias("city"), F.col("b.n_name").alias("nearby")
    )


NEARBY_SQL = "SELECT a.n_name AS city, b.n_name AS nearby FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"


@lru_cache(maxsize=None)
def listing_columns() -> tuple[str, ...]:
    return tuple(name for name, _, _ in LISTING_COLUMNS)
