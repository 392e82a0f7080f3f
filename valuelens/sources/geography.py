"""Geography dimensions (S10) and the district -> city dimension join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuelens.session import broadcast_limit_rows

HIERARCHY_SCHEMA = ("country STRING, province STRING, "
                    "cities MAP<STRING, STRUCT<districts: ARRAY<STRING>, district_count: INT>>")


def read_cities(spark: SparkSession, path: str) -> DataFrame:
    """cities.json {province, country, cities[]} -> (province, country, city)."""
    d = spark.read.option("multiLine", True).json(path)
    return d.select("province", "country", F.explode("cities").alias("city"))


def read_districts(spark: SparkSession, path: str) -> DataFrame:
    """districts.json {province, country, districts[{district, city}]} -> (province, country, district, city)."""
    d = spark.read.option("multiLine", True).json(path)
    return d.select("province", "country", F.explode("districts").alias("d")).select("province", "country", "d.district", "d.city")


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """hierarchy.json city -> {districts[], district_count} -> (city, district, district_count)."""
    d = spark.read.schema(HIERARCHY_SCHEMA).option("multiLine", True).json(path)
    c = d.select("country", "province", F.explode("cities").alias("city", "v"))
    return c.select("country", "province", "city", F.explode("v.districts").alias("district"), F.col("v.district_count").alias("district_count"))


def _checked(dim: DataFrame) -> DataFrame:
    most = broadcast_limit_rows(dim.sparkSession)
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim


def attach_city(df: DataFrame, districts: DataFrame, district_col: str = "district") -> DataFrame:
    """Add the dimension's city for each row's district (the dimension is broadcast if a count proves it small)."""
    dim = districts.select(F.col("district").alias("_dim_district"), F.col("city").alias("dim_city")).distinct()
    return df.join(_checked(dim), F.col(district_col) == F.col("_dim_district"), "left").drop("_dim_district")


def unknown_districts(df: DataFrame, districts: DataFrame, district_col: str = "district") -> DataFrame:
    """J5 validation: rows whose district is not in the dimension (anti join)."""
    dim = districts.select(F.col("district").alias("_dim_district")).distinct()
    return df.join(_checked(dim), F.col(district_col) == F.col("_dim_district"), "left_anti")
