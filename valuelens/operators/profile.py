"""Dataset profile (C5-C14): long-format tables from a few wide aggregates.

Every per-column statistic is computed for all columns in one pass (wide
``agg``) or over an unpivoted (column, value) table so one shuffle serves all
columns.  Value lists are collected only after their size is known to be
bounded (the filterable-value rule caps them at 50/120).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valuelens.functions.exprs import rnd, tokens
from valuelens.operators.clean import categorical_columns, is_numeric
from valuelens.operators.quantiles import DEFAULT_MAX_GROUP_ROWS, group_quantiles, quantile_row

# Fixed values from the reference.
CITY_NAMES_UPLOAD = ("city", "місто", "town", "municipality")  # compared lower-case
CITY_NAMES_META = ("city", "City", "municipality")  # exact
FILTER_SKIP_PARTS = ["real_mls", "mls", "street", "address", "summary_url", "virtual_tour",
                     "agency", "brokerage", "property_taxes", "tax_year", "lot_frontage_ft",
                     "listing_agent", "photo_count", "photos"]
FILTER_SKIP_EXACT = ["real_mls", "mls", "street", "address", "summary_url", "virtual_tour",
                     "_source", "_file_type", "listing_id"]
DROP_TOKENS = ["nan", "unknown", ""]
LOCATION_COLUMNS = ("district", "city")


def null_rates(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 3) -> DataFrame:
    """(column_name, null_rate) from one aggregate."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "null_rate").select("column_name", rnd("null_rate", digits).alias("null_rate"))


def _long_strings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "value")


def _long_typed(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value) with value = struct<d double, s string>: numbers stay numbers
    (no text conversion per value), text stays text; NULL cells have both fields NULL."""
    vals = []
    for c in cols:
        if is_numeric(df, c):
            v = F.struct(F.col(c).cast("double").alias("d"), F.lit(None).cast("string").alias("s"))
        else:
            v = F.struct(F.lit(None).cast("double").alias("d"), F.col(c).cast("string").alias("s"))
        vals.append(v.alias(c))
    long = df.select(*vals).unpivot([], list(cols), "column_name", "value")
    return long.withColumn("_isnull", F.col("value.d").isNull() & F.col("value.s").isNull())


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False, max_categorical: int = 200) -> DataFrame:
    """C6 (+C12 flag): distinct non-null values per column.

    Exact path: unpivot, distinct (column, value) with map-side combine, then a
    count per column - two shuffles for any number of columns, no per-column
    Expand blow-up.  ``approx`` uses HyperLogLog++ in one pass instead.
    """
    cols = list(columns or categorical_columns(df))
    if approx:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols])
        out = wide.unpivot([], cols, "column_name", "n_distinct")
    else:
        long = _long_typed(df, cols).where(~F.col("_isnull"))
        out = long.select("column_name", "value").distinct().groupBy("column_name").agg(F.count(F.lit(1)).alias("n_distinct"))
        present = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string")
        out = present.join(out, "column_name", "left").fillna(0, ["n_distinct"])
    return out.select("column_name", F.col("n_distinct").cast("long"), (F.col("n_distinct") <= max_categorical).alias("listed_as_categorical"))


def filter_values(df: DataFrame, columns: Sequence[str] | None = None, split: bool = True, limit: int = 50, location_limit: int = 120) -> DataFrame:
    """C7 (split=True) / C8 (split=False): filterable categorical values.

    C7 splits cells on ',', trims, drops nan/unknown/blank (case-insensitive),
    uses the substring skip-list and a 120 limit for district/city.  C8 keeps
    whole cells, the exact-name skip-list and limit 50.  A column qualifies with
    2..limit values; values come back sorted and joined by '|'.
    """
    cols = list(columns or categorical_columns(df))
    if split:
        cols = [c for c in cols if not any(s in c.lower() for s in FILTER_SKIP_PARTS)]
    else:
        cols = [c for c in cols if c not in FILTER_SKIP_EXACT]
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, n_values long, filter_values string")
    long = _long_strings(df, cols)
    if split:
        long = long.withColumn("value", F.explode(tokens(F.coalesce("value", F.lit("")), ",")))
        long = long.where(~F.lower("value").isin(DROP_TOKENS))
    else:
        long = long.where(F.col("value").isNotNull())
    distinct = long.select("column_name", "value").distinct()
    lim = F.when(F.col("column_name").isin(list(LOCATION_COLUMNS)), location_limit).otherwise(limit) if split else F.lit(limit)
    sizes = distinct.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_values")).where((F.col("n_values") >= 2) & (F.col("n_values") <= lim))
    bounded = distinct.join(sizes, "column_name")  # only columns with <= limit values survive
    return bounded.groupBy("column_name", "n_values").agg(
        F.array_join(F.array_sort(F.collect_list("value")), "|").alias("filter_values")
    )


def city_districts(df: DataFrame, city: str = "city", district: str = "district", upload_rules: bool = True) -> DataFrame:
    """City -> sorted distinct districts ('|'-joined).

    Upload rules: skip blank city/district and rows where city equals district
    (both trimmed); the meta variant keeps every non-null district per city.
    """
    if upload_rules:
        c = F.trim(F.coalesce(F.col(city).cast("string"), F.lit("")))
        d = F.trim(F.col(district).cast("string"))
        pairs = df.where(F.col(district).isNotNull()).select(c.alias("city"), d.alias("district"))
        pairs = pairs.where((F.col("city") != "") & (F.col("district") != "") & (F.col("city") != F.col("district")))
    else:
        pairs = df.where(F.col(city).isNotNull() & F.col(district).isNotNull()).select(
            F.col(city).cast("string").alias("city"), F.col(district).cast("string").alias("district"))
    distinct = pairs.distinct()
    return distinct.groupBy("city").agg(
        F.count(F.lit(1)).alias("n_districts"),
        F.array_join(F.array_sort(F.collect_list("district")), "|").alias("districts"),
    )


def detect_city_column(df: DataFrame, upload_rules: bool = True) -> str | None:
    """City column by name (upload: any case of city/місто/town/municipality)."""
    if upload_rules:
        return next((c for c in df.columns if c.lower() in CITY_NAMES_UPLOAD), None)
    return next((c for c in CITY_NAMES_META if c in df.columns), None)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values of a column."""
    return df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()


def dataset_profile(df: DataFrame) -> DataFrame:
    """C11: one row per column: position, kind, null rate, distinct count (categorical columns), row count.

    ``df`` is read once: categorical columns are unpivoted to (column, value) and counted per
    value, and so is one more column that says which numeric columns a row has filled (a
    character each).  Sums of these counts are the rows and the filled cells of every column.
    The reference asks for no distinct count of numeric columns; there it is NULL.
    """
    cols = df.columns
    numeric = [i for i, c in enumerate(cols) if is_numeric(df, c)]
    text = [i for i in range(len(cols)) if i not in numeric]
    kinds = df.sparkSession.createDataFrame(
        [(c, i, "numeric" if i in numeric else "categorical") for i, c in enumerate(cols)],
        "column_name string, position int, kind string",
    )
    marks = F.concat(F.lit(""), *[F.when(F.col(cols[i]).isNull(), "0").otherwise("1") for i in numeric])
    cells = df.select(*[F.col(cols[i]).cast("string").alias(str(i)) for i in text], marks.alias("marks"))
    values = cells.unpivot([], cells.columns, "_c", "_v").where(F.col("_v").isNotNull()).groupBy("_c", "_v").agg(F.count(F.lit(1)).alias("_n"))
    found = {i: F.col("_c") == str(i) for i in text} | {i: (F.col("_c") == "marks") & (F.substring("_v", k + 1, 1) == "1") for k, i in enumerate(numeric)}
    sums = values.agg(
        F.coalesce(F.sum(F.when(F.col("_c") == "marks", F.col("_n"))), F.lit(0)).alias("n_rows"),
        *[F.coalesce(F.sum(F.when(found[i], F.col("_n"))), F.lit(0)).alias(f"c{i}") for i in range(len(cols))],
        *[F.count(F.when(found[i], 1)).alias(f"d{i}") for i in text],
    )
    per = [F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("filled"), (F.col(f"d{i}") if i in text else F.lit(None).cast("long")).alias("n_distinct")) for i, c in enumerate(cols)]
    filled = sums.select("n_rows", F.explode(F.array(*per)).alias("x"))
    rate = filled.select("x.column_name", "n_rows", rnd((F.col("n_rows") - F.col("x.filled")) / F.col("n_rows"), 3).alias("null_rate"), "x.n_distinct")
    return kinds.join(F.broadcast(rate), "column_name")  # one row per column


def typical_numeric(df: DataFrame, columns: Sequence[str], max_group_rows: int = DEFAULT_MAX_GROUP_ROWS) -> DataFrame:
    """C13 numeric part: median/mean/min/max/p25/p75 (2 dp) per column, one grouped pass."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "_x")
    q = group_quantiles(long, ["column_name"], "_x", [0.5, 0.25, 0.75], ["_med", "_p25", "_p75"],
                        extra={"_mean": "avg", "_min": "min", "_max": "max"}, max_group_rows=max_group_rows)
    return q.select("column_name", *[rnd(c, 2).alias(c[1:]) for c in ["_med", "_mean", "_min", "_max", "_p25", "_p75"]]).withColumnRenamed("med", "median")


def typical_categorical(df: DataFrame, columns: Sequence[str], top: int = 3) -> DataFrame:
    """C13 categorical part: mode, top-3 ('|'-joined), distinct count.

    Counts per (column, value) are map-side combined; the ranking window only
    sees one row per distinct value, ties broken by the value.
    """
    long = _long_strings(df, columns).where(F.col("value").isNotNull())
    vc = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    ranked = vc.withColumn("rk", F.row_number().over(w))
    topk = ranked.where(F.col("rk") <= top).groupBy("column_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "value"))), lambda s: s["value"]), "|").alias("top3"),
        F.min_by("value", "rk").alias("mode"),
    )
    nu = vc.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_unique"))
    return topk.join(nu, "column_name")


def typical_row(df: DataFrame, target: str, key: Sequence[str], columns: Sequence[str], max_group_rows: int = DEFAULT_MAX_GROUP_ROWS) -> DataFrame:
    """C14: the row whose target is closest to the target median (ties: smallest key).

    Median from the distributed exact quantile operator, one-row broadcast,
    then a distributed top-1 (TakeOrderedAndProject), no full sort.
    """
    t = F.col(target).cast("double")
    med = quantile_row(df.select(t.alias("_t")), "_t", [0.5], ["_median"], max_group_rows=max_group_rows)
    j = df.crossJoin(F.broadcast(med.select("_median")))
    dist = F.abs(t - F.col("_median"))
    return j.where(t.isNotNull()).orderBy(dist.asc(), *[F.col(k).asc() for k in key]).limit(1).select(*key, *columns, F.round("_median", 2).alias("median_target"))
