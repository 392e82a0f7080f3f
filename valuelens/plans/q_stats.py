"""Queries for statistics/profile operators (A, C, O)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valuelens.operators.impact import category_impact
from valuelens.plans.listing import lineitem_part, table
from valuelens.plans.registry import query

# ---------------------------------------------------------------- A4 A6 (flagship)
_CI_COLS = ["l_returnflag", "l_linestatus", "p_type", "p_brand"]


def _ci_sql(base: str, cols: list[str], target: str, long_expr) -> str:
    parts = " UNION ALL ".join(long_expr(c) for c in cols)
    return f"""
WITH base AS ({base}),
long AS ({parts}),
g AS (SELECT cat_column, cat_value, avg(t) AS m, median(t) AS med, count(*) AS n, min(t) AS mn, max(t) AS mx
      FROM long GROUP BY cat_column, cat_value HAVING count(*) >= 5),
om AS (SELECT avg(t) AS om, median(t) AS omed FROM base),
r AS (SELECT cat_column, cat_value, round_even(m, 0) AS mean_target, round_even(med, 0) AS median_target,
             n AS n_rows, round_even(mn, 0) AS min_target, round_even(mx, 0) AS max_target,
             round_even((m - om) / om * 100 * 10.0, 0) / 10.0 AS pct_diff, round_even(om, 0) AS overall_mean, round_even(omed, 0) AS overall_median
      FROM g CROSS JOIN om),
pc AS (SELECT cat_column, count(*) AS n_categories,
              CASE WHEN count(*) > 1 THEN stddev_pop(mean_target) ELSE 0 END AS sp FROM r GROUP BY cat_column)
SELECT r.*, pc.n_categories, round_even(pc.sp * 100.0, 0) / 100.0 AS column_spread FROM r JOIN pc USING (cat_column)
"""


CATEGORY_IMPACT_SQL = _ci_sql(
    "SELECT l_returnflag, l_linestatus, p_type, p_brand, l_extendedprice AS t FROM lineitem JOIN part ON l_partkey = p_partkey",
    _CI_COLS,
    "t",
    lambda c: f"SELECT '{c}' AS cat_column, trim(CAST({c} AS VARCHAR)) AS cat_value, t FROM base WHERE {c} IS NOT NULL AND t IS NOT NULL",
)


@query("category_impact", "A4 A6", CATEGORY_IMPACT_SQL)
def q_category_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category impact of returnflag/linestatus/type/brand on the extended price."""
    return category_impact(lineitem_part(spark, sf_dir), "l_extendedprice", _CI_COLS)


CATEGORY_IMPACT_MULTI_SQL = _ci_sql(
    "SELECT p_name, p_retailprice AS t FROM part",
    ["p_name"],
    "t",
    lambda c: (
        f"SELECT '{c}' AS cat_column, trim(tok) AS cat_value, t FROM "
        f"(SELECT unnest(string_split(CAST({c} AS VARCHAR), ' ')) AS tok, t FROM base WHERE {c} IS NOT NULL AND t IS NOT NULL) "
        "WHERE trim(tok) <> ''"
    ),
)


@query("category_impact_multi", "A5", CATEGORY_IMPACT_MULTI_SQL)
def q_category_impact_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-value variant: p_name split on spaces, tokens vs retail price."""
    return category_impact(table(spark, sf_dir, "part"), "p_retailprice", ["p_name"], delimiter=" ")


# ---------------------------------------------------------------- A1 A2 A3
from pyspark.sql import functions as F  # noqa: E402

from valuelens.functions.exprs import rnd, sql_rnd  # noqa: E402
from valuelens.operators import stats as ST  # noqa: E402
from valuelens.operators.impact import value_counts  # noqa: E402
from valuelens.operators.quantiles import group_quantiles  # noqa: E402
from valuelens.sources import manage as M  # noqa: E402

_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "sold", "const_col"]
_CORR_BASE = ("SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) AS sold, "
              "CAST(1 AS DOUBLE) AS const_col FROM lineitem")


def _corr_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sold"), F.lit(1.0).alias("const_col"))


def _corr_matrix_sql() -> str:
    rows = []
    for i, a in enumerate(_CORR_COLS):
        for j, b in enumerate(_CORR_COLS):
            r = f"corr({a}, {b})"
            val = f"coalesce(CASE WHEN isnan({r}) THEN NULL ELSE {sql_rnd(r, 4)} END, 0.0)"
            rows.append(f"SELECT '{a}' AS col1, '{b}' AS col2, {i} AS i, {j} AS j, {val} AS correlation FROM base")
    return f"WITH base AS ({_CORR_BASE}), m AS ({' UNION ALL '.join(rows)})"


def _strength_sql(x: str) -> str:
    return (f"CASE WHEN {x} >= 0.9 THEN 'very strong' WHEN {x} >= 0.7 THEN 'strong' WHEN {x} >= 0.5 THEN 'moderate' "
            f"WHEN {x} >= 0.3 THEN 'weak' ELSE 'very weak' END")


@query("correlation_matrix", "A1", _corr_matrix_sql() + " SELECT * FROM m")
def q_correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.correlation_matrix(_corr_frame(spark, sf_dir), _CORR_COLS)


_PAIRS_SQL = (_corr_matrix_sql() + ", p AS (SELECT col1, col2, correlation, " + _strength_sql("abs(correlation)") +
              " AS strength, CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END AS direction FROM m "
              "WHERE i < j AND abs(correlation) >= 0.3 {focus})")


@query("correlation_pairs", "A2", _PAIRS_SQL.format(focus="") + " SELECT * FROM p")
def q_correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.correlation_pairs(ST.correlation_matrix(_corr_frame(spark, sf_dir), _CORR_COLS), 0.3)


@query("correlation_focus", "A3", _PAIRS_SQL.format(focus="AND (col1 = 'l_extendedprice' OR col2 = 'l_extendedprice')") +
       ", rel AS (SELECT col1 AS c FROM p UNION SELECT col2 FROM p UNION SELECT 'l_extendedprice') "
       "SELECT col1, col2, correlation FROM m WHERE col1 IN (SELECT c FROM rel) AND col2 IN (SELECT c FROM rel)")
def q_correlation_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ST.correlation_matrix(_corr_frame(spark, sf_dir), _CORR_COLS)
    return ST.correlation_focus(m, 0.3, "l_extendedprice")


# ---------------------------------------------------------------- A10 A7 A8 A9
_LK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _order_sql(keys, seed=42) -> str:
    h = f"CAST({seed} AS BIGINT)"
    for k in keys:
        h = f"(({h}) * 1000003 + CAST({k} AS BIGINT)) % 2147483647"
    return h


@query("scatter_sample", "A10",
       f"SELECT {', '.join(_LK)}, CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem "
       f"WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL ORDER BY {_order_sql(_LK)}, {', '.join(_LK)} LIMIT 200")
def q_scatter_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.scatter_sample(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", _LK, 200, 42)


@query("value_counts", "A7", "SELECT p_brand AS value, count(*) AS n_rows FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand")
def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_counts(table(spark, sf_dir, "part"), "p_brand")


def _brand_median_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    lp = lineitem_part(spark, sf_dir)
    med = group_quantiles(lp, ["p_brand"], "l_extendedprice", [0.5], ["pred"]).select("p_brand", "pred")
    return lp.join(med, "p_brand")  # one row per brand: joined on key, AQE picks the strategy


@query("regression_metrics", "A8", (
    "WITH lp AS (SELECT l_extendedprice AS y, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), "
    "m AS (SELECT p_brand, median(y) AS pred FROM lp GROUP BY p_brand), d AS (SELECT y, pred FROM lp JOIN m USING (p_brand)) "
    f"SELECT count(*) AS n_rows, {sql_rnd('1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*))', 6)} AS r2, "
    f"{sql_rnd('avg(abs(y - pred))', 4)} AS mae, {sql_rnd('avg(abs((y - pred) / CASE WHEN y = 0 THEN 1.0 ELSE y END)) * 100', 4)} AS mape FROM d"))
def q_regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8 with the brand median as the prediction."""
    m = ST.regression_metrics(_brand_median_pred(spark, sf_dir), "l_extendedprice", "pred")
    return m.select("n_rows", rnd("r2", 6).alias("r2"), rnd("mae", 4).alias("mae"), rnd("mape", 4).alias("mape"))


@query("actual_vs_predicted", "A9", (
    "WITH m AS (SELECT p_type, median(p_retailprice) AS pred FROM part GROUP BY p_type) "
    f"SELECT p_partkey, {sql_rnd('p_retailprice', 2)} AS actual, {sql_rnd('pred', 2)} AS predicted "
    "FROM part JOIN m USING (p_type) ORDER BY p_partkey LIMIT 50"))
def q_actual_vs_predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First 50 (actual, predicted) pairs, prediction = type median retail price."""
    p = table(spark, sf_dir, "part")
    med = group_quantiles(p, ["p_type"], "p_retailprice", [0.5], ["pred"]).select("p_type", "pred")
    s = ST.first_rows(p.join(med, "p_type"), ["p_partkey"], 50)
    return s.select("p_partkey", rnd("p_retailprice", 2).alias("actual"), rnd("pred", 2).alias("predicted"))


# ---------------------------------------------------------------- S3 S5-S9 O4
def _tagged_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(*_LK, "l_extendedprice", F.col("l_returnflag").alias("_source"),
                     F.when(F.col("l_returnflag") == "R", "sold").otherwise("listings").alias("_file_type"),
                     F.when(F.col("l_returnflag") == "R", 3.0).otherwise(1.0).alias("_sample_weight"))


_TAGGED_SQL = ("SELECT l_returnflag AS _source, CASE WHEN l_returnflag = 'R' THEN 'sold' ELSE 'listings' END AS _file_type, "
               "CASE WHEN l_returnflag = 'R' THEN 3.0 ELSE 1.0 END::DOUBLE AS _sample_weight FROM lineitem")


@query("source_summary", "S6 S7", (
    f"WITH t AS ({_TAGGED_SQL}), per AS (SELECT _source AS source, count(*) AS n_rows, min(_file_type) AS file_type, "
    "min(_sample_weight) AS weight, _source IN ('A') AS excluded FROM t GROUP BY _source) "
    "SELECT *, (SELECT CAST(sum(n_rows) AS BIGINT) FROM per WHERE NOT excluded) AS total_active_rows FROM per"))
def q_source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 with source 'A' toggled off."""
    excluded = M.toggle([], "A")
    return M.source_summary(_tagged_lineitem(spark, sf_dir), excluded)


@query("source_toggle", "S7", f"SELECT {', '.join(_LK)}, l_returnflag AS _source FROM lineitem WHERE l_returnflag NOT IN ('N')")
def q_source_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from valuelens.operators.filters import working_frame

    excluded = M.toggle(M.toggle(M.toggle([], "N"), "R"), "R")  # N off, R toggled off and on again
    return working_frame(_tagged_lineitem(spark, sf_dir), excluded).select(*_LK, "_source")


@query("source_remove", "S8", f"SELECT {', '.join(_LK)}, l_returnflag AS _source FROM lineitem WHERE l_returnflag <> 'N'")
def q_source_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.remove_source(_tagged_lineitem(spark, sf_dir), "N").select(*_LK, "_source")


@query("source_weight", "S9", (
    f"WITH t AS ({_TAGGED_SQL}) SELECT _source, CASE WHEN _source = 'R' THEN 5.0 ELSE _sample_weight END::DOUBLE AS weight, "
    "count(*) AS n_rows FROM t GROUP BY ALL"))
def q_source_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = M.set_weight(_tagged_lineitem(spark, sf_dir), "R", 5.0)
    return w.groupBy("_source", F.col("_sample_weight").alias("weight")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("union_sources", "S3 S5 O4", (
    f"SELECT {', '.join(_LK)}, l_quantity, l_extendedprice, NULL::DOUBLE AS l_discount, 'primary' AS _source, "
    "'listings' AS _file_type, 1.0::DOUBLE AS _sample_weight FROM lineitem WHERE l_returnflag = 'A' UNION ALL "
    f"SELECT {', '.join(_LK)}, NULL::DOUBLE, l_extendedprice, l_discount, 'sold/R.csv', 'sold', 3.0::DOUBLE "
    "FROM lineitem WHERE l_returnflag = 'R'"))
def q_union_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An untagged primary table plus a 'sold' file with other columns, by name."""
    li = table(spark, sf_dir, "lineitem")
    primary = li.where(F.col("l_returnflag") == "A").select(*_LK, "l_quantity", "l_extendedprice")
    sold = li.where(F.col("l_returnflag") == "R").select(*_LK, "l_extendedprice", "l_discount")
    return M.append_source(primary, sold, "sold/R.csv", "sold")
