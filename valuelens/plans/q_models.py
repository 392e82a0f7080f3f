"""Queries for encoders (E) and linear models (M1, M5-M7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuelens.functions.exprs import rnd, sql_rnd
from valuelens.operators import encode as E
from valuelens.operators import linear as L
from valuelens.operators import stats as ST
from valuelens.plans.listing import lineitem_part, table
from valuelens.plans.registry import query

LK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def order_sql(keys, seed=42) -> str:
    h = f"CAST({seed} AS BIGINT)"
    for k in keys:
        h = f"(({h}) * 1000003 + CAST({k} AS BIGINT)) % 2147483647"
    return h


FOLD5_SQL = f"({order_sql(LK)}) % 5"


def _li(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


# ------------------------------------------------------------------ M1
@query("linear_fit", "M1", (
    f"SELECT {sql_rnd('regr_intercept(l_extendedprice, l_quantity)', 6)} AS intercept, "
    f"{sql_rnd('regr_slope(l_extendedprice, l_quantity)', 6)} AS slope, count(*) AS n_train FROM lineitem"))
def q_linear_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1: OLS of price on quantity from one moments pass."""
    c = L.fit_linear(_li(spark, sf_dir), ["l_quantity"], "l_extendedprice")
    return c.where(F.col("_fold") == L.FULL).select(rnd("_intercept", 6).alias("intercept"), rnd(F.col("_coef")[0], 6).alias("slope"),
                                                    F.col("_n_train").cast("long").alias("n_train"))


_CV_SQL = (
    f"WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y, {FOLD5_SQL} AS fold FROM lineitem), "
    "f AS (SELECT DISTINCT fold AS k FROM d), "
    "m AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f JOIN d ON d.fold <> f.k GROUP BY k), "
    "p AS (SELECT y, a + b * x AS pred FROM d JOIN m ON d.fold = m.k) "
    f"SELECT count(*) AS n_rows, {sql_rnd('1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*))', 6)} AS r2, "
    f"{sql_rnd('avg(abs(y - pred))', 4)} AS mae, {sql_rnd('avg(abs((y - pred) / CASE WHEN y = 0 THEN 1.0 ELSE y END)) * 100', 4)} AS mape FROM p"
)


@query("linear_cv", "M7 A8", _CV_SQL)
def q_linear_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: 5-fold out-of-fold predictions (folds from key arithmetic) and CV metrics."""
    d = _li(spark, sf_dir).withColumn("_fold", L.fold_column(LK, 5))
    coefs = L.fit_linear(d, ["l_quantity"], "l_extendedprice", fold="_fold")
    pred = L.predict(d, coefs, ["l_quantity"], fold="_fold")
    m = ST.regression_metrics(pred, "l_extendedprice", "prediction")
    return m.select("n_rows", rnd("r2", 6).alias("r2"), rnd("mae", 4).alias("mae"), rnd("mape", 4).alias("mape"))


_LOG_SQL = (
    f"WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y, ln(1 + l_extendedprice) AS ly, {FOLD5_SQL} AS fold FROM lineitem), "
    "ok AS (SELECT min(y) > 0 AS use_log FROM d), "
    "m AS (SELECT regr_slope(ly, x) AS b, regr_intercept(ly, x) AS a FROM d WHERE fold <> 0), "
    "p AS (SELECT y, exp(a + b * x) - 1 AS pred FROM d, m WHERE fold = 0) "
    f"SELECT count(*) AS n_test, (SELECT use_log FROM ok) AS use_log, "
    f"{sql_rnd('1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*))', 6)} AS r2, {sql_rnd('avg(abs(y - pred))', 4)} AS mae FROM p"
)


@query("linear_log_holdout", "M5 M6", _LOG_SQL)
def q_linear_log_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5+M6: log1p target (all prices > 0), 80/20 holdout by key arithmetic, metrics after expm1."""
    from valuelens.operators.models import holdout_linear

    d = _li(spark, sf_dir)
    res = holdout_linear(d, ["l_quantity"], "l_extendedprice", LK, use_log=True)
    return res.select("n_test", "use_log", rnd("r2", 6).alias("r2"), rnd("mae", 4).alias("mae"))


_WEIGHTED_SQL = (
    "WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y, CASE WHEN l_returnflag = 'R' THEN 3.0 ELSE 1.0 END AS w FROM lineitem), "
    "m AS (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM d), "
    "b AS (SELECT sum(w * (x - mx) * (y - my)) / sum(w * (x - mx) * (x - mx)) AS slope FROM d, m) "
    f"SELECT {sql_rnd('my - slope * mx', 4)} AS intercept, {sql_rnd('slope', 6)} AS slope, (SELECT sum(w) FROM d)::BIGINT AS weight FROM b, m"
)


@query("linear_fit_weighted", "M1 S9", _WEIGHTED_SQL)
def q_linear_fit_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 with sample weights (S9): sold rows count three times."""
    d = _li(spark, sf_dir).withColumn("_sample_weight", F.when(F.col("l_returnflag") == "R", 3.0).otherwise(1.0))
    c = L.fit_linear(d, ["l_quantity"], "l_extendedprice", weight="_sample_weight")
    return c.select(rnd("_intercept", 4).alias("intercept"), rnd(F.element_at("_coef", 1), 6).alias("slope"), F.col("_n_train").alias("weight"))


# ------------------------------------------------------------------ E1-E9
_ENC_FEATURES = ["p_type", "p_brand", "p_name_multi", "p_size", "p_container_null"]


def _enc_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", "p_type", "p_brand", F.regexp_replace("p_name", " ", ", ").alias("p_name_multi"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit(None)).otherwise(F.col("p_size")).cast("double").alias("p_size"),
        F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("C"), (F.col("p_partkey") % 4).cast("string"))).alias("p_container_null"),
        "p_retailprice",
    )


_ENC_INPUT_SQL = (
    "SELECT p_partkey, p_type, p_brand, replace(p_name, ' ', ', ') AS p_name_multi, "
    "CAST(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS DOUBLE) AS p_size, "
    "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'C' || CAST(p_partkey % 4 AS VARCHAR) END AS p_container_null, p_retailprice FROM part"
)


@query("encode_plan", "E1", (
    f"WITH e AS ({_ENC_INPUT_SQL}), t AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(DISTINCT coalesce(CAST({c} AS VARCHAR), 'Unknown')) AS n_distinct, "
        f"count(CASE WHEN contains(coalesce(CAST({c} AS VARCHAR), 'Unknown'), ',') THEN 1 END) AS n_comma_cells FROM e"
        for c in ["p_type", "p_brand", "p_name_multi", "p_container_null"])
    + ") SELECT feature, CASE WHEN n_comma_cells >= 3 THEN 'multi_ohe' WHEN n_distinct > 15 THEN 'target' ELSE 'label' END AS kind, "
    "n_distinct, n_comma_cells FROM t UNION ALL SELECT 'p_size', 'numeric', NULL, NULL"))
def q_encode_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.encoder_plan(_enc_input(spark, sf_dir), _ENC_FEATURES)


def _encoded(spark: SparkSession, sf_dir: str, mode: str = "fit") -> tuple[DataFrame, E.Encoders]:
    d = _enc_input(spark, sf_dir)
    enc = E.fit_encoders(d, _ENC_FEATURES, "p_retailprice")
    return enc.transform(d, mode), enc


@query("encode_label", "E2 E8", (
    f"WITH e AS ({_ENC_INPUT_SQL}), f AS (SELECT p_partkey, coalesce(p_type, 'Unknown') AS t, coalesce(p_container_null, 'Unknown') AS c FROM e), "
    "ct AS (SELECT t, CAST(row_number() OVER (ORDER BY t) - 1 AS DOUBLE) AS it FROM (SELECT DISTINCT t FROM f)), "
    "cc AS (SELECT c, CAST(row_number() OVER (ORDER BY c) - 1 AS DOUBLE) AS ic FROM (SELECT DISTINCT c FROM f)) "
    "SELECT p_partkey, it AS x__p_type, ic AS x__p_container_null FROM f JOIN ct USING (t) JOIN cc USING (c)"))
def q_encode_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index in the sorted classes; nulls are the class 'Unknown' when fitting."""
    d, _ = _encoded(spark, sf_dir)
    return d.select("p_partkey", "x__p_type", "x__p_container_null")


@query("encode_onehot", "E3", (
    f"WITH e AS ({_ENC_INPUT_SQL}), toks AS (SELECT p_partkey, list_transform(string_split(coalesce(p_name_multi, 'Unknown'), ','), lambda x: trim(x)) AS tl FROM e), "
    "v AS (SELECT DISTINCT trim(t) AS tok FROM (SELECT unnest(string_split(coalesce(p_name_multi, 'Unknown'), ',')) AS t FROM e) "
    "WHERE lower(trim(t)) NOT IN ('nan', 'unknown', '')) "
    "SELECT p_partkey, string_agg(CASE WHEN list_contains(tl, tok) THEN '1' ELSE '0' END, '' ORDER BY tok) AS onehot FROM toks, v GROUP BY p_partkey"))
def q_encode_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary indicator per sorted token, emitted as one bit string per row."""
    d, enc = _encoded(spark, sf_dir)
    spec = next(s for s in enc.specs if s.kind == "multi_ohe")
    bits = F.concat(*[F.col(c).cast("int").cast("string") for c in spec.out])
    return d.select("p_partkey", bits.alias("onehot"))


@query("encode_target", "E4 J1", (
    f"WITH e AS ({_ENC_INPUT_SQL}), s AS (SELECT coalesce(p_brand, 'Unknown') AS b, median(p_retailprice) AS med FROM e GROUP BY 1), "
    "g AS (SELECT median(p_retailprice) AS gm FROM e) "
    f"SELECT p_partkey, {sql_rnd('coalesce(med, gm)', 4)} AS x__p_brand FROM e LEFT JOIN s ON coalesce(p_brand, 'Unknown') = s.b, g"))
def q_encode_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-brand median retail price, global median for unseen brands (J1 join)."""
    d, _ = _encoded(spark, sf_dir)
    return d.select("p_partkey", rnd("x__p_brand", 4).alias("x__p_brand"))


@query("encode_target_oof", "E7", (
    f"WITH e AS ({_ENC_INPUT_SQL}), d AS (SELECT p_partkey, coalesce(p_brand, 'Unknown') AS b, p_retailprice AS y, "
    "(((42 * 1000003 + p_partkey) % 2147483647) % 5) AS fold FROM e), f AS (SELECT DISTINCT fold AS k FROM d), "
    "s AS (SELECT k, b, median(y) AS med FROM f JOIN d ON d.fold <> f.k GROUP BY k, b), "
    "g AS (SELECT k, median(y) AS gm FROM f JOIN d ON d.fold <> f.k GROUP BY k) "
    f"SELECT p_partkey, {sql_rnd('coalesce(med, gm)', 4)} AS x__p_brand FROM d LEFT JOIN s ON d.fold = s.k AND d.b = s.b JOIN g ON d.fold = g.k"))
def q_encode_target_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold brand medians (each row encoded without its own fold)."""
    d = _enc_input(spark, sf_dir).withColumn("_fold", L.fold_column(["p_partkey"], 5))
    out = E.encode_target_oof(d, "p_brand", "p_retailprice", "_fold", 5)
    return out.select("p_partkey", rnd("x__p_brand", 4).alias("x__p_brand"))


@query("encode_impute", "E6", (
    f"WITH e AS ({_ENC_INPUT_SQL}), m AS (SELECT median(p_size) AS med FROM e), "
    "a AS (SELECT avg(coalesce(p_size, med)) AS mean FROM e, m) "
    f"SELECT p_partkey, coalesce(p_size, med) AS x_fit, {sql_rnd('coalesce(p_size, mean)', 6)} AS x_score FROM e, m, a"))
def q_encode_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing numeric -> median when fitting, mean (after imputation) when scoring."""
    d = _enc_input(spark, sf_dir)
    enc = E.fit_encoders(d, ["p_size"], "p_retailprice")
    fit = enc.transform(d, "fit").select("p_partkey", F.col("x__p_size").alias("x_fit"))
    score = enc.transform(d, "score").select("p_partkey", rnd("x__p_size", 6).alias("x_score"))
    return fit.join(score, "p_partkey")


@query("encode_assemble", "E9", (
    f"WITH e AS ({_ENC_INPUT_SQL}), ct AS (SELECT t, CAST(row_number() OVER (ORDER BY t) - 1 AS DOUBLE) AS it "
    "FROM (SELECT DISTINCT coalesce(p_type, 'Unknown') AS t FROM e)), m AS (SELECT median(p_size) AS med FROM e) "
    "SELECT p_partkey, 2 AS n_features, it AS f0, coalesce(p_size, med) AS f1 FROM e JOIN ct ON coalesce(p_type, 'Unknown') = ct.t, m"))
def q_encode_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VectorAssembler over the encoded columns; the vector is emitted as columns."""
    from pyspark.ml.functions import vector_to_array

    d = _enc_input(spark, sf_dir)
    enc = E.fit_encoders(d, ["p_type", "p_size"], "p_retailprice")
    v = enc.assemble(enc.transform(d, "fit")).select("p_partkey", vector_to_array("features").alias("a"))
    return v.select("p_partkey", F.size("a").alias("n_features"), F.col("a")[0].alias("f0"), F.col("a")[1].alias("f1"))


@query("encode_target_ppsf", "E5", (
    "WITH d AS (SELECT p_partkey, coalesce(p_brand, 'Unknown') AS b, p_retailprice AS y, "
    "CAST(CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE p_size END AS DOUBLE) AS area FROM part), "
    "s AS (SELECT b, median(y / NULLIF(area, 0)) AS pp FROM d GROUP BY b), g AS (SELECT median(y) AS gm FROM d) "
    f"SELECT p_partkey, {sql_rnd('coalesce(pp, gm / coalesce(NULLIF(area, 0), 1))', 6)} AS x__p_brand__ppsf "
    "FROM d LEFT JOIN s USING (b), g"))
def q_encode_target_ppsf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: second target encoding, per-brand median of price per area (size; 0 -> unknown)."""
    p = table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_retailprice",
        F.when(F.col("p_partkey") % 9 == 0, F.lit(0)).otherwise(F.col("p_size")).cast("double").alias("area"))
    enc = E.fit_encoders(p, ["p_brand"], "p_retailprice", area_col="area")
    return enc.transform(p, "fit").select("p_partkey", rnd("x__p_brand__ppsf", 6).alias("x__p_brand__ppsf"))


_MULTI_SQL = (
    "WITH s AS (SELECT covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_discount, l_discount) AS s22, "
    "covar_pop(l_quantity, l_discount) AS s12, covar_pop(l_quantity, l_extendedprice) AS s1y, "
    "covar_pop(l_discount, l_extendedprice) AS s2y, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, "
    "count(*) AS n FROM lineitem), b AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, "
    "(s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s) "
    f"SELECT {sql_rnd('my - b1 * m1 - b2 * m2', 4)} AS intercept, {sql_rnd('b1', 4)} AS coef_quantity, "
    f"{sql_rnd('b2', 2)} AS coef_discount, n AS n_train FROM b"
)


@query("linear_fit_multi", "M1", _MULTI_SQL)
def q_linear_fit_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 with two regressors (quantity, discount) from the same moments core."""
    c = L.fit_linear(_li(spark, sf_dir), ["l_quantity", "l_discount"], "l_extendedprice").where(F.col("_fold") == L.FULL)
    return c.select(rnd("_intercept", 4).alias("intercept"), rnd(F.col("_coef")[0], 4).alias("coef_quantity"),
                    rnd(F.col("_coef")[1], 2).alias("coef_discount"), F.col("_n_train").cast("long").alias("n_train"))


@query("weighted_quantiles", "S9 E4 F10", (
    "WITH w AS (SELECT p_brand, l_extendedprice AS y, unnest(generate_series(1, CASE WHEN l_returnflag = 'R' THEN 3 ELSE 1 END)) AS copy FROM lineitem JOIN part ON l_partkey = p_partkey) "
    "SELECT p_brand, count(*)::BIGINT AS n, quantile_cont(y, 0.25) AS q25, median(y) AS med, " + sql_rnd("avg(y)", 4) + " AS mean FROM w GROUP BY p_brand"))
def q_weighted_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles and means per brand in which a sold row counts three times, by narrowing on cumulated weights."""
    from valuelens.operators.quantiles import group_quantiles

    d = lineitem_part(spark, sf_dir).select("p_brand", "l_extendedprice", F.when(F.col("l_returnflag") == "R", 3.0).otherwise(1.0).alias("w"))
    q = group_quantiles(d, ["p_brand"], "l_extendedprice", [0.25, 0.5], ["q25", "med"], extra={"mean": "avg"}, max_group_rows=0, weight="w")
    return q.select("p_brand", F.col("_n").alias("n"), "q25", "med", rnd("mean", 4).alias("mean"))
