"""Queries for training, scoring, trees and segment models."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuelens.functions.exprs import rnd, sql_rnd
from valuelens.operators import models as MD
from valuelens.operators import segment_fit as SF
from valuelens.operators import segments as SG
from valuelens.operators.features import add_derived_features
from valuelens.plans.listing import KEYS, lineitem_part, listing_view
from valuelens.plans.q_models import LK, order_sql
from valuelens.plans.registry import query

TRAIN_FEATURES = ["floor_area_sqft", "district", "property_type", "interior_features", "rooms", "c_mktsegment", "price", "ppsf"]
TREE_FEATURES = ["floor_area_sqft", "rooms", "bedrooms", "district", "property_type"]
REF_YEAR = 2025


def listing_with_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_derived_features(listing_view(spark, sf_dir), REF_YEAR)


def _train(spark: SparkSession, sf_dir: str, model_type: str, features=None, **kw) -> MD.TrainedModel:
    lv = listing_with_features(spark, sf_dir)
    return MD.train_model(lv, "sold_price", features or TRAIN_FEATURES, KEYS, model_type, **kw)


@query("train_report", "M8 M5 M6 M7 F12")
def q_train_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 end to end (linear): leak guard, fence, encoders, log target, holdout + 5-fold CV on source R."""
    m = _train(spark, sf_dir, "linear", train_source="R")
    return MD.metrics_frame(m, spark).withColumn("leaked_removed", F.lit(",".join(m.leaked_removed)))


@query("eval_other_source", "M9")
def q_eval_other_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: train on source R, evaluate with the fitted encoders on source A."""
    m = _train(spark, sf_dir, "linear", train_source="R", eval_source="A")
    return MD.metrics_frame(m, spark).select("eval_r2", "eval_mae", "eval_n", "r2_cv")


@query("importance", "M10 M1")
def q_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear importances |coef|/sum summed per base feature (one-hot and ppsf parts)."""
    return MD.importance_frame(_train(spark, sf_dir, "linear", train_source="R"), spark)


@query("predict_batch", "M11")
def q_predict_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every source-A listing with the model trained on source R (scoring encoders)."""
    m = _train(spark, sf_dir, "linear", train_source="R")
    lv = listing_with_features(spark, sf_dir).where(F.col("_source") == "A")
    return m.predict(lv, "score").select(*KEYS, rnd("prediction", 2).alias("prediction"))


@query("forest_fit", "M2 M10")
def q_forest_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: random forest (200 trees, min leaf 2, all features per split) -> importances + CV metrics."""
    m = _train(spark, sf_dir, "random_forest", TREE_FEATURES, train_source="R")
    imp = MD.importance_frame(m, spark)
    return imp.crossJoin(MD.metrics_frame(m, spark).select("r2_cv", "mae_cv"))


@query("gbt_fit", "M3")
def q_gbt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: gradient boosting (200 rounds, lr 0.1, depth 3)."""
    m = _train(spark, sf_dir, "gradient_boosting", TREE_FEATURES, train_source="R")
    return MD.metrics_frame(m, spark)


@query("stacking_fit", "M4")
def q_stacking_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: forest + boosting with out-of-fold base predictions and a linear meta model."""
    m = _train(spark, sf_dir, "stacking", TREE_FEATURES, train_source="R")
    return MD.metrics_frame(m, spark)


@query("forest_spread", "V3 V4")
def q_forest_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: per-listing spread of the individual tree predictions, with the stability band."""
    from valuelens.operators.valuation import stability

    m = _train(spark, sf_dir, "random_forest", TREE_FEATURES, train_source="R")
    lv = listing_with_features(spark, sf_dir).where(F.col("_source") == "A")
    s = MD.tree_spread(m, lv.select(*KEYS, *TREE_FEATURES))
    return s.select(*KEYS, rnd("pred_cv", 6).alias("pred_cv"), stability(F.col("pred_cv")).alias("stability"))


# ------------------------------------------------------------------ M12 M13
def _seg_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_part(spark, sf_dir).select(*LK, "p_type", "l_quantity", "l_extendedprice")


@lru_cache(maxsize=None)
def _seg_sql_base() -> str:
    o = order_sql(LK)
    return (
        "WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_type AS seg, l_quantity AS x, l_extendedprice AS y "
        "FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IS NOT NULL AND l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL), "
        "q AS (SELECT seg, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3, count(*) AS n0 FROM d GROUP BY seg), "
        "f AS (SELECT d.* FROM d JOIN q USING (seg) WHERE n0 < 10 OR y BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1)), "
        "info AS (SELECT seg, count(*) AS n, min(y) > 0 AS lg, avg(y) AS mean FROM f GROUP BY seg HAVING count(*) >= 20), "
        f"e AS (SELECT f.*, n, lg, mean, CASE WHEN lg THEN ln(1 + y) ELSE y END AS yf, CASE WHEN ({o}) % 5 = 0 THEN 0 ELSE 1 END AS fold "
        "FROM f JOIN info USING (seg)), "
        "m AS (SELECT seg, regr_slope(yf, x) AS b, regr_intercept(yf, x) AS a FROM e WHERE fold = 1 GROUP BY seg), "
        "p AS (SELECT e.seg, y, CASE WHEN lg THEN exp(a + b * x) - 1 ELSE a + b * x END AS pred FROM e JOIN m USING (seg) WHERE fold = 0), "
        f"rep AS (SELECT seg AS segment, any_value(n) AS n_rows, 'holdout' AS method, "
        f"{sql_rnd('1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*))', 6)} AS r2, "
        f"{sql_rnd('avg(abs(y - pred))', 4)} AS mae, {sql_rnd('any_value(mean)', 2)} AS mean_price FROM p JOIN info USING (seg) GROUP BY seg)"
    )


@query("segment_models", "M12", _seg_sql_base() + " SELECT * FROM rep")
def q_segment_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One linear model (log target, quantity -> price) per part type, own fence and holdout."""
    rep, _, _ = SG.segment_models(_seg_input(spark, sf_dir), "p_type", "l_extendedprice", ["l_quantity"], LK)
    return rep.select("segment", "n_rows", "method", rnd("r2", 6).alias("r2"), rnd("mae", 4).alias("mae"),
                      rnd("mean_price", 2).alias("mean_price"))


@query("segment_predict", "M13", _seg_sql_base() + (
    " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_type AS segment, "
    f"{sql_rnd('CASE WHEN lg THEN exp(a + b * l_quantity) - 1 ELSE a + b * l_quantity END', 2)} AS prediction, "
    "rep.r2 AS model_r2, rep.mae AS model_mae FROM lineitem JOIN part ON l_partkey = p_partkey "
    "JOIN m ON m.seg = p_type JOIN info ON info.seg = p_type JOIN rep ON rep.segment = p_type"))
def q_segment_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem scored by its type's stored model, with that model's R²/MAE."""
    d = _seg_input(spark, sf_dir)
    rep, model, _ = SG.segment_models(d, "p_type", "l_extendedprice", ["l_quantity"], LK)
    rep = rep.select("segment", rnd("r2", 6).alias("r2"), rnd("mae", 4).alias("mae"))
    out = SG.segment_predict(d, "p_type", ["l_quantity"], model, rep)
    return out.select(*LK, "segment", rnd("prediction", 2).alias("prediction"), "model_r2", "model_mae")


SEG_FEATURES = ["floor_area_sqft", "rooms", "district", "interior_features"]


def _segment_forests(spark: SparkSession, sf_dir: str):
    lv = listing_with_features(spark, sf_dir).where(F.col("_source") == "R")
    return lv, SF.fit_segments(lv, "city", "sold_price", SEG_FEATURES, KEYS, "random_forest")


@query("segment_forest", "M12 M2")
def q_segment_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 with the default model type: a forest per city on numbers, labels and one-hot tokens."""
    _, m = _segment_forests(spark, sf_dir)
    return m.report().select("segment", "n_rows", "method", rnd("r2", 6).alias("r2"), rnd("mae", 2).alias("mae"), rnd("mean_price", 2).alias("mean_price"))


@query("segment_forest_predict", "M13 M2")
def q_segment_forest_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sold listing scored by its city's forest."""
    lv, m = _segment_forests(spark, sf_dir)
    return SF.predict_segments(lv.select(*KEYS, "city", *SEG_FEATURES), m).select(*KEYS, "segment", rnd("prediction", 2).alias("prediction"), rnd("model_r2", 6).alias("model_r2"), rnd("model_mae", 2).alias("model_mae"))
