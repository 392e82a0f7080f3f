"""Training and search on one or two numeric features, where SQL's regression aggregates give the same figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuelens.functions.exprs import rnd, sql_rnd
from valuelens.operators import models as MD
from valuelens.operators import search as SR
from valuelens.plans.listing import KEYS, listing_view
from valuelens.plans.q_clean import with_listing
from valuelens.plans.q_models import order_sql
from valuelens.plans.registry import query

K = ", ".join(KEYS)
ONE = "floor_area_sqft"
SINGLES = ["floor_area_sqft", "rooms", "year_built", "bedrooms"]

# sold listings inside the 3 x IQR fence with their fold and the log of the target
_FENCED = [
    f"s AS (SELECT {K}, {', '.join(SINGLES)}, sold_price AS y, ({order_sql(KEYS)}) % 5 AS fold FROM listing WHERE _source = 'R' AND sold_price IS NOT NULL)",
    "q AS (SELECT quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM s)",
    "e AS (SELECT s.*, ln(1 + y) AS yf FROM s, q WHERE y BETWEEN q1 - 3 * (q3 - q1) AND q3 + 3 * (q3 - q1))",
]
# out-of-fold predictions of each single feature
_SINGLE = [
    *_FENCED,
    "u AS (" + " UNION ALL ".join(f"SELECT {i} AS subset_idx, '{f}' AS feature, {f} AS x, y, yf, fold FROM e" for i, f in enumerate(SINGLES)) + ")",
    "m AS (SELECT a.subset_idx, k.fold, regr_slope(a.yf, a.x) AS b, regr_intercept(a.yf, a.x) AS c FROM u a, (SELECT unnest([0, 1, 2, 3, 4]) AS fold) k "
    "WHERE a.fold <> k.fold GROUP BY ALL)",
    "p AS (SELECT u.subset_idx, feature, u.fold, y, exp(c + b * x) - 1 AS pred FROM u JOIN m USING (subset_idx, fold))",
    "r AS (SELECT subset_idx, feature, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2, avg(abs(y - pred)) AS mae, "
    "avg(abs((y - pred) / y)) * 100 AS mape FROM p GROUP BY subset_idx, feature)",
]
_R2 = "1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*))"


def _train(spark: SparkSession, sf_dir: str, features, **kw) -> tuple[DataFrame, MD.TrainedModel]:
    lv = listing_view(spark, sf_dir)
    return lv, MD.train_model(lv, "sold_price", features, KEYS, "linear", train_source="R", **kw)


@query("train_report_one", "M8 M5 M6 M7", with_listing(
    f"SELECT {sql_rnd('h.r2', 6)} AS r2, {sql_rnd('h.mae', 2)} AS mae, {sql_rnd('c.r2', 6)} AS r2_cv, {sql_rnd('c.mae', 2)} AS mae_cv, {sql_rnd('c.mape', 4)} AS mape_cv, "
    "(c.n - h.n)::BIGINT AS train_size, h.n::BIGINT AS test_size, ((SELECT count(*) FROM s) - c.n)::BIGINT AS outliers_removed, true AS use_log "
    f"FROM (SELECT {_R2} AS r2, avg(abs(y - pred)) AS mae, count(*) AS n FROM p WHERE subset_idx = 0 AND fold = 0) h, "
    f"(SELECT {_R2} AS r2, avg(abs(y - pred)) AS mae, avg(abs((y - pred) / y)) * 100 AS mape, count(*) AS n FROM p WHERE subset_idx = 0) c", *_SINGLE))
def q_train_report_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 on floor area alone: holdout and 5-fold figures, sizes, fence, log target."""
    _, m = _train(spark, sf_dir, [ONE])
    r = MD.metrics_frame(m, spark)
    return r.select(*[rnd(c, d).alias(c) for c, d in (("r2", 6), ("mae", 2), ("r2_cv", 6), ("mae_cv", 2), ("mape_cv", 4))], "train_size", "test_size", "outliers_removed", "use_log")


_STORED = [*_SINGLE, "st AS (SELECT b, c FROM m WHERE subset_idx = 0 AND fold = 0)",
           f"o AS (SELECT {K}, sold_price AS y, exp(c + b * {ONE}) - 1 AS pred FROM listing, st WHERE _source = 'A' AND sold_price IS NOT NULL)"]


@query("eval_other_one", "M9", with_listing(
    f"SELECT {sql_rnd(_R2, 6)} AS eval_r2, {sql_rnd('avg(abs(y - pred))', 2)} AS eval_mae, count(*)::BIGINT AS eval_n FROM o", *_STORED))
def q_eval_other_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9: the stored model of source R on source A."""
    _, m = _train(spark, sf_dir, [ONE], eval_source="A")
    return MD.metrics_frame(m, spark).select(rnd("eval_r2", 6).alias("eval_r2"), rnd("eval_mae", 2).alias("eval_mae"), "eval_n")


@query("predict_one", "M11", with_listing(f"SELECT {K}, {sql_rnd('pred', 2)} AS prediction FROM o", *_STORED))
def q_predict_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing of source A scored by the stored model."""
    lv, m = _train(spark, sf_dir, [ONE])
    return m.predict(lv.where("_source = 'A' AND sold_price IS NOT NULL"), "score").select(*KEYS, rnd("prediction", 2).alias("prediction"))


_TWO = [
    *_FENCED,
    "v AS (SELECT var_pop(floor_area_sqft) AS s11, var_pop(rooms) AS s22, covar_pop(floor_area_sqft, rooms) AS s12, covar_pop(floor_area_sqft, yf) AS s1, covar_pop(rooms, yf) AS s2 "
    "FROM e WHERE fold <> 0)",
    "b AS (SELECT abs((s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12)) AS b1, abs((s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12)) AS b2 FROM v)",
]


@query("importance_two", "M10 M1", with_listing(
    f"SELECT 'floor_area_sqft' AS feature, {sql_rnd('b1 / (b1 + b2)', 6)} AS importance FROM b UNION ALL SELECT 'rooms', {sql_rnd('b2 / (b1 + b2)', 6)} FROM b", *_TWO))
def q_importance_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the absolute coefficients of two features."""
    _, m = _train(spark, sf_dir, ["floor_area_sqft", "rooms"])
    return MD.importance_frame(m, spark).select("feature", rnd("importance", 6).alias("importance"))


def _sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing_view(spark, sf_dir).where("_source = 'R'").select(*KEYS, *[c for c in SINGLES if c not in KEYS], "sold_price")


def _singles(spark: SparkSession, lv: DataFrame, prepared=None, **slices) -> DataFrame:
    return SR.subset_search(lv, "sold_price", SINGLES, SR.feature_subsets(spark, SINGLES, min_features=1, max_features=1, **slices), KEYS, model_type="linear", prepared=prepared)


_ROUNDED = f"{sql_rnd('r2 * 100', 1)} AS r2, {sql_rnd('mae', 0)} AS mae, {sql_rnd('mape', 1)} AS mape"


@query("subset_search_one", "M17", with_listing(f"SELECT subset_idx::BIGINT AS subset_idx, feature AS features, 'Linear' AS model, {_ROUNDED} FROM r", *_SINGLE))
def q_subset_search_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each single feature under 5-fold linear cross-validation."""
    return _singles(spark, _sold(spark, sf_dir)).select("subset_idx", F.array_join("features", ",").alias("features"), "model", "r2", "mae", "mape")


@query("feature_frequency_one", "M19", with_listing("SELECT feature, 1::BIGINT AS n_results FROM r ORDER BY r2 DESC LIMIT 2", *_SINGLE))
def q_feature_frequency_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M19 over the two best single features (a report)."""
    return SR.feature_frequency(_singles(spark, _sold(spark, sf_dir)).orderBy(F.desc("r2_raw")).limit(2))


@query("merge_rankings_one", "O5 O4", with_listing(
    "SELECT row_number() OVER (ORDER BY r2 DESC, src, features) AS rank, features, model, r2, mae FROM "
    f"(SELECT feature AS features, 'Linear' AS model, {_ROUNDED}, subset_idx % 2 AS src FROM r)", *_SINGLE))
def q_merge_rankings_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two worker slices and a repeated one merged and ranked."""
    sold = _sold(spark, sf_dir)
    prepared = SR.prepare(sold, "sold_price", SINGLES, KEYS)  # the rows of all three slices
    parts = [_singles(spark, sold, prepared, worker_id=w, n_workers=2).drop("r2_raw") for w in (0, 1, 0)]
    return SR.merge_rankings(parts, top_n=100).select(F.col("rank").cast("long").alias("rank"), F.array_join("features", ",").alias("features"), "model", "r2", "mae")


_ABLATION = [
    *_FENCED,
    "l AS (SELECT e.*, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS t FROM e JOIN (SELECT " + K + ", c_mktsegment FROM listing) x USING (" + K + "))",
    "f AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold)",
    "v AS (SELECT f.fold, avg(floor_area_sqft) AS a1, avg(t) AS a2, avg(yf) AS ay, var_pop(floor_area_sqft) AS s11, var_pop(t) AS s22, covar_pop(floor_area_sqft, t) AS s12, "
    "covar_pop(floor_area_sqft, yf) AS s1, covar_pop(t, yf) AS s2 FROM l, f WHERE l.fold <> f.fold GROUP BY f.fold)",
    "w AS (SELECT *, s1 / s11 AS b, (s1 * s22 - s2 * s12) / (s11 * s22 - s12 * s12) AS b1, (s2 * s11 - s1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM v)",
    "p AS (SELECT y, exp(ay + b * (floor_area_sqft - a1)) - 1 AS one, exp(ay + b1 * (floor_area_sqft - a1) + b2 * (t - a2)) - 1 AS two FROM l JOIN w USING (fold))",
    "g AS (SELECT round(1 - sum((y - one) * (y - one)) / (var_pop(y) * count(*)), 4) AS r1, round(1 - sum((y - two) * (y - two)) / (var_pop(y) * count(*)), 4) AS r2, "
    "round(avg(abs(y - one)), 2) AS m1, round(avg(abs(y - two)), 2) AS m2, round(avg(abs((y - one) / y)) * 100, 2) AS a1, round(avg(abs((y - two) / y)) * 100, 2) AS a2 FROM p)",
]


@query("ablation_one", "M14", with_listing(
    f"SELECT 'c_mktsegment' AS feature, false AS in_baseline, CAST(NULL AS DOUBLE) AS corr, {sql_rnd('(r2 - r1) * 100', 2)} AS delta_r2, {sql_rnd('a1 - a2', 2)} AS delta_mape, "
    f"{sql_rnd('r2 * 100', 1)} AS r2_alt, {sql_rnd('r1 * 100', 1)} AS base_r2, CASE WHEN (r2 - r1) * 100 >= 5 THEN 'add — big gain' WHEN (r2 - r1) * 100 >= 1 THEN 'worth adding' "
    "WHEN (r2 - r1) * 100 >= -1 THEN 'minor effect' ELSE 'skip — hurts model' END AS recommendation FROM g "
    f"UNION ALL SELECT 'floor_area_sqft', true, (SELECT {sql_rnd('corr(floor_area_sqft, y)', 4)} FROM s), NULL, NULL, NULL, {sql_rnd('r1 * 100', 1)}, 'unknown' FROM g", *_ABLATION))
def q_ablation_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One number selected, one text feature tried; without its only feature the selected set has no score."""
    lv = listing_view(spark, sf_dir).where("_source = 'R'")
    r = SR.feature_ablation(lv, "sold_price", [ONE, "c_mktsegment"], [ONE], KEYS)
    return r.select("feature", "in_baseline", "corr", "delta_r2", "delta_mape", "r2_alt", "base_r2", "recommendation")
