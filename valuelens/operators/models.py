"""Model training, evaluation and scoring.

Linear models come from the moments core (one aggregate pass, fold fits
solved per group in a bounded pandas call).  Forests, boosting and the bases of
stacking are histogram trees (``trees``): the fits of all folds, and in stacking of all inner
folds, grow together, and their out-of-fold predictions come out of the same job.
Folds and the 80/20 holdout come from integer key arithmetic, so they are
reproducible and independent of partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuelens.operators import encode as E
from valuelens.operators import filters as FL
from valuelens.operators import linear as L
from valuelens.operators import tree_model as TM
from valuelens.operators import trees as TR
from valuelens.operators.stats import regression_metrics

HOLDOUT_MIN_ROWS = 30  # fixed values from the reference
OUTLIER_MIN_ROWS = 20
SAMPLE_ROWS = 50
MIN_TRAIN_ROWS = 5

# Model presets of the reference (trees, min leaf, learning rate, depth, subsample).
PRESETS = {
    "random_forest": {"kind": "forest", "trees": 200, "min_leaf": 2},
    "rf_fast": {"kind": "forest", "trees": 30, "min_leaf": 3},
    "rf_full": {"kind": "forest", "trees": 200, "min_leaf": 2},
    "gradient_boosting": {"kind": "gbt", "trees": 200, "lr": 0.1, "depth": 3, "min_leaf": 1, "subsample": 1.0},
    "gb": {"kind": "gbt", "trees": 200, "lr": 0.1, "depth": 3, "min_leaf": 1, "subsample": 1.0},
    "gb_deep": {"kind": "gbt", "trees": 300, "lr": 0.05, "depth": 4, "min_leaf": 3, "subsample": 0.8},
    "linear": {"kind": "linear"},
}


def _stacking(trees: int, cv: int) -> dict:
    return {"kind": "stacking", "cv": cv, "base": {"forest": PRESETS["random_forest"] | {"trees": trees}, "gbt": PRESETS["gb"] | {"trees": trees}}}


PRESETS["stacking"] = _stacking(200, 5)
#: the feature search stacks smaller models
SEARCH_PRESETS = PRESETS | {"stacking": _stacking(100, 3)}
LABELS = {"forest": "Random Forest", "gbt": "Grad. Boosting", "linear": "Linear", "stacking": "Stacking"}


@dataclass
class TrainedModel:
    model_type: str
    target: str
    features: list[str]
    encoders: E.Encoders
    use_log: bool
    coefs: DataFrame | None = None  # linear: one row, _fold = -1
    trees: dict[str, TM.TreeModel] = field(default_factory=dict)  # by kind; stacking has two and the meta model in ``coefs``
    metrics: dict = field(default_factory=dict)
    importance: list[tuple[str, float]] = field(default_factory=list)
    train_source: str = ""
    leaked_removed: list[str] = field(default_factory=list)
    sample: list[tuple[float, float]] = field(default_factory=list)  # A9: (actual, predicted), first 50 test rows

    def predict(self, df: DataFrame, mode: str = "score", out: str = "prediction") -> DataFrame:
        """Encode with the fitted statistics and predict (expm1 for a log target)."""
        x = self.encoders.transform(df, mode)
        raw = _predict_raw(self, x, "_raw")
        pred = F.expm1("_raw") if self.use_log else F.col("_raw")
        return raw.withColumn(out, pred).drop("_raw")


def _predict_raw(m: TrainedModel, x: DataFrame, out: str) -> DataFrame:
    if not m.trees:
        return L.predict(x, m.coefs, m.encoders.columns, out=out)
    if len(m.trees) == 1:
        return TM.predict_trees(x, next(iter(m.trees.values())), out)
    for part, own in m.trees.items():
        x = TM.predict_trees(x, own, f"_b_{part}")
    names = [f"_b_{part}" for part in m.trees]
    return L.predict(x, m.coefs, names, out=out).drop(*names)


def _importance(m: TrainedModel) -> list[tuple[str, float]]:
    """Importances summed per base feature, sorted descending."""
    cols = m.encoders.columns
    base_of = m.encoders.base_of()
    kind = PRESETS[m.model_type]["kind"]
    if kind == "linear":
        coef = m.coefs.where(F.col("_fold") == L.FULL).first()["_coef"]
        raw = [v for _, v in L.importances(coef, cols)]
    else:
        raw = [sum(own) / len(own) for own in zip(*(t.importance for t in m.trees.values()), strict=True)]
    agg: dict[str, float] = {}
    for c, v in zip(cols, raw):
        agg[base_of[c]] = agg.get(base_of[c], 0.0) + float(v)
    return sorted(agg.items(), key=lambda kv: (-kv[1], kv[0]))


def train_model(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    keys: Sequence[str],
    model_type: str = "random_forest",
    *,
    train_source: str = "",
    eval_source: str = "",
    remove_outliers: bool = True,
    use_log: bool = True,
    trees: int | None = None,
    max_depth: int | None = None,
    cv_folds: int = 5,
    weight: str | None = None,
) -> TrainedModel:
    """M8: split, leakage guard, clean target, fence, encode, fit, holdout + CV, importances.

    ``weight`` (S9) names a column: a row of weight 3 counts as three in encoders and fits (not in the fence).  Below 30 rows there are
    min(folds, rows) folds.

    ``metrics`` holds r2/mae (holdout, or CV below 30 rows), r2_cv/mae_cv/mape_cv
    (k-fold over all rows), train/test sizes, outliers removed and, with an
    eval source of at least 5 rows, eval_r2/eval_mae/eval_n (M9).
    """
    preset = PRESETS[model_type]
    kind = preset["kind"]
    train_df, eval_df = FL.source_split(df, train_source, eval_source)
    feats, leaked = FL.leakage_guard([f for f in features if f not in ("_source", "_file_type", "_sample_weight")], target)
    base = FL.numeric_target(train_df.select(*dict.fromkeys([*keys, *feats, target, *([weight] if weight else [])])), target).persist()
    n0 = base.count()
    d = FL.outlier_fence(base, target, 3.0, min_rows=OUTLIER_MIN_ROWS, keep=False) if remove_outliers else base  # base is kept already, and so is d
    d = d.persist()
    info = d.agg(F.count(F.lit(1)).alias("n"), F.min(target).alias("y_min")).first()  # one pass: size and log decision
    n, y_min = info["n"], info["y_min"]
    if n < MIN_TRAIN_ROWS:
        raise ValueError(f"Not enough data (minimum {MIN_TRAIN_ROWS} rows), got {n}")
    enc = E.fit_encoders(d, feats, target, weight=weight, keep=False)
    x = enc.transform(d, "fit")
    log = bool(use_log and y_min is not None and y_min > 0)
    yfit = F.log1p(F.col(target)) if log else F.col(target).cast("double")
    k = cv_folds if n >= HOLDOUT_MIN_ROWS else min(cv_folds, n)
    wide = [*dict.fromkeys([*keys, target, *([weight] if weight else [])]), *enc.columns]
    x = x.withColumn("_yfit", yfit).withColumn("_fold", L.fold_column(list(keys), k)).select(*wide, "_yfit", "_fold").persist()
    m = TrainedModel(model_type, target, feats, enc, log, train_source=train_source, leaked_removed=leaked)

    if kind == "linear":
        # one moments pass: every leave-fold-out fit; the 80/20 holdout is fold 0 of the same folds,
        # so its model is the leave-fold-0-out fit and one scoring pass yields both metric sets
        coefs = L.fit_linear(x, enc.columns, "_yfit", fold="_fold", weight=weight)
        oof = L.predict(x, coefs, enc.columns, fold="_fold", out="_raw")
        oof = oof.withColumn("_pred", F.expm1("_raw") if log else F.col("_raw"))
        both = _two_metrics(oof, target, F.col("_fold") == 0).first()
        test_rows = oof.where(F.col("_fold") == 0) if n >= HOLDOUT_MIN_ROWS else oof
        sample = [(round(float(r[0]), 2), round(float(r[1]), 2))
                  for r in test_rows.orderBy(*keys).limit(SAMPLE_ROWS).select(target, "_pred").collect()]  # <= 50 rows
        cv = {"r2": both["r2_all"], "mae": both["mae_all"], "mape": both["mape_all"], "n": both["n_all"]}
        if n >= HOLDOUT_MIN_ROWS:
            hold = {"r2": both["r2_sub"], "mae": both["mae_sub"], "mape": both["mape_sub"], "n": both["n_sub"]}
            stored = coefs.where(F.col("_fold") == 0).withColumn("_fold", F.lit(L.FULL).cast("long"))
            train_n, test_n = n - hold["n"], hold["n"]
        else:
            hold, train_n, test_n = cv, n, n
            stored = coefs.where(F.col("_fold") == L.FULL)
        m.coefs = stored.persist()
        m.coefs.count()
    else:
        stored = 0 if n >= HOLDOUT_MIN_ROWS else -1  # the holdout's model is that of fold 0
        edges = TR.bin_edges(x, enc.columns)
        inner = F.pmod(F.xxhash64(F.lit("inner"), *enc.columns, "_yfit"), F.lit(preset["cv"])) if kind == "stacking" else None
        rows = TR.binned_rows(x, enc.columns, "_yfit", list(keys), F.col("_fold"), inner, edges, F.col(weight) if weight else None)
        folds = [*range(k), *([-1] if stored < 0 else [])]
        slots, fits = zip(*TM.plan_fits(0, preset, range(len(enc.columns)), folds, trees, max_depth, keep=stored), strict=True)
        grown = TR.grow_fits(rows, len(enc.columns), fits)
        oof, meta = TM.out_of_fold(grown, slots, kind == "stacking")
        back = F.expm1 if log else (lambda c: F.col(c))
        oof = oof.select("fold", "row", back("y").alias(target), back("raw").alias("_pred"))
        both = _two_metrics(oof, target, F.col("fold") == 0).first()
        cv, hold = ({"r2": both[f"r2_{t}"], "mae": both[f"mae_{t}"], "mape": both[f"mape_{t}"], "n": both[f"n_{t}"]} for t in ("all", "sub"))
        train_n, test_n = (n - hold["n"], hold["n"]) if stored == 0 else (n, n)
        shown = rows.where("fold = 0") if stored == 0 else rows
        first = shown.orderBy(*keys).limit(SAMPLE_ROWS).select("row", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])  # <= 50 rows
        pairs = oof.join(F.broadcast(first), "row").orderBy(*[f"_k{i}" for i in range(len(keys))]).collect()
        sample = [(round(float(r[target]), 2), round(float(r["_pred"]), 2)) for r in pairs]
        hold = hold if stored == 0 else cv
        parts = ("forest", "gbt") if kind == "stacking" else (kind,)
        m.trees = {part: TM.kept_model(grown, slots, fits, stored, part, enc.columns, edges) for part in parts}
        if meta is not None:
            m.coefs = meta.where(F.col("fold") == stored).select("_fold", "_intercept", "_coef", "_n_train").persist()
            m.coefs.count()
    for used in (x, d, base):
        used.unpersist()
    m.sample = sample
    m.metrics = {
        "r2": hold["r2"], "mae": hold["mae"], "r2_cv": cv["r2"], "mae_cv": cv["mae"], "mape_cv": cv["mape"],
        "train_size": int(train_n), "test_size": int(test_n), "outliers_removed": int(n0 - n), "use_log": log,
    }
    if eval_df is not None:
        ev = FL.numeric_target(eval_df, target)
        if ev.count() >= 5:
            pe = m.predict(ev, "score", "_pred")
            r = regression_metrics(pe, target, "_pred").first()
            m.metrics.update({"eval_r2": r["r2"], "eval_mae": r["mae"], "eval_n": r["n_rows"]})
    m.importance = _importance(m)
    return m


def _two_metrics(p: DataFrame, target: str, subset) -> DataFrame:
    """R², MAE, MAPE over all rows and over a subset of them, in one aggregate."""
    y = F.col(target).cast("double")
    e = y - F.col("_pred")
    ape = F.abs(e / F.when(y == 0, F.lit(1.0)).otherwise(y)) * 100
    out = []
    for tag, cond in (("all", F.lit(True)), ("sub", subset)):
        yy, ee, aa = F.when(cond, y), F.when(cond, e), F.when(cond, ape)
        out += [F.count(yy).alias(f"n_{tag}"), (1 - F.try_divide(F.sum(ee * ee), F.var_pop(yy) * F.count(yy))).alias(f"r2_{tag}"),
                F.avg(F.abs(ee)).alias(f"mae_{tag}"), F.avg(aa).alias(f"mape_{tag}")]
    return p.agg(*out)


def metrics_frame(m: TrainedModel, spark) -> DataFrame:
    """The metrics dict as a one-row DataFrame (doubles, sizes as longs)."""
    keys = sorted(m.metrics)
    row = {k: (float(v) if isinstance(v, float) else v) for k, v in m.metrics.items()}
    return spark.createDataFrame([tuple(row[k] for k in keys)], keys)


def importance_frame(m: TrainedModel, spark) -> DataFrame:
    return spark.createDataFrame([(f, float(v)) for f, v in m.importance], "feature string, importance double")


def holdout_linear(df: DataFrame, xcols: Sequence[str], y: str, keys: Sequence[str], use_log: bool = True, k: int = 5) -> DataFrame:
    """M5+M6 for a linear model on numeric features: fit on folds != 0 of k, score fold 0."""
    y_min = df.agg(F.min(F.col(y))).first()[0]
    log = bool(use_log and y_min is not None and y_min > 0)
    d = df.withColumn("_yfit", F.log1p(F.col(y)) if log else F.col(y).cast("double")).withColumn("_split", L.fold_column(list(keys), k))
    coefs = L.fit_linear(d.where(F.col("_split") != 0), list(xcols), "_yfit")
    p = L.predict(d.where(F.col("_split") == 0), coefs, list(xcols), out="_raw")
    p = p.withColumn("_pred", F.expm1("_raw") if log else F.col("_raw"))
    m = regression_metrics(p, y, "_pred")
    return m.select(F.col("n_rows").alias("n_test"), F.lit(log).alias("use_log"), "r2", "mae", "mape")


def score_with_spread(m: TrainedModel, df: DataFrame, out: str = "prediction", spread: str = "pred_cv") -> DataFrame:
    """M11 and V3 in one pass over the trees: the prediction, and per row the population std / (|mean| + 1) of
    the single trees' prices.

    Forest: over its trees (expm1 per tree for a log target); stacking: over the
    base models; linear: 0 (always 'stable'); boosting: NULL ('unstable').
    """
    kind = PRESETS[m.model_type]["kind"]
    if kind in ("linear", "gbt"):
        return m.predict(df, out=out).withColumn(spread, F.lit(0.0 if kind == "linear" else None).cast("double")).drop(*m.encoders.columns)
    price = F.expm1 if m.use_log else F.col
    x = m.encoders.transform(df, "score")
    if kind == "forest":
        own = m.trees["forest"]
        x, n = TM.tree_sums(x, own, m.use_log), float(own.trees)
        x = x.withColumn("_raw", F.col("_t1") / n)
        mean = F.col("_t2") / n
        var = F.col("_t3") / n - mean * mean
    else:
        for part, own in m.trees.items():
            x = TM.predict_trees(x, own, f"_b_{part}")
        x = L.predict(x, m.coefs, [f"_b_{part}" for part in m.trees], out="_raw")
        vals = [price(f"_b_{part}") for part in m.trees]
        mean = (vals[0] + vals[1]) / 2
        var = ((vals[0] - vals[1]) / 2) ** 2
    x = x.withColumn(out, price("_raw")).withColumn(spread, F.sqrt(F.greatest(var, F.lit(0.0))) / (F.abs(mean) + 1))
    return x.drop("_raw", "_t1", "_t2", "_t3", *[f"_b_{part}" for part in m.trees], *m.encoders.columns)


def tree_spread(m: TrainedModel, df: DataFrame, out: str = "pred_cv") -> DataFrame:
    """V3: ``df`` and the spread of ``score_with_spread``."""
    return score_with_spread(m, df, "_unused", out).drop("_unused")
