"""Feature encoders E1-E9: fit -> small stats tables -> transform (all JVM-side).

Encoder choice per feature (E1): numeric stays numeric (median-imputed);
a text column with at least 3 cells containing ',' is one-hot encoded over
its sorted token vocabulary (E3); more than 15 distinct values -> target
encoding by the per-category median (E4, optional price-per-area E5); else
label encoding by the sorted class list (E2).  Nulls become 'Unknown' (E8).

What reaches the driver is bounded: label classes (<= 15 by the rule), the
one-hot vocabulary (checked against ``max_vocab``) and one fill value per
numeric feature.  Target statistics stay a DataFrame and are joined back,
broadcast only when their row count is under the checked limit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuelens.functions.exprs import tokens, try_num
from valuelens.operators.clean import is_numeric
from valuelens.operators.quantiles import DEFAULT_MAX_GROUP_ROWS, group_quantiles, quantile_row
from valuelens.session import broadcast_limit_rows

UNKNOWN = "Unknown"
# Fixed values from the reference: encoder thresholds and dropped tokens.
MULTI_MIN_CELLS = 3
MAX_LABEL_CLASSES = 15
DROP_TOKENS = ["nan", "unknown", ""]
OOF_REPLICATE_MAX_ROWS = 5_000_000


@dataclass
class FeatureSpec:
    name: str
    kind: str  # numeric | label | multi_ohe | target
    out: list[str]
    classes: list[str] | None = None
    vocab: list[str] | None = None
    fill_fit: float | None = None  # median (used when fitting)
    fill_score: float | None = None  # mean after imputation (used when scoring)
    vmin: float | None = None
    vmax: float | None = None
    stats: DataFrame | None = None  # target: (_cat, _med, _mean[, _ppsf])
    stats_rows: int = 0
    global_median: float | None = None
    has_ppsf: bool = False
    area_col: str | None = None  # E5: area column of the price-per-area encoding


@dataclass
class Encoders:
    target: str
    specs: list[FeatureSpec] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [c for s in self.specs for c in s.out]

    @property
    def features(self) -> list[str]:
        return [s.name for s in self.specs]

    def base_of(self) -> dict[str, str]:
        """encoded column -> base feature (importances are summed per base, §Q5)."""
        return {c: s.name for s in self.specs for c in s.out}

    def transform(self, df: DataFrame, mode: str = "fit", score_area: float = 1000.0) -> DataFrame:
        """Append the encoded columns.  ``mode='fit'`` reproduces training-time
        encoding (nulls -> 'Unknown', median fill); ``mode='score'`` the scoring
        rules (unseen/null label -> 0, mean fill, target fallback global median)."""
        out = df
        for s in self.specs:
            src = F.col(s.name) if s.name in df.columns else F.lit(None)
            if s.kind == "numeric":
                fill = s.fill_fit if mode == "fit" else s.fill_score
                v = (src.cast("double") if s.name in df.columns and is_numeric(df, s.name) else try_num(src))
                out = out.withColumn(s.out[0], F.coalesce(v, F.lit(float(fill if fill is not None else 0.0))))
            elif s.kind == "label":
                cell = F.coalesce(src.cast("string"), F.lit(UNKNOWN)) if mode == "fit" else src.cast("string")
                m = F.create_map(*[x for i, c in enumerate(s.classes or []) for x in (F.lit(c), F.lit(float(i)))])
                out = out.withColumn(s.out[0], F.coalesce(F.element_at(m, cell), F.lit(0.0)) if s.classes else F.lit(0.0))
            elif s.kind == "multi_ohe":
                cell = F.coalesce(src.cast("string"), F.lit(UNKNOWN) if mode == "fit" else F.lit(""))
                toks = tokens(cell, ",")
                out = out.select("*", *[F.array_contains(toks, F.lit(t)).cast("double").alias(c) for t, c in zip(s.vocab or [], s.out)])
            elif s.kind == "target":
                cell = F.coalesce(src.cast("string"), F.lit(UNKNOWN)) if mode == "fit" else src.cast("string")
                st = s.stats
                if s.stats_rows <= broadcast_limit_rows(df.sparkSession):
                    st = F.broadcast(st)
                out = out.withColumn("_cat", cell).join(st, on="_cat", how="left")
                g = F.lit(float(s.global_median))
                out = out.withColumn(s.out[0], F.coalesce(F.col("_med"), g))
                if s.has_ppsf:
                    if mode == "fit" and s.area_col in df.columns:
                        # training fallback: global median over the row's area (0 or missing -> 1)
                        fb = g / F.coalesce(F.nullif(F.col(s.area_col).cast("double"), F.lit(0.0)), F.lit(1.0))
                    else:
                        fb = g / F.lit(float(score_area))
                    out = out.withColumn(s.out[1], F.coalesce(F.col("_ppsf"), fb))
                out = out.drop("_cat", "_med", "_mean", "_ppsf")
        return out

    def assemble(self, df: DataFrame, output: str = "features") -> DataFrame:
        """One vector column from the encoded columns."""
        return VectorAssembler(inputCols=self.columns, outputCol=output, handleInvalid="error").transform(df)


def encoder_plan(df: DataFrame, features: Sequence[str], multi_min_cells: int = MULTI_MIN_CELLS, max_label: int = MAX_LABEL_CLASSES) -> DataFrame:
    """E1 as a table: (feature, kind, n_distinct, n_comma_cells) from one profile pass."""
    kinds = _plan(df, features, multi_min_cells, max_label)
    rows = [(f, k, nd, nc) for f, (k, nd, nc) in kinds.items()]
    return df.sparkSession.createDataFrame(rows, "feature string, kind string, n_distinct long, n_comma_cells long")


def _plan(df: DataFrame, features: Sequence[str], multi_min_cells: int, max_label: int,
          classes: dict[str, list[str]] | None = None) -> dict[str, tuple[str, int | None, int | None]]:
    """Encoder kind per feature from one comma-count pass and one distinct pass.

    When ``classes`` is given it is filled with the sorted classes of every
    label-encoded feature, read from the same distinct pass (at most
    ``max_label`` values per feature reach the driver).
    """
    text = [f for f in features if not is_numeric(df, f)]
    out: dict[str, tuple[str, int | None, int | None]] = {f: ("numeric", None, None) for f in features if f not in text}
    if text:
        filled = df.select(*[F.coalesce(F.col(f).cast("string"), F.lit(UNKNOWN)).alias(f) for f in text])
        commas = filled.agg(*[F.count(F.when(F.col(f).contains(","), 1)).alias(f) for f in text]).first()
        distinct = filled.unpivot([], text, "feature", "value").distinct().persist()
        nd = {r["feature"]: r["n"] for r in distinct.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
        for f in text:
            n_distinct, n_comma = int(nd.get(f, 0)), int(commas[f])
            kind = "multi_ohe" if n_comma >= multi_min_cells else ("target" if n_distinct > max_label else "label")
            out[f] = (kind, n_distinct, n_comma)
        labels = [f for f in text if out[f][0] == "label"]
        if classes is not None and labels:
            for r in distinct.where(F.col("feature").isin(labels)).collect():  # <= max_label rows per feature
                classes.setdefault(r["feature"], []).append(r["value"])
            for f in labels:
                classes[f] = sorted(classes.get(f, []))
        distinct.unpersist()
    return {f: out[f] for f in features}


def fit_encoders(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    *,
    area_col: str = "sqft",
    max_vocab: int = 1000,
    multi_min_cells: int = MULTI_MIN_CELLS,
    max_label: int = MAX_LABEL_CLASSES,
    max_group_rows: int = DEFAULT_MAX_GROUP_ROWS,
    weight: str | None = None,
    keep: bool = True,
) -> Encoders:
    """Fit E1-E8 on ``df`` (target already numeric and non-null).  ``keep`` is that of ``group_quantiles``.

    With ``weight`` (S9) medians and means count a row as so many rows; encoder choice, classes and tokens do not.
    """
    w = [weight] if weight else []
    classes: dict[str, list[str]] = {}
    plan = _plan(df, features, multi_min_cells, max_label, classes)
    enc = Encoders(target)
    numeric = [f for f, (k, _, _) in plan.items() if k == "numeric"]
    fills: dict[str, tuple[float, float, float, float]] = {}
    if numeric:
        # one grouped pass: median (exact), non-null count, sum, min, max per numeric feature;
        # the post-imputation mean/min/max follow from them and the row count
        wide = df.select(*[F.col(c).cast("double").alias(c) for c in numeric], *[F.col(weight).cast("double").alias("_weight") for _ in w])
        long = wide.unpivot(["_weight"] if w else [], numeric, "_f", "_x")
        q = group_quantiles(long, ["_f"], "_x", [0.5], ["_m"], extra={"_sum": "sum", "_min": "min", "_max": "max"},
                            max_group_rows=max_group_rows, weight="_weight" if w else None, keep=keep)
        st = {r["_f"]: r for r in q.collect()}  # one row per numeric feature
        n_all = (df.agg(F.sum(F.greatest(F.col(weight).cast("double"), F.lit(0.0)))).first()[0] or 0) if w else df.count()
        for c in numeric:
            r = st.get(c)
            if r is None or n_all == 0:
                fills[c] = (0.0, 0.0, 0.0, 0.0)
                continue
            m, n_nn = float(r["_m"]), r["_n"]
            miss = max(n_all - n_nn, 0)
            mean = (float(r["_sum"]) + miss * m) / n_all
            lo = min(float(r["_min"]), m) if miss else float(r["_min"])
            hi = max(float(r["_max"]), m) if miss else float(r["_max"])
            fills[c] = (m, mean, lo, hi)
    gmed = None
    for f in features:
        kind = plan[f][0]
        if kind == "numeric":
            m, mean, lo, hi = fills[f]
            enc.specs.append(FeatureSpec(f, "numeric", [f"x__{f}"], fill_fit=m, fill_score=mean, vmin=lo, vmax=hi))
        elif kind == "label":
            cls = classes.get(f, [])
            enc.specs.append(FeatureSpec(f, "label", [f"x__{f}"], classes=cls))
        elif kind == "multi_ohe":
            toks = df.select(F.explode(tokens(F.coalesce(F.col(f).cast("string"), F.lit(UNKNOWN)), ",")).alias("t"))
            toks = toks.where(~F.lower("t").isin(DROP_TOKENS)).distinct()
            n = toks.count()
            if n > max_vocab:
                raise ValueError(f"{f}: one-hot vocabulary of {n} tokens exceeds max_vocab={max_vocab}")
            vocab = sorted(r[0] for r in toks.collect())
            enc.specs.append(FeatureSpec(f, "multi_ohe", [f"x__{f}__{i}" for i in range(len(vocab))], vocab=vocab))
        else:
            if gmed is None:
                gmed = quantile_row(df, target, [0.5], ["_m"], max_group_rows=max_group_rows, weight=weight, keep=keep).first()["_m"]
            cat = df.select(F.coalesce(F.col(f).cast("string"), F.lit(UNKNOWN)).alias("_cat"), F.col(target).cast("double").alias("_y"),
                            *[F.col(x).cast("double").alias("_weight") for x in w],
                            *([F.try_divide(F.col(target).cast("double"), F.nullif(F.col(area_col).cast("double"), F.lit(0.0))).alias("_pp")]
                              if area_col in df.columns and is_numeric(df, area_col) else []))
            st = group_quantiles(cat, ["_cat"], "_y", [0.5], ["_med"], extra={"_mean": "avg"}, max_group_rows=max_group_rows, weight="_weight" if w else None, keep=keep).drop("_n")
            has_ppsf = "_pp" in cat.columns
            if has_ppsf:
                pp = group_quantiles(cat, ["_cat"], "_pp", [0.5], ["_ppsf"], max_group_rows=max_group_rows, weight="_weight" if w else None, keep=keep).drop("_n")
                st = st.join(pp, "_cat", "left")
            st = st.persist()
            enc.specs.append(FeatureSpec(f, "target", [f"x__{f}"] + ([f"x__{f}__ppsf"] if has_ppsf else []), stats=st,
                                         stats_rows=st.count(), global_median=float(gmed), has_ppsf=has_ppsf,
                                         area_col=area_col if has_ppsf else None))
    return enc


def encode_target_oof(df: DataFrame, feature: str, target: str, fold_col: str, k: int, max_group_rows: int = DEFAULT_MAX_GROUP_ROWS) -> DataFrame:
    """Leak-free target encoding: each row gets the category median of the
    OTHER folds (global median of the other folds as fallback).

    Exact either way: a small input (n x (k-1) <= OOF_REPLICATE_MAX_ROWS, one count)
    is replicated into its k-1 training folds; a large one is never replicated -
    the medians come from leave-fold-out histograms (all-folds counts minus the
    held fold's counts) narrowed to the order statistics.  Joined back on
    (held fold, category).
    """
    from valuelens.operators.quantiles import leave_fold_out_quantiles

    cat = F.coalesce(F.col(feature).cast("string"), F.lit(UNKNOWN))
    base = df.select(cat.alias("_cat"), F.col(target).cast("double").alias("_y"), F.col(fold_col).alias("_f")).persist()
    if base.count() * (k - 1) <= OOF_REPLICATE_MAX_ROWS:
        # small input: replicating each row into its k-1 training folds is the cheaper exact plan
        rep = base.select("*", F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("_held")).where(F.col("_held") != F.col("_f"))
        per = group_quantiles(rep, ["_held", "_cat"], "_y", [0.5], ["_oof_med"], max_group_rows=max_group_rows).drop("_n")
        glob = group_quantiles(rep, ["_held"], "_y", [0.5], ["_oof_glob"], max_group_rows=max_group_rows).drop("_n")
    else:
        per = leave_fold_out_quantiles(base, ["_cat"], "_f", k, "_y", [0.5], ["_oof_med"]).drop("_n")
        glob = leave_fold_out_quantiles(base, [], "_f", k, "_y", [0.5], ["_oof_glob"]).drop("_n")
    out = df.withColumn("_cat", cat).withColumn("_held", F.col(fold_col).cast("long"))
    out = out.join(per, ["_held", "_cat"], "left").join(F.broadcast(glob), "_held", "left")  # glob: k rows
    return out.withColumn(f"x__{feature}", F.coalesce("_oof_med", "_oof_glob")).drop("_cat", "_held", "_oof_med", "_oof_glob")


def fill_unknown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null category -> 'Unknown'."""
    return df.fillna(UNKNOWN, subset=list(columns))

