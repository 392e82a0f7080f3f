"""Linear regression from distributed moments (M1, M5-M7 for linear models).

One pass computes, per (group..., fold), the row count, the means and the
population co-moments of (x_1..x_p, y) from packed cross products of
mean-shifted values (``gram``: summed per task, so a hot group is combined
across all tasks; no cancellation since the values are centred first).  Each group's k fold rows (bounded: k
rows of O(p^2) numbers) go to one ``applyInPandas`` call that merges the
folds with the parallel (Chan) formulas and solves the p x p normal
equations: the full fit and every leave-fold-out fit.  No pass over the data
is needed for the fits themselves; predictions are one more projection with
the coefficients joined on (group, fold).

Semantics match ordinary least squares with an intercept (minimum-norm
solution when the design is rank deficient, as lstsq gives).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuelens.operators.gram import centres, gram
from valuelens.session import broadcast_limit_rows, ship_package

FULL = -1  # fold id of the fit on all folds


def fold_column(keys: Sequence[str], k: int, seed: int = 42) -> Column:
    """Deterministic fold id in [0, k) from key columns of any type (no engine hash); NULL keys have a fold too."""
    from valuelens.operators.stats import deterministic_order

    return F.pmod(deterministic_order(keys, seed), F.lit(k))


def moments(df: DataFrame, xcols: Sequence[str], y: str, group: Sequence[str] = (), fold: str | None = None,
            shift: Sequence[float] | None = None, weight: str | None = None) -> DataFrame:
    """Per (group, fold): _n, _mean (array) and _C (q x q population co-moments, row by row) of (x..., y).

    With ``weight`` (S9) all three are weighted: _n is the sum of the weights, and rows
    without a positive weight do not count.

    One pass of packed cross products (``gram``) over values shifted by ``shift`` - by default
    the column means from one cheap pass - so the products never suffer
    from cancellation: cov = S_ij/n - (S_i/n)(S_j/n) with S on shifted values.
    """
    v = list(xcols) + [y]
    d = df.where(F.greatest(*[F.col(c).isNull().cast("int") for c in v], F.lit(0)) == 0)
    if shift is None:
        shift = centres(d, [F.col(c) for c in v])
    sh = [F.col(c).cast("double") - F.lit(float(shift[i])) for i, c in enumerate(v)]
    keys = list(group) + ([fold] if fold else [])
    n, q = F.col("_n").cast("double"), len(v)
    if weight is None:
        raw = gram(d, sh, keys)
    else:
        # products with sqrt(w) in front: w, w * x_i and w * x_i * x_j
        root = F.sqrt(F.col(weight).cast("double"))
        both = gram(d.where(F.col(weight) > 0), [root, *[root * s for s in sh]], keys)
        size = q + 1
        cross = F.transform(F.sequence(F.lit(0), F.lit(q * q - 1)), lambda k: F.element_at("_P", (F.floor(k / q).cast("int") + 1) * size + (k % q).cast("int") + 2))
        raw = both.select(*keys, F.element_at("_P", 1).alias("_n"), F.slice("_P", 2, q).alias("_S"), cross.alias("_P"))
    base = F.array(*[F.lit(float(s)) for s in shift])
    mean = F.transform("_S", lambda s: s / n)
    cov = F.transform("_P", lambda p, k: p / n - F.element_at("_S", F.floor(k / q).cast("int") + 1) / n * F.element_at("_S", (k % q).cast("int") + 1) / n)
    return raw.select(*keys, "_n", F.zip_with(mean, base, lambda a, b: a + b).alias("_mean"), cov.alias("_C"))


def _merge(rows: pd.DataFrame, q: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Chan merge of per-fold (n, mean, comoment) into one set."""
    n_tot, mean, C = 0.0, np.zeros(q), np.zeros((q, q))
    for r in rows.itertuples(index=False):  # at most k rows
        r = dict(zip(rows.columns, r))
        n = float(r["_n"])
        if n <= 0:
            continue
        m = np.array(r["_mean"], dtype=float)
        Cj = np.array(r["_C"], dtype=float).reshape(q, q) * n
        if n_tot == 0:
            n_tot, mean, C = n, m, Cj
            continue
        d = m - mean
        new_n = n_tot + n
        C = C + Cj + np.outer(d, d) * (n_tot * n / new_n)
        mean = mean + d * (n / new_n)
        n_tot = new_n
    return n_tot, mean, C


def _solve(n: float, mean: np.ndarray, C: np.ndarray, p: int) -> tuple[float, np.ndarray]:
    if n <= 0:
        return float("nan"), np.full(p, np.nan)
    Sxx, Sxy = C[:p, :p], C[:p, p]
    beta = np.linalg.pinv(Sxx, rcond=1e-12) @ Sxy if p else np.zeros(0)
    intercept = mean[p] - float(mean[:p] @ beta) if p else mean[p]
    return float(intercept), beta


def solve_folds(mom: DataFrame, p: int, group: Sequence[str] = (), fold: str | None = None) -> DataFrame:
    """(group..., _fold, _intercept, _coef array, _n_train): full fit (_fold = -1)
    plus, when folds exist, one fit per held-out fold on the other folds."""
    group = list(group)
    ship_package(mom.sparkSession)
    q = p + 1
    gcol = group if group else ["_g"]
    m = mom if group else mom.withColumn("_g", F.lit(0))
    if not fold:
        m = m.withColumn("_fold_in", F.lit(0))
        fcol = "_fold_in"
    else:
        fcol = fold
    schema_groups = ", ".join(f"`{g}` {dict(m.dtypes)[g]}" for g in gcol)
    schema = f"{schema_groups}, _fold long, _intercept double, _coef array<double>, _n_train long"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        gvals = {g: pdf[g].iloc[0] for g in gcol}
        folds = sorted(pdf[fcol].unique())
        n, mean, C = _merge(pdf, q)
        b0, b = _solve(n, mean, C, p)
        out.append({**gvals, "_fold": FULL, "_intercept": b0, "_coef": b.tolist(), "_n_train": int(n)})
        if fold:
            for k in folds:
                nk, mk, Ck = _merge(pdf[pdf[fcol] != k], q)
                b0k, bk = _solve(nk, mk, Ck, p)
                out.append({**gvals, "_fold": int(k), "_intercept": b0k, "_coef": bk.tolist(), "_n_train": int(nk)})
        return pd.DataFrame(out, columns=gcol + ["_fold", "_intercept", "_coef", "_n_train"])

    res = m.groupBy(*gcol).applyInPandas(fit, schema)
    res = res if group else res.drop("_g")
    return res.persist()  # small (groups x folds rows); reused by every scoring pass


def predict(df: DataFrame, coefs: DataFrame, xcols: Sequence[str], group: Sequence[str] = (), fold: str | None = None, out: str = "prediction") -> DataFrame:
    """Score rows with the fit of their (group, fold): intercept + coef . x (JVM-side).

    ``fold=None`` uses the full fit; otherwise each row is scored by the model
    that did not see its fold (out-of-fold prediction).
    """
    c = coefs.where(F.col("_fold") == FULL) if fold is None else coefs.where(F.col("_fold") != FULL)
    c = c.withColumnRenamed("_fold", "_fold_j")
    n = c.count()
    if n <= broadcast_limit_rows(df.sparkSession):
        c = F.broadcast(c)
    keys = list(group)
    cond = [df[g] == c[g] for g in keys]
    if fold is not None:
        cond.append(df[fold] == c["_fold_j"])
    j = df.join(c, on=cond, how="inner") if cond else df.crossJoin(c)
    for g in keys:
        j = j.drop(c[g])
    x = F.array(*[F.col(v).cast("double") for v in xcols]) if xcols else F.array().cast("array<double>")
    dot = F.aggregate(F.zip_with(F.col("_coef"), x, lambda a, b: a * b), F.lit(0.0), lambda acc, t: acc + t)
    return j.withColumn(out, F.col("_intercept") + dot).drop("_fold_j", "_intercept", "_coef", "_n_train")


def fit_linear(df: DataFrame, xcols: Sequence[str], y: str, group: Sequence[str] = (), fold: str | None = None, weight: str | None = None) -> DataFrame:
    """Coefficient table for (weighted) least squares with intercept (per group; per held-out fold)."""
    return solve_folds(moments(df, xcols, y, group, fold, weight=weight), len(xcols), group, fold)


def importances(coef: Sequence[float], names: Sequence[str]) -> list[tuple[str, float]]:
    """M1: |coef| / sum |coef| (uniform when all zero)."""
    a = np.abs(np.asarray(coef, dtype=float))
    s = a.sum() or 1.0
    return [(n, float(v / s)) for n, v in zip(names, a)]
