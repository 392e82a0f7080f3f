"""Encoders, linear moments core, trees, privacy, search properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuelens.operators import encode as E
from valuelens.operators import linear as L
from valuelens.operators import privacy as PV
from valuelens.operators import search as SR


def test_encoder_choice_boundaries(spark):
    # 2 comma cells -> not multi; 3 -> multi; 15 distinct -> label; 16 -> target
    rows = []
    for i in range(40):
        rows.append((f"a{i % 15}", f"b{i % 16}", "x, y" if i < 2 else "x", "p, q" if i < 3 else "p", float(i)))
    df = spark.createDataFrame(rows, "c15 string, c16 string, two string, three string, y double")
    plan = {r.feature: r.kind for r in E.encoder_plan(df, ["c15", "c16", "two", "three", "y"]).collect()}
    assert plan == {"c15": "label", "c16": "target", "two": "label", "three": "multi_ohe", "y": "numeric"}


def test_label_unseen_is_zero_at_scoring(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, 3.0)], "c string, y double")
    enc = E.fit_encoders(train, ["c"], "y")
    assert enc.specs[0].classes == ["Unknown", "a", "b"]
    test = spark.createDataFrame([("b",), ("zzz",), (None,)], "c string")
    assert [r.x__c for r in enc.transform(test, "score").collect()] == [2.0, 0.0, 0.0]


def test_linear_moments_match_numpy_and_folds_partition(spark):
    rng = np.random.RandomState(3)
    X = rng.normal(size=(500, 3))
    y = 2 + X @ np.array([1.5, -2.0, 0.5]) + rng.normal(scale=0.1, size=500)
    rows = [(i, float(a), float(b), float(c), float(t)) for i, (a, b, c), t in zip(range(500), X, y)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, y double").withColumn("_f", L.fold_column(["k"], 5))
    coefs = L.fit_linear(df, ["a", "b", "c"], "y", fold="_f").collect()
    full = next(r for r in coefs if r._fold == L.FULL)
    A = np.column_stack([np.ones(500), X])
    ref = np.linalg.lstsq(A, y, rcond=None)[0]
    assert np.allclose([full._intercept, *full._coef], ref, atol=1e-9)
    folds = {r._fold: r for r in coefs if r._fold != L.FULL}
    assert sum(500 - r._n_train for r in folds.values()) == 500  # every row held out exactly once
    f0 = df.where("_f != 0").toPandas()
    ref0 = np.linalg.lstsq(np.column_stack([np.ones(len(f0)), f0[["a", "b", "c"]].values]), f0.y.values, rcond=None)[0]
    assert np.allclose([folds[0]._intercept, *folds[0]._coef], ref0, atol=1e-9)


def test_rank_deficient_design_is_min_norm(spark):
    rows = [(float(i), float(i), 3.0 * i + 1) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    r = L.fit_linear(df, ["a", "b"], "y").first()
    assert np.allclose(r._coef, [1.5, 1.5]) and abs(r._intercept - 1) < 1e-9


def test_forest_tree_mean_equals_prediction(spark, monkeypatch):
    from dataclasses import replace

    from valuelens.operators import models as MD
    from valuelens.operators import tree_model as TM

    rows = [(i, float(i % 7), float(i % 5), float((i % 7) * 3 + (i % 5))) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y double")
    m = MD.train_model(df, "y", ["a", "b"], ["k"], "random_forest", trees=5, max_depth=4, use_log=False, remove_outliers=False, cv_folds=2)
    own = m.trees["forest"]
    x = m.encoders.transform(df, "score")
    p = {r.k: r.prediction for r in m.predict(df).collect()}
    each = [{r.k: r._t1 for r in TM.tree_sums(x, replace(own, nodes=own.nodes.where(F.col("tree") == t)), False).collect()} for t in range(5)]
    assert max(abs(sum(e[k] for e in each) / 5 - p[k]) for k in p) < 1e-9
    spread = {r.k: r.pred_cv for r in MD.tree_spread(m, df).collect()}
    for k in p:
        v = np.array([e[k] for e in each])
        assert abs(spread[k] - v.std() / (abs(v.mean()) + 1)) < 1e-9
    # blocks of nodes add up
    monkeypatch.setattr(TM, "BLOCK_NODES", 20)
    assert all(abs(r.prediction - p[r.k]) < 1e-9 for r in m.predict(df).collect())
    s = MD.tree_spread(m, df).select(F.min("pred_cv"), F.max("pred_cv")).first()
    assert s[0] >= 0.0


def _priced(spark, n=240):
    r = np.random.default_rng(7)
    rows = [(i, float(a := r.integers(1, 40)), ["a", "b", "c"][i % 3], float(round(100 + 8 * a + 30 * (i % 3) + r.normal(), 2)), 1.0 + 2 * (i % 2)) for i in range(n)]
    return spark.createDataFrame(rows, "k long, a double, c string, y double, w double")


@pytest.mark.parametrize("kind", ["random_forest", "gradient_boosting", "stacking"])
def test_presets_run_and_predict(spark, kind):
    from valuelens.operators import models as MD
    from valuelens.session import scratch_dir
    from valuelens.sources import registry as RG

    df = _priced(spark)
    m = MD.train_model(df, "y", ["a", "c"], ["k"], kind, remove_outliers=False, trees=None if kind == "random_forest" else 40)
    assert m.metrics["r2"] > 0.9 and m.metrics["r2_cv"] > 0.9 and len(m.sample) == min(50, m.metrics["test_size"])
    assert m.metrics["train_size"] + m.metrics["test_size"] == 240 and m.importance[0][0] == "a"
    assert abs(sum(v for _, v in m.importance) - 1) < 1e-6
    # the stored model is the holdout's: its predictions of the test rows are the sample
    got = {round(r.y, 2): round(r.prediction, 2) for r in m.predict(df).collect()}
    assert all(abs(got[y] - p) < 0.011 for y, p in m.sample)
    root = scratch_dir(spark, "registry-test")
    mid = RG.save_model(spark, root, m, "first")
    RG.rename_model(spark, root, mid, "second")
    assert [(r.id, r.name) for r in RG.list_models(spark, root).collect()] == [(mid, "second")]
    again = RG.load_model(spark, root, mid)
    a, b = ({r.k: r.prediction for r in x.predict(df).collect()} for x in (m, again))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)
    spread = MD.tree_spread(m, df).agg(F.min("pred_cv"), F.max("pred_cv"), F.count("pred_cv")).first()
    assert spread[2] == (0 if kind == "gradient_boosting" else 240)


@pytest.mark.parametrize("n", [5, 12, 29])
def test_small_tables_use_folds_of_their_size(spark, n):
    from valuelens.operators import models as MD

    m = MD.train_model(_priced(spark, n), "y", ["a"], ["k"], "random_forest", remove_outliers=False, trees=5)
    assert m.metrics["train_size"] == m.metrics["test_size"] == n and m.metrics["r2"] == m.metrics["r2_cv"]


@pytest.mark.parametrize("kind", ["linear", "gradient_boosting"])
def test_weight_three_is_three_copies(spark, kind):
    from valuelens.operators import models as MD

    df = _priced(spark, 90)
    # copies share their key, so they share fold and draws
    copies = df.select("*", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))).alias("copy")).drop("copy")
    one = MD.train_model(df, "y", ["a"], ["k"], kind, remove_outliers=False, trees=10, weight="w")
    many = MD.train_model(copies, "y", ["a"], ["k"], kind, remove_outliers=False, trees=10)
    a, b = ({r.k: r.prediction for r in m.predict(df).collect()} for m in (one, many))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_weighted_encoders_are_those_of_copies(spark):
    rows = [(i, f"c{i % 20}", None if i % 7 == 0 else float(i % 13), float(100 + (i * 37) % 91), float(1 + i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, cat string, a double, y double, w double")
    copies = df.select("*", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))).alias("copy"))
    one, many = E.fit_encoders(df, ["cat", "a"], "y", weight="w"), E.fit_encoders(copies, ["cat", "a"], "y")
    assert [s.kind for s in one.specs] == ["target", "numeric"] == [s.kind for s in many.specs]
    assert np.allclose([one.specs[1].fill_fit, one.specs[1].fill_score], [many.specs[1].fill_fit, many.specs[1].fill_score])
    a, b = ({r._cat: (round(r._med, 9), round(r._mean, 9)) for r in e.specs[0].stats.collect()} for e in (one, many))
    assert a == b and one.specs[0].global_median == many.specs[0].global_median


def test_ablation_under_linear_and_trees(spark):
    df = _priced(spark).withColumn("noise", F.pmod(F.col("k") * 7919, F.lit(101)).cast("double")).withColumn("flat", F.lit(1.0))
    for kind in ("linear", "random_forest"):
        got = SR.feature_ablation(df, "y", ["a", "c", "noise", "flat", "y"], ["a", "noise"], ["k"], model_type=kind, trees=20).collect()
        by = {r.feature: r for r in got}
        assert set(by) == {"a", "c", "noise", "flat"} and by["a"].recommendation == "keep — critical" and by["a"].in_baseline
        assert by["c"].delta_r2 > 0 and not by["c"].in_baseline and by["flat"].corr is None and by["a"].corr > 0.9
        deltas = [r.delta_r2 for r in got]
        assert deltas == sorted(deltas, reverse=True)
    alone = SR.feature_ablation(df, "y", ["a", "c"], ["a"], ["k"]).collect()
    assert {r.feature: r.recommendation for r in alone}["a"] == "unknown"
    few = SR.feature_ablation(df.limit(4), "y", ["a", "c"], None, ["k"]).collect()
    assert {r.delta_r2 for r in few} == {None}


def test_linear_subsets_in_blocks_give_the_same(spark, monkeypatch):
    df = _priced(spark)
    subs = SR.feature_subsets(spark, ["a", "c"], min_features=1, max_features=2)
    whole = SR.subset_search(df, "y", ["a", "c"], subs, ["k"]).drop("r2_raw").orderBy("subset_idx").collect()
    monkeypatch.setattr(SR, "broadcast_limit_rows", lambda s: 1)
    assert SR.subset_search(df, "y", ["a", "c"], subs, ["k"]).drop("r2_raw").orderBy("subset_idx").collect() == whole
    trees = SR.subset_search(df, "y", ["a", "c"], subs, ["k"], model_type="rf_fast", trees=6).drop("r2_raw").orderBy("subset_idx").collect()
    monkeypatch.setattr(SR, "FITS_AT_ONCE", 5)
    assert SR.subset_search(df, "y", ["a", "c"], subs, ["k"], model_type="rf_fast", trees=6).drop("r2_raw").orderBy("subset_idx").collect() == trees
    assert abs(sum(trees[2].importance.values()) - 100) < 0.2


def test_alias_table_is_a_bijection(spark):
    df = spark.createDataFrame([("Main St", "Vancouver"), ("Oak St", "Burnaby"), ("Main St", None), ("", "Vancouver")], "street string, city string")
    a = PV.alias_table(df).collect()
    streets = {r.value: r.alias for r in a if r.kind == "address"}
    assert streets == {"Main St": "Address #1", "Oak St": "Address #2"}
    masked = PV.mask(df, True).collect()
    assert {r.city for r in masked} == {"City 1", "City 2", None}
    assert "" in {r.street for r in masked}


def test_subsets_order_and_slices(spark):
    from itertools import combinations

    feats = ["a", "b", "c", "d", "e"]
    got = [list(r.features) for r in SR.feature_subsets(spark, feats, min_features=1, max_features=3).orderBy("subset_idx").collect()]
    exp = [list(c) for k in range(1, 4) for c in combinations(feats, k)]
    assert got == exp
    sl = [list(r.features) for r in SR.feature_subsets(spark, feats, min_features=1, max_features=3, worker_id=1, n_workers=3).orderBy("subset_idx").collect()]
    assert sl == exp[1::3]
    assert SR.count_subsets(5, 1, 3) == len(exp)


def test_subsets_by_number(spark):
    import time
    from itertools import combinations

    feats = [f"f{i}" for i in range(7)]
    for need in ([], ["f5"], ["f0", "f3"]):
        want = [list(c) for k in range(1, 6) for c in combinations(feats, k) if set(need) <= set(c)]
        for workers in (1, 4):
            got = {}
            for w in range(workers):
                for r in SR.feature_subsets(spark, feats, required=need, min_features=1, max_features=5, worker_id=w, n_workers=workers).collect():
                    assert r.subset_idx % workers == w and r.n_features == len(r.features)
                    assert r["mask"] == sum(1 << (6 - feats.index(f)) for f in r.features)
                    got[r.subset_idx] = list(r.features)
            assert [got[i] for i in range(len(got))] == want
    assert SR.feature_subsets(spark, [], min_features=1).count() == 0
    # a slice of millions, and numbers far beyond what could be listed
    wide = [f"f{i}" for i in range(60)]
    t = time.time()
    rows = SR.feature_subsets(spark, wide, min_features=5, max_features=5, worker_id=7, n_workers=1000).collect()
    assert len(rows) == 5462 and time.time() - t < 60
    assert list(rows[0].features) == list(next(c for i, c in enumerate(combinations(wide, 5)) if i == 7))
    assert list(rows[-1].features) == next(list(c) for i, c in enumerate(combinations(wide, 5)) if i == rows[-1].subset_idx)
    far = SR.feature_subsets(spark, wide, min_features=30, max_features=30, worker_id=5, n_workers=2**50).orderBy("subset_idx").collect()
    assert len(far) == -(-(SR.count_subsets(60, 30, 30) - 5) // 2**50) and len(set(map(tuple, (r.features for r in far)))) == len(far)


def test_merge_rankings_idempotent(spark):
    r = spark.createDataFrame([(["a", "b"], "Linear", 80.0, 10.0), (["b", "a"], "Linear", 79.0, 11.0), (["c"], "Linear", 70.0, 12.0)],
                              "features array<string>, model string, r2 double, mae double")
    once = SR.merge_rankings([r]).drop("rank")
    twice = SR.merge_rankings([once, once]).drop("rank")
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    assert once.count() == 2


def test_subset_search_cache_reuse_and_stacking(spark):
    from valuelens.session import scratch_dir

    rows = [(i, float(i % 7), float(i % 5), ["a", "b", "c"][i % 3], float(100 + (i % 7) * 3 + (i % 5) + (i % 3))) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, x1 double, x2 double, c string, y double")
    subs = SR.feature_subsets(spark, ["x1", "x2", "c"], min_features=1, max_features=2)
    path = scratch_dir(spark, "cache-test")
    first = SR.subset_search(df, "y", ["x1", "x2", "c"], subs, ["k"], model_type="linear", cache_path=path, source="t")
    a = {tuple(r.features): r.r2 for r in first.collect()}
    second = SR.subset_search(df, "y", ["x1", "x2", "c"], subs, ["k"], model_type="linear", cache_path=path, source="t")
    b = {tuple(r.features): r.r2 for r in second.collect()}
    assert a == b and len(a) == 6
    best = max(a, key=a.get)
    assert set(best) == {"x1", "x2"}
    imp = {tuple(r.features): r.importance for r in first.collect()}
    assert abs(sum(imp[("x1", "x2")].values()) - 100.0) < 0.2
    st = SR.subset_search(df, "y", ["x1", "x2", "c"], subs.where("n_features = 1"), ["k"], model_type="stacking", trees=3, max_depth=3, k=3)
    assert st.count() == 3


def test_segment_label_classes_are_per_segment(spark):
    from valuelens.operators import segments as SG

    rows = []
    for i in range(60):
        seg = "A" if i % 2 else "B"
        cat = ["x", "y", "z"][i % 3] if seg == "A" else ["p", "y"][(i // 2) % 2]
        rows.append((i, seg, cat, float(i % 7), 100.0 + i))
    df = spark.createDataFrame(rows, "k long, s string, c string, a double, y double")
    rep, model, d = SG.segment_models(df, "s", "y", ["c", "a"], ["k"])
    got = {(r._seg, r.c): r.x__c for r in d.select("_seg", "c", "x__c").distinct().collect()}
    assert got[("A", "x")] == 0.0 and got[("A", "y")] == 1.0 and got[("A", "z")] == 2.0
    assert got[("B", "p")] == 0.0 and got[("B", "y")] == 1.0
    assert rep.count() == 2 and all(len(r.actual_vs_predicted) <= 40 for r in rep.collect())


def test_search_reads_its_input_once(spark):
    """Every pass of a subset search, and all its slices, share one reading of the input (before: each pass made it again)."""
    from valuelens.operators import search as SR

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(i, float(i % 7), "ab"[i % 2], 100.0 + 3 * (i % 7) + i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, t string, y double").mapInArrow(seen, "id long, a double, t string, y double")
    prepared = SR.prepare(df, "y", ["a", "t"], ["id"])
    parts = []
    for w in (0, 1):
        subs = SR.feature_subsets(spark, ["a", "t"], min_features=1, max_features=2, worker_id=w, n_workers=2)
        parts.append(SR.subset_search(df, "y", ["a", "t"], subs, ["id"], model_type="linear", prepared=prepared).drop("r2_raw"))
    got = SR.merge_rankings(parts).collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and read.value == 60
    subs = SR.feature_subsets(spark, ["a", "t"], min_features=1, max_features=2)
    alone = SR.subset_search(df, "y", ["a", "t"], subs, ["id"], model_type="linear").collect()
    assert read.value == 120
    assert {(*r["features"], r["r2"], r["mae"]) for r in alone} == {(*r["features"], r["r2"], r["mae"]) for r in got}
