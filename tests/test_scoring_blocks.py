"""Scoring of trees and of linear subsets: nothing of a model's size goes through the driver or a join of rows."""

import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from valuelens.operators import encode as E
from valuelens.operators import search as SR
from valuelens.operators import tree_model as TM


def test_no_nodes_are_broadcast_and_parts_add_up(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = r.integers(0, 4, (50, 2)).astype(float)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "k long, a double, b double").repartition(4)
    # two trees: a <= 1 ? 10 : (b <= 2 ? 20 : 30), and a leaf of 5; ids of a subtree as trees.grow gives them
    nodes = spark.createDataFrame([(0, 0, 0, 1, 1, 0.0), (0, 1, -1, 0, -1, 10.0), (0, 2, 1, 2, 3, 0.0), (0, 3, -1, 0, -1, 20.0), (0, 4, -1, 0, -1, 30.0), (1, 0, -1, 0, -1, 5.0)], "tree int, node long, feature int, bin int, left long, value double")
    model = TM.TreeModel(["a", "b"], [[0.5, 1.5, 2.5]] * 2, nodes, False, 2, [1.0, 0.0])
    monkeypatch.setattr(SparkContext, "broadcast", lambda *_: pytest.fail("a model is broadcast by the driver"))
    want = {i: 5.0 + (10 if a <= 1 else 20 if b <= 2 else 30) for i, (a, b) in enumerate(x)}
    for blocks, part, joined in ((4_000_000, 64 << 20, 200_000), (1, 100, 10)):
        for name, v in (("BLOCK_NODES", blocks), ("PART_BYTES", part), ("JOINED_ROWS", joined)):
            monkeypatch.setattr(TM, name, v)
        got = {q.k: (q._t1, q._t2, q._t3) for q in TM.tree_sums(df, model, False).collect()}
        assert {k: v[0] for k, v in got.items()} == want and all(v[0] == v[1] for v in got.values())
        assert all(v[2] == 25 + (v[0] - 5) ** 2 for v in got.values())


@pytest.mark.parametrize("log", [False, True])
def test_linear_subsets_are_scored_without_a_join_of_rows(spark, monkeypatch, log):
    r = np.random.default_rng(4)
    a, b = r.integers(1, 9, 60), r.integers(1, 9, 60)
    y = 3.0 * a + b + r.random(60)
    y[7] = 0.0
    f = np.arange(60) % 3
    fit = np.log1p(y) if log else y
    x = spark.createDataFrame([(float(p), float(q), float(t), float(u), int(k)) for p, q, t, u, k in zip(a, b, y, fit, f, strict=True)], "x__a double, x__b double, y double, _yfit double, _fold int").repartition(3)
    enc = E.Encoders("y", [E.FeatureSpec(c, "numeric", [f"x__{c}"]) for c in "ab"])
    sets = {0: ["a"], 1: ["b"], 2: ["a", "b"]}
    subsets = spark.createDataFrame([(k, v) for k, v in sets.items()], "subset_id long, features array<string>")
    both = np.stack([a, b], 1).astype(float)
    for block in (SR.BLOCK_NUMBERS, 20):
        monkeypatch.setattr(SR, "BLOCK_NUMBERS", block)
        res = SR.evaluate_linear_subsets(x, enc, subsets, "y", log)
        assert "zip_with" not in res._jdf.queryExecution().toString()
        got = {q.subset_id: q for q in res.collect()}
        for s, names in sets.items():
            m = np.column_stack([np.ones(60), both[:, ["ab".index(n) for n in names]]])
            pred = np.empty(60)
            for k in range(3):
                pred[f == k] = m[f == k] @ np.linalg.lstsq(m[f != k], fit[f != k], rcond=None)[0]
            e = y - (np.expm1(pred) if log else pred)
            want = (60, 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(), np.abs(e).mean(), np.abs(e / np.where(y == 0, 1, y)).mean() * 100)
            assert np.allclose((got[s].n, got[s].r2, got[s].mae, got[s].mape), want, rtol=1e-8)
            assert set(got[s].importance) == set(names)
