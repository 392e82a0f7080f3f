"""Histogram trees against a recursive brute force on the same bins and weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuelens.operators import trees as TR


def brute_tree(bins, y, w, columns, min_leaf, max_depth, depth=0):
    """Nested (feature, bin, left, right) or a value, by trying every cut."""
    total, s = w.sum(), (w * y).sum()
    value = s / total if total else 0.0
    if total < max(2 * min_leaf, 1) or (max_depth is not None and depth >= max_depth):
        return value
    parent = s * s / total
    best = (parent + 1e-10 * abs(parent) + 1e-12, None)
    for j in columns:
        own = (-np.inf, None)
        for b in range(TR.MAX_BINS - 1):
            left = bins[j] <= b
            wl, sl = w[left].sum(), (w[left] * y[left]).sum()
            if wl >= min_leaf and total - wl >= min_leaf and wl > 0 and total - wl > 0:
                score = sl * sl / wl + (s - sl) ** 2 / (total - wl)
                if score > own[0]:
                    own = (score, (j, b))
        if own[0] > best[0]:
            best = own
    if best[1] is None:
        return value
    j, b = best[1]
    left = bins[j] <= b
    return (j, b, *(brute_tree(bins[:, m], y[m], w[m], columns, min_leaf, max_depth, depth + 1) for m in (left, ~left)))


def nested(nodes, i):
    if nodes.feature[i] < 0:
        return nodes.value[i]
    return (nodes.feature[i], nodes.bin[i], nested(nodes, nodes.left[i]), nested(nodes, nodes.left[i] + 1))


def walk(tree, bins, r):
    while isinstance(tree, tuple):
        tree = tree[2] if bins[tree[0], r] <= tree[1] else tree[3]
    return tree


def same(a, b):
    if isinstance(a, tuple):
        return isinstance(b, tuple) and a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(b, tuple) and abs(a - b) < 1e-9


@pytest.mark.parametrize(("n", "bins_used", "min_leaf", "depth"), [(300, 64, 2, None), (400, 7, 1, 4), (60, 3, 5, None)])
def test_grow_equals_brute_force(n, bins_used, min_leaf, depth):
    r = np.random.default_rng(n)
    bins = r.integers(0, bins_used, (3, n)).astype(np.uint8)
    y = r.integers(0, 50, n).astype(float)
    w = r.poisson(1.0, (4, n)).astype(float)
    on = [np.flatnonzero(x) for x in w]
    row, tree = np.concatenate(on), np.repeat(np.arange(4), [len(x) for x in on])
    nodes = TR.grow(bins, y, row, tree, w[tree, row], 4, (0, 2), min_leaf, depth)
    for t in range(4):
        want = brute_tree(bins[:, on[t]], y[on[t]], w[t][on[t]], (0, 2), min_leaf, depth)
        assert same(nested(nodes, t), want)
        at = TR.leaves(nodes, bins, np.arange(n), np.array([t]))[0]
        assert np.allclose(nodes.value[at], [walk(want, bins, k) for k in range(n)])
    gains = TR.importances(nodes, 4, 3)
    assert gains[1] == 0 and abs(gains.sum() - 4) < 1e-9


def test_sparse_and_dense_sums_agree():
    r = np.random.default_rng(9)
    n, k = 3000, 900  # more cells than the dense form takes
    local = np.concatenate([np.arange(k), r.integers(0, k, n - k)])
    b, w, y = r.integers(0, 64, n).astype(np.uint8), r.integers(1, 4, n).astype(float), r.integers(0, 9, n).astype(float)
    total, s = np.bincount(local, w, k), np.bincount(local, w * y, k)
    big = TR._best_split(local, b, w, w * y, total, s, 2)
    for i in range(k):
        m = local == i
        one = TR._best_split(np.zeros(m.sum(), np.int64), b[m], w[m], w[m] * y[m], total[[i]], s[[i]], 2)
        assert big[0][i] == one[0][0] or abs(big[0][i] - one[0][0]) < 1e-9
        if np.isfinite(big[0][i]):
            assert big[1][i] == one[1][0]


@pytest.mark.parametrize(("n", "width"), [(30_000, 64), (9_000, 64), (9_000, 2), (200_000, 3)])
def test_every_form_of_sums_finds_the_best_cut(n, width):
    r = np.random.default_rng(n + width)
    k = 2_500
    local = np.concatenate([np.arange(k), r.integers(0, k, n - k)])
    b, w, y = r.integers(0, width, n).astype(np.uint8), r.integers(1, 4, n).astype(float), r.integers(0, 9, n).astype(float)
    total, s = np.bincount(local, w, k), np.bincount(local, w * y, k)
    score, at = TR._best_split(local, b, w, w * y, total, s, 2, width)
    cells = [np.bincount(local * width + b, v, k * width).reshape(k, width).cumsum(1)[:, :-1] for v in (w, w * y)]
    rest = total[:, None] - cells[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        want = np.where((cells[0] >= 2) & (rest >= 2), cells[1] ** 2 / cells[0] + (s[:, None] - cells[1]) ** 2 / rest, -np.inf)
    some = np.isfinite(want.max(1))
    assert (np.isfinite(score) == some).all() and np.allclose(score[some], want.max(1)[some], rtol=1e-9)
    assert np.allclose(want[some, at[some]], score[some], rtol=1e-9)


def rows_frame(spark, n=400):
    r = np.random.default_rng(3)
    x = np.stack([r.integers(0, 40, n), r.normal(size=n).round(2), r.integers(0, 5, n), r.normal(size=n)], 1)
    y = np.round(10 * x[:, 0] + 25 * (x[:, 2] == 3) * x[:, 1] + r.normal(size=n))
    rows = [(k, *map(float, v), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double, y double")
    cols = ["a", "b", "c", "d"]
    edges = TR.bin_edges(df, cols)
    assert [len(e) for e in edges[::2]] == [39, 4] and all(len(e) < 64 for e in edges)
    return TR.binned_rows(df.repartition(3), cols, "y", ["k"], F.pmod("k", F.lit(3)), F.pmod(F.col("k") / 3, F.lit(2)), edges, F.pmod("k", F.lit(4))), rows, edges


FITS = [
    TR.Fit((0, 1, 2), trees=3, min_leaf=2, held=0, keep=True),
    TR.Fit((0, 3), trees=2, min_leaf=3, max_depth=4, held=1, inner=0),
    TR.Fit((0, 1, 2, 3), trees=4, max_depth=2, held=2, rate=0.3, keep=True),
]


def test_fits_equal_brute_force_in_a_task_and_by_levels(spark):
    rows, raw, edges = rows_frame(spark)
    local = TR.grow_fits(rows, 4, FITS)
    large = TR.grow_fits(rows, 4, FITS, local_rows=40)
    a, b = ({(r["fit"], r["row"]): (r["y"], round(r["prediction"], 7)) for r in g.predictions().collect()} for g in (local, large))
    assert a == b
    got = rows.select(*TR._OWN).collect()
    d = TR.Rows(*(np.array([r[c] for r in got]) for c in ("row", "h", "fold", "inner", "y", "weight")), np.frombuffer(b"".join(bytes(r["bins"]) for r in got), np.uint8).reshape(len(got), 4).T)
    for k, fit in enumerate(FITS[:2]):
        train, score = d.learned(fit), np.flatnonzero(d.scored(fit))
        total = np.zeros(len(score))
        for t in range(fit.trees):
            w = TR.tree_weights(fit, d.h, t) * train * d.weight
            on = w > 0
            tree = brute_tree(d.bins[:, on], d.y[on], w[on], fit.columns, fit.min_leaf, fit.max_depth)
            total += [walk(tree, d.bins, r) for r in score]
        assert {x for f, x in a if f == k} == set(d.row[score].tolist())
        assert np.allclose([a[k, int(x)][1] for x in d.row[score]], total / fit.trees, atol=1e-6)
    fit = FITS[2]
    train, score = d.learned(fit) & (d.weight > 0), np.flatnonzero(d.scored(fit))
    now = np.full(len(d.y), np.average(d.y[train], weights=d.weight[train]))
    for _ in range(fit.trees):
        tree = brute_tree(d.bins[:, train], (d.y - now)[train], d.weight[train], fit.columns, 1, fit.max_depth)
        now = now + fit.rate * np.array([walk(tree, d.bins, r) for r in range(len(now))])
    assert np.allclose([a[2, int(x)][1] for x in d.row[score]], now[score], atol=1e-6)
    for g in (local, large):
        imp = {(r["fit"], r["feature"]): r["importance"] for r in g.gains().collect()}
        assert all(abs(sum(v for (f, _), v in imp.items() if f == k) - 1) < 1e-9 for k in range(3)) and imp[1, 1] == 0
    one, two = ({(r["fit"], r["feature"]): round(r["importance"], 9) for r in g.gains().collect()} for g in (local, large))
    assert one == two


def test_a_table_that_fits_a_task_by_its_bytes_is_not_grown_by_levels(spark, monkeypatch):
    from valuelens.operators import tree_levels

    rows, _, _ = rows_frame(spark)
    want = {(r["fit"], r["row"]): round(r["prediction"], 7) for r in TR.grow_fits(rows, 4, FITS).predictions().collect()}
    monkeypatch.setattr(TR, "LOCAL_ROWS", 100)  # of 400
    monkeypatch.setattr(TR, "CARRIED", 0)
    monkeypatch.setattr(tree_levels, "grow_large", lambda *_: pytest.fail("every tree's rows are shuffled"))
    got = {(r["fit"], r["row"]): round(r["prediction"], 7) for r in TR.grow_fits(rows, 4, FITS).predictions().collect()}
    assert got == want


def test_copies_of_a_large_table_are_bounded_in_bytes():
    fits = [TR.Fit((0,), trees=200) for _ in range(1_000)]
    for n in (10_000, 1_200_000):
        size = n * (TR.ROW_BYTES + 5)
        units = TR._units(fits, size)
        assert len(units) * size <= max(65 * size, TR.DEALT_BYTES * 1.02)
        assert sorted((k, t) for u in units for k, low, high in u for t in range(low, high)) == [(k, t) for k in range(1_000) for t in range(200)]


def test_weights_are_poisson_and_depend_on_the_row_alone():
    h = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, 20000)
    w = np.array([TR.tree_weights(TR.Fit((0,), 1), h, t) for t in range(5)])
    assert abs(w.mean() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01 and abs(w.var() - 1) < 0.05
    assert (TR.tree_weights(TR.Fit((0,), 1), h[::-1].copy(), 2)[::-1] == w[2]).all() and (w[0] != w[1]).any()
    assert abs(np.corrcoef(w)[0, 1]) < 0.03


def test_exact_sums_grow_one_tree_in_any_order_and_form():
    r = np.random.default_rng(12)
    n = 4000
    bins = np.concatenate([r.integers(0, 64, (2, n)), r.integers(0, 2, (12, n))]).astype(np.uint8)
    y = TR.snapped(np.log1p(r.integers(1, 10**6, n)), 2.0**-20)
    w, cols = r.poisson(1.0, n).astype(float), tuple(range(14))

    def grown(order, exact):
        on = order[w[order] > 0]
        return TR.grow(bins, y, on, np.zeros(len(on), np.int64), w[on], 1, cols, 2, None, exact)

    a = grown(np.arange(n), False)
    for order, exact in ((np.arange(n), True), (r.permutation(n), False), (r.permutation(n), True)):
        b = grown(order, exact)
        assert all((x == y).all() for x, y in zip(a, b, strict=True))
