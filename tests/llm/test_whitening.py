"""Embedding whitening against numpy over all rows."""

import numpy as np
import pytest

from valuelens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, x int, weight string, rows int"


def frame(spark, rows):
    """Vectors with extra columns whose names clash with the operator's own."""
    return spark.createDataFrame([(i, v, "n", 1, "w", 2) for i, v in rows], SCHEMA)


def vectors(seed=4, n=120, d=12):
    r = np.random.default_rng(seed)
    base = (r.normal(size=(n, d)) * np.linspace(3, 0.2, d)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(1000 + k, base[0].tolist()) for k in range(90)]  # a hot vector
    rows += [(5, base[5].tolist()), (5, base[5].tolist()), (None, base[6].tolist())]
    bad = [(2000, None), (2001, [*base[1].tolist()[:-1], None]), (2002, [*base[1].tolist()[:-1], float("nan")]), (2003, [float("inf")] * d), (2004, []), (2005, [1.0, 2.0])]
    return rows, bad


def brute(rows, most=8, distinct=False):
    x = np.array([np.floor(1024.0 * np.array(v, np.float32).astype(np.float64)).astype(np.int64) + 100000 for _, v in rows])
    fit = np.unique(x, axis=0) if distinct else x
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    cov = z.T @ z / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    white = (x - s / n) @ q[:, :most] / np.sqrt(e[:most])
    dev = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))) for row in x]
    return n, dev, white, e[:most] / np.trace(cov)


@pytest.mark.parametrize("weights", ["rows", "distinct"])
@pytest.mark.parametrize("hot", [1_000, 20])
def test_whitened(spark, monkeypatch, weights, hot):
    monkeypatch.setattr(whitening, "HOT_ROWS", hot)
    rows, bad = vectors()
    got = whitening.whiten(frame(spark, rows + bad).repartition(5), weights=weights).collect()
    n, dev, white, share = brute(rows, distinct=weights == "distinct")
    assert len(got) == 8 * len(rows) and {r["n"] for r in got} == {n}
    sign = {}
    want = {}
    for k, (i, _) in enumerate(rows):
        want.setdefault(i, []).append((dev[k], white[k]))
    for r in got:
        c = r["component"] - 1
        d, w = want[r["vec_id"]][0]
        assert r["deviation"] == d and abs(r["explained"] - share[c]) < 1e-9
        s = sign.setdefault(c, 1.0 if r["whitened"] * w[c] > 0 else -1.0)
        assert abs(r["whitened"] - s * w[c]) < 1e-8
        assert r["identity_error"] < 1e-9
    assert {i: len(v) * 8 for i, v in want.items()} == {i: sum(r["vec_id"] == i for r in got) for i in want}


def test_edges(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0, 3.0])])).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one, key=lambda r: r["component"])] == [(c, 1, 0, None, None, None) for c in (1, 2, 3)]
    flat = whitening.whiten(frame(spark, [(1, [1.0, 5.0]), (2, [2.0, 5.0])])).collect()
    assert sorted((r["vec_id"], r["component"], None if r["whitened"] is None else round(abs(r["whitened"]), 9)) for r in flat) == [(1, 1, 1.0), (1, 2, None), (2, 1, 1.0), (2, 2, None)]
    huge = whitening.whiten(frame(spark, [(1, [3e38, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])])).collect()
    assert len(huge) == 6 and {r["deviation"] for r in huge} == {None}


def test_packing_round_trip():
    x = np.random.default_rng(1).integers(-(2**60), 2**60, (50, 7))
    import pyarrow as pa

    packed = whitening.pack_rows(x)
    assert (whitening.unpack_rows(pa.array(packed, pa.binary())) == x).all()
    assert len({p for p in packed}) == 50
