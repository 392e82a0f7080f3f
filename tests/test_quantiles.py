import numpy as np
import pytest

from valuelens.operators.quantiles import group_quantiles, ordered_bucket, quantile_row


@pytest.mark.parametrize("bound", [500_000, 0])  # 0 forces the histogram-narrowing path
def test_group_quantiles_match_numpy(spark, bound):
    rng = np.random.RandomState(7)
    vals = np.concatenate([rng.lognormal(10, 1, 900), rng.normal(0, 3, 300), [0.0] * 20, [-0.0] * 3, [5e-300, -1e300, 3.5] * 5])
    rows = [(int(i % 4), float(v)) for i, v in enumerate(vals)] + [(9, None), (9, 1.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {r.g: r for r in group_quantiles(df, ["g"], "v", [0.1, 0.25, 0.5, 0.75, 0.9], ["a", "b", "c", "d", "e"], max_group_rows=bound).collect()}
    for g in range(4):
        x = np.array([v for k, v in rows if k == g and v is not None])
        exp = np.percentile(x, [10, 25, 50, 75, 90])
        r = got[g]
        assert r._n == len(x)
        assert np.allclose([r.a, r.b, r.c, r.d, r.e], exp, rtol=1e-12, atol=1e-300)
    assert got[9]._n == 1 and got[9].c == 1.0  # nulls ignored


def test_whole_frame_quantile_narrowing(spark):
    df = spark.range(0, 10001).selectExpr("cast(id as double) * 0.5 as v")
    r = quantile_row(df, "v", [0.25, 0.5], ["q1", "q2"], max_group_rows=0).first()
    assert r.q1 == 1250.0 and r.q2 == 2500.0 and r._n == 10001


def test_ordered_bucket_is_monotone(spark):
    vals = sorted([-1e10, -3.0, -2.0, -1.0000001, -1.0, -1e-9, 0.0, 1e-9, 0.5, 0.9999999, 1.0, 1.0000001, 2.0, 3.0, 1e10])
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    from pyspark.sql import functions as F

    out = [r[0] for r in df.select(ordered_bucket(F.col("v"), 12)).collect()]
    out32 = [r[0] for r in df.select(ordered_bucket(F.col("v"), 32)).collect()]
    assert out == sorted(out) and out32 == sorted(out32)


def test_leave_fold_out_quantiles_match_numpy(spark):
    from valuelens.operators.quantiles import leave_fold_out_quantiles

    rng = np.random.RandomState(5)
    vals = np.concatenate([rng.lognormal(5, 1, 700), [0.0] * 10, [-2.5] * 5])
    rows = [(int(i % 3), int(i % 4), float(v)) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g int, f int, v double")
    got = {(r.g, r._held): r for r in leave_fold_out_quantiles(df, ["g"], "f", 4, "v", [0.5, 0.25], ["m", "q"]).collect()}
    for g in range(3):
        for h in range(4):
            x = np.array([v for gg, ff, v in rows if gg == g and ff != h])
            r = got[(g, h)]
            assert r._n == len(x) and np.allclose([r.m, r.q], np.percentile(x, [50, 25]), rtol=1e-12)
    glob = {r._held: r.m for r in leave_fold_out_quantiles(df, [], "f", 4, "v", [0.5], ["m"]).collect()}
    assert all(np.isclose(glob[h], np.percentile([v for _, ff, v in rows if ff != h], 50)) for h in range(4))


@pytest.mark.parametrize("bound", [500_000, 0])
def test_weights_are_copies(spark, bound):
    rng = np.random.RandomState(5)
    rows = [(int(i % 3), float(np.round(rng.normal(), 2)), float(rng.randint(-1, 5))) for i in range(400)] + [(0, None, 2.0), (1, 5.0, None)]
    df = spark.createDataFrame(rows, "g int, v double, w double")
    got = {r.g: r for r in group_quantiles(df, ["g"], "v", [0.1, 0.5, 0.9], ["a", "b", "c"], extra={"m": "avg", "s": "sum", "lo": "min"}, max_group_rows=bound, weight="w").collect()}
    for g in range(3):
        x = np.concatenate([[v] * int(w) for k, v, w in rows if k == g and v is not None and w is not None and w > 0])
        r = got[g]
        assert r._n == len(x) and np.allclose([r.a, r.b, r.c, r.m, r.s, r.lo], [*np.percentile(x, [10, 50, 90]), x.mean(), x.sum(), x.min()])
    half = spark.createDataFrame([(1.0, 0.5), (2.0, 0.5), (9.0, 0.25)], "v double, w double")
    r = quantile_row(half, "v", [0.5], ["m"], max_group_rows=bound, weight="w").first()
    assert r.m == 2.0 and r._n == 1.25


def test_bucket_columns_are_those_of_the_expression(spark):
    from pyspark.sql import functions as F

    from valuelens.operators.quantiles import with_buckets

    rng = np.random.RandomState(3)
    exact = [s * 2.0**e for e in (-1074, -1022, -3, 0, 1, 52, 1023) for s in (1.0, -1.0)]
    vals = [*exact, *(v * (1 - 2.0**-53) for v in exact[4:]), *rng.lognormal(0, 30, 300), *-rng.lognormal(0, 30, 300), 0.0, -0.0, 1.7976931348623157e308]
    rows = with_buckets(spark.createDataFrame([(float(v),) for v in vals], "v double"), "v").select(
        "_b1", "_b2", ordered_bucket(F.col("v"), 12).alias("c1"), ordered_bucket(F.col("v"), 32).alias("c2")).collect()
    assert len(rows) == len(vals) and all(r._b1 == r.c1 and r._b2 == r.c2 for r in rows)


def test_narrowing_takes_infinite_values(spark):
    df = spark.createDataFrame([(v,) for v in (float("-inf"), 1.0, 2.0, 3.0, float("inf"))], "v double")
    assert quantile_row(df, "v", [0.25, 0.5, 0.75], ["a", "b", "c"], max_group_rows=0).first()[1:] == (1.0, 2.0, 3.0)


def test_a_bucket_costs_one_logarithm(spark):
    from valuelens.operators.quantiles import _semi, with_buckets

    d = with_buckets(spark.range(10).selectExpr("id % 2 as k", "cast(id as double) as v"), "v")
    wanted = spark.createDataFrame([(0, 1)], "k long, _b1 long")
    counted = _semi(d, wanted, ["k", "_b1"], 1).groupBy("k", "_b1", "_b2").count()
    for x in (d, counted, wanted.join(counted, ["k", "_b1"])):
        plan = x._jdf.queryExecution().optimizedPlan().toString().lower()
        assert plan.count("log2(") == 1 and plan.count("power(") == 1


def test_every_level_is_one_pass_over_the_rows(spark):
    """Rows are read by the count, by two levels and by the last one; no level is made again for a later one, nor for a report's joins."""
    from valuelens.operators.impact import category_impact

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    d = spark.range(1000).selectExpr("cast(id as double) as v").mapInArrow(seen, "v double")
    d = d.selectExpr("v", "'a' as c", "'b' as e")
    assert quantile_row(d.union(d), "v", [0.5], ["m"], max_group_rows=0, keep=False).first().m == 499.5
    assert read.value == 8000
    assert category_impact(d, "v", ["c", "e"], max_group_rows=0).count() == 2
    assert read.value == 9000  # kept wide, and read once
