"""FIXTURES.md section 2: literal boundary fixtures for comps, similar, impact, correlation, segments, training, CSV bytes."""

import pytest
from pyspark.sql import functions as F

from valuelens.operators import similar as S

CAND = "k long, street string, district string, city string, property_type string, floor_area_sqft double, price double"


def _comps(spark, cands, query):
    c = spark.createDataFrame(cands, CAND)
    q = spark.createDataFrame([query], "query_id string, district string, city string, street string, floor_area_sqft double, property_type string, actual_price double")
    return S.comps(q, c, "price", ["k"], display=["street", "district", "city"])


def test_comps_area_ratio_and_price_band(spark):
    cands = [(1, "s1", "D", "C", "H", 59.0, 100.0), (2, "s2", "D", "C", "H", 60.0, 100.0), (3, "s3", "D", "C", "H", 170.0, 100.0),
             (4, "s4", "D", "C", "H", 171.0, 100.0), (5, "me", "D", "C", "H", 100.0, 100.0), (6, "s6", "D", "C", "Apt", 100.0, 100.0),
             (7, "s7", "D", "C", "H", 100.0, 33.0), (8, "s8", "D", "C", "H", 100.0, 300.0), (9, "s9", "D", "C", "H", 100.0, 301.0)]
    got = {r.k for r in _comps(spark, cands, ("q", "D", "C", "me", 100.0, "H", 100.0)).collect()}
    # 0.59 and 1.71 out, 0.6 and 1.7 in; own street out; other type out; price 33 < 100/3 out, 300 in, 301 out
    assert got == {2, 3, 8}


def test_comps_widen_to_city_when_fewer_than_two(spark):
    one = [(1, "a", "D1", "C", "H", 100.0, 100.0), (2, "b", "D2", "C", "H", 100.0, 110.0), (3, "c", "D3", "C", "H", 100.0, 120.0)]
    r = _comps(spark, one, ("q", "D1", "C", "", 100.0, "H", 100.0)).collect()
    assert {x.k for x in r} == {1, 2, 3} and {x.level for x in r} == {2}
    two = one + [(4, "d", "D1", "C", "H", 100.0, 105.0)]
    r = _comps(spark, two, ("q", "D1", "C", "", 100.0, "H", 100.0)).collect()
    assert {x.k for x in r} == {1, 4} and {x.level for x in r} == {1}
    assert [x.k for x in sorted(r, key=lambda x: x.rank)] == [1, 4]  # nearest price first


def test_similar_scope_needs_three_rows(spark):
    edges = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "B"), ("B", "A")], "city string, nearby string")
    rows = [(1, "A", "H", 10.0), (2, "A", "H", 11.0), (3, "A", "T", 12.0), (4, "B", "H", 13.0), (5, "B", "H", 14.0)]
    cand = spark.createDataFrame(rows, "k long, city string, property_type string, floor_area_sqft double").withColumn("price", F.col("floor_area_sqft") * 10)
    feats = ["floor_area_sqft", "property_type", "city"]
    kinds = {"floor_area_sqft": "numeric", "property_type": "categorical", "city": "categorical"}

    def scope(city, ptype):
        q = spark.createDataFrame([("q", 10.0, ptype, city)], "query_id string, q_floor_area_sqft double, q_property_type string, q_city string")
        return {r.scope for r in S.similar(q, cand, edges, feats, kinds, ["k"], top_n=5).collect()}

    assert scope("A", "H") == {"same city"}  # 2 rows of A+H, 3 rows of A
    assert scope("B", "H") == {"nearby+type"}  # B has 2 rows, B+A nearby H rows: 4
    assert scope("B", "T") == {"nearby cities"}  # nearby T: 1 row, nearby all: 5
    assert scope("Z", "H") == {"all"}


def test_category_impact_min_count_and_multi(spark):
    from valuelens.operators.impact import category_impact

    rows = [("a", "x, y", float(v)) for v in range(4)] + [("b", "y", float(v)) for v in range(5)]
    df = spark.createDataFrame(rows, "c string, m string, t double")
    out = {(r.cat_column, r.cat_value): r.n_rows for r in category_impact(df, "t", ["c"]).collect()}
    assert out == {("c", "b"): 5}  # the 4-row group is dropped
    multi = {(r.cat_column, r.cat_value): r.n_rows for r in category_impact(df, "t", ["m"], delimiter=",").collect()}
    assert multi == {("m", "y"): 9}


def test_constant_and_sparse_columns_correlate_to_zero(spark):
    from valuelens.operators.stats import correlation_matrix

    rows = [(1.0, float(i), None if i % 3 else float(i) * 2) for i in range(10)]
    df = spark.createDataFrame(rows, "const double, x double, sparse double")
    m = {(r.col1, r.col2): r.correlation for r in correlation_matrix(df, ["const", "x", "sparse"]).collect()}
    assert m[("const", "x")] == 0.0 and m[("const", "const")] == 0.0
    assert m[("x", "sparse")] == 1.0 and m[("x", "x")] == 1.0  # pairwise complete


@pytest.mark.parametrize("size,method", [(2, None), (3, "in_sample"), (5, "in_sample"), (6, "kfold"), (19, "kfold"), (20, "holdout")])
def test_segment_size_rules(spark, size, method):
    from valuelens.operators.segments import segment_models

    rows = [(i, "S", float(i % 4), 100.0 + 3 * (i % 4) + (i % 3)) for i in range(size)]
    df = spark.createDataFrame(rows, "k long, s string, a double, y double")
    rep = segment_models(df, "s", "y", ["a"], ["k"])[0].collect()
    if method is None:
        assert rep == []
    else:
        assert rep[0].method == method and rep[0].n_rows == size
        assert (rep[0].r2 is None) == (method == "in_sample")


@pytest.mark.parametrize("n,ok", [(4, False), (5, True)])
def test_training_minimum_rows(spark, n, ok):
    from valuelens.operators.models import train_model

    df = spark.createDataFrame([(i, float(i), 100.0 + i) for i in range(n)], "k long, a double, y double")
    if ok:
        m = train_model(df, "y", ["a"], ["k"], "linear", remove_outliers=False)
        assert m.metrics["train_size"] == n
    else:
        with pytest.raises(ValueError):
            train_model(df, "y", ["a"], ["k"], "linear", remove_outliers=False)


def test_csv_bytes_bom_tab_and_cp1251(spark):
    from valuelens.session import scratch_dir
    from valuelens.sources.csv import read_csv

    base = scratch_dir(spark, "bytes")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def put(name, data: bytes):
        p = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}/part.csv")
        out = p.getFileSystem(conf).create(p, True)
        out.write(bytearray(data))
        out.close()
        return f"{base}/{name}"

    bom = put("bom", "﻿a,b\n1,\"x \"\"q\"\"\"\n".encode("utf-8"))
    df, enc = read_csv(spark, bom)
    assert df.columns == ["a", "b"] and enc == "utf-8" and df.first().b == 'x "q"'
    tab = put("tab", "a\tb\tc\n1\t2\t3\n".encode("utf-8"))
    df, _ = read_csv(spark, tab)
    assert df.columns == ["a", "b", "c"]
    cyr = put("cyr", "город;цена\nМосква;5\n".encode("cp1251"))
    df, enc = read_csv(spark, cyr)
    assert enc == "cp1251" and df.columns == ["город", "цена"] and df.first()["город"] == "Москва"


@pytest.mark.parametrize("n,holdout", [(29, False), (30, True)])
def test_training_holdout_threshold(spark, n, holdout):
    from valuelens.operators.models import train_model

    df = spark.createDataFrame([(i, float(i % 5), 100.0 + 2 * (i % 5) + i % 2) for i in range(n)], "k long, a double, y double")
    m = train_model(df, "y", ["a"], ["k"], "linear", remove_outliers=False)
    if holdout:
        assert m.metrics["train_size"] + m.metrics["test_size"] == n and m.metrics["test_size"] < n
    else:
        assert m.metrics["train_size"] == m.metrics["test_size"] == n  # cross-validated on all rows
    assert m.metrics["mape_cv"] is not None  # always computed (reference quirk Q2)


def test_privacy_fixture(spark):
    from valuelens.operators.privacy import mask

    rows = [("http://a", "1 Main St", "Vancouver", "Kits", None, 3.0), ("", "nan", "Vancouver", None, "x@y", 5.0),
            (None, None, "Burnaby", "Metrotown", "", 7.0)]
    df = spark.createDataFrame(rows, "summary_url string, street string, city string, district string, email string, photo_count double")
    out = mask(df, True).orderBy("photo_count").collect()
    assert [r.summary_url for r in out] == ["HIDDEN", "", None]
    assert [r.street for r in out] == ["Address #1", "nan", None]
    assert [r.city for r in out] == ["City 2", "City 2", "City 1"]  # repeated city keeps its alias; value order
    assert [r.district for r in out] == ["District 1", None, "District 2"]
    assert [r.email for r in out] == [None, "HIDDEN", ""]
    assert [r.photo_count for r in out] == [3.0, 5.0, 7.0]  # numbers pass through
    assert mask(df, False).collect() == df.collect()


# ------------------------------------------------------------------ round 2
def test_mape_of_negative_actuals(spark):
    from valuelens.operators.stats import regression_metrics

    df = spark.createDataFrame([(-100.0, -50.0), (100.0, 50.0)], "y double, p double")
    assert regression_metrics(df, "y", "p").first()["mape"] == 50.0


def test_untagged_rows_stay(spark):
    from valuelens.operators import filters as FL
    from valuelens.sources import manage as MG

    df = spark.createDataFrame([("A", 1), ("N", 2), (None, 3)], "_source string, v int")
    for kept in (MG.remove_source(df, "N"), FL.exclude_sources(df, ["N"]), FL.source_split(df, "", "N")[0]):
        assert sorted(r.v for r in kept.collect()) == [1, 3]


def test_keys_of_any_type_have_a_fold(spark):
    from valuelens.operators.linear import fold_column

    df = spark.createDataFrame([("R2912345",), (None,), ("7",), ("x",)], "k string")
    folds = [r.f for r in df.select(fold_column(["k"], 5).alias("f")).collect()]
    assert all(f is not None and 0 <= f < 5 for f in folds)


def test_comps_without_city_keep_one(spark):
    from valuelens.operators.similar import comps

    q = spark.createDataFrame([("q", "D1", None, "s0", 100.0, "House", 500.0)],
                              "query_id string, district string, city string, street string, floor_area_sqft double, property_type string, actual_price double")
    c = spark.createDataFrame([(1, "D1", "C", "s1", 100.0, "House", 510.0), (2, "D2", "C", "s2", 100.0, "House", 505.0)],
                              "k int, district string, city string, street string, floor_area_sqft double, property_type string, sold_price double")
    got = comps(q, c, "sold_price", ["k"]).collect()
    assert [(r.k, r.level) for r in got] == [(1, 1)]


def test_moments_match_numpy_with_many_columns(spark):
    import numpy as np

    from valuelens.operators.linear import moments

    x = np.random.default_rng(0).normal(5, 2, (200, 60))
    df = spark.createDataFrame([(int(i % 3), *map(float, r)) for i, r in enumerate(x)], ["g"] + [f"c{i}" for i in range(60)])
    for r in moments(df, [f"c{i}" for i in range(59)], "c59", ["g"]).collect():
        own = x[np.arange(200) % 3 == r["g"]]
        assert r["_n"] == len(own)
        assert np.allclose(r["_mean"], own.mean(0)) and np.allclose(np.array(r["_C"]).reshape(60, 60), np.cov(own.T, bias=True))


def test_bad_byte_late_in_a_file(spark, tmp_path):
    from valuelens.sources.csv import read_csv

    path = tmp_path / "late.csv"
    path.write_bytes(b"a,b\n" + b"1,x\n" * 12_000 + b"2,caf\xe9\n" + b"3,y\n" * 3_000)
    before = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    df, enc = read_csv(spark, str(path))
    assert enc != "utf-8" and df.where("a = '2'").first()["b"][:3] == "caf" and "�" not in df.where("a = '2'").first()["b"]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", None) == before


def test_many_candidates(spark):
    from itertools import combinations

    from valuelens.operators.search import feature_subsets

    names = [f"f{i}" for i in range(60)]
    got = feature_subsets(spark, names, min_features=1, max_features=2).orderBy("subset_idx").collect()
    assert [tuple(r.features) for r in got] == [c for n in (1, 2) for c in combinations(names, n)]
    assert feature_subsets(spark, names, min_features=3, max_features=3).count() == 34_220


def test_cache_key_knows_parameters_and_data(spark):
    from pyspark.sql import functions as F

    from valuelens.sources import cache as CA

    def key(**kw):
        return spark.range(1).select(CA.cache_key(F.lit(5), ["a"], F.array(F.lit("a")), "rf", True, True, **kw).alias("k")).first().k

    assert len({key(), key(extra=(10,)), key(extra=(200,))}) == 3
    assert CA.fingerprint(spark.createDataFrame([(1,), (2,)], "a int")) != CA.fingerprint(spark.createDataFrame([(1,), (3,)], "a int"))


@pytest.mark.parametrize("model_type", ["linear", "rf_fast", "gradient_boosting", "stacking"])
def test_every_model_kind_reloads(spark, model_type):
    from valuelens.operators import models as MD
    from valuelens.session import scratch_dir
    from valuelens.sources import registry as RG

    df = spark.createDataFrame([(i, float(i % 17), ["a", "b", "c"][i % 3], float(3 * (i % 17) + i % 3 + 10)) for i in range(120)], "k int, x double, c string, y double")
    m = MD.train_model(df, "y", ["x", "c"], ["k"], model_type=model_type, trees=3, max_depth=3)
    root = scratch_dir(spark, "registry-test")
    again = RG.load_model(spark, root, RG.save_model(spark, root, m))
    first, second = (sorted((r.k, round(r.prediction, 6)) for r in x.predict(df).select("k", "prediction").collect()) for x in (m, again))
    assert first == second


def test_weighted_fit_is_repetition(spark):
    from valuelens.operators.linear import fit_linear

    rows = [(1.0, 2.0, 1.0), (2.0, 3.0, 2.0), (3.0, 7.0, 1.0), (9.0, 9.0, 0.0), (9.0, 9.0, None)]
    df = spark.createDataFrame(rows, "x double, y double, w double")
    many = spark.createDataFrame([rows[0], rows[1], rows[1], rows[2]], "x double, y double, w double")
    a, b = fit_linear(df, ["x"], "y", weight="w").first(), fit_linear(many, ["x"], "y").first()
    assert abs(a["_intercept"] - b["_intercept"]) < 1e-9 and abs(a["_coef"][0] - b["_coef"][0]) < 1e-9 and a["_n_train"] == b["_n_train"]
