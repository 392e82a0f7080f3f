"""Literal-row unit tests (FIXTURES.md section 2): boundaries, nulls, blanks, ties."""

import pytest
from pyspark.sql import functions as F

from valuelens.operators import clean as C
from valuelens.operators import filters as FL
from valuelens.operators.features import add_derived_features


def test_numeric_coercion_units_and_threshold(spark):
    rows = [("1200 sqft", "33 FT", "x", "12 sqft"), ("5 %", "2 acres", "y", "5 %"), ("1,5", "1,250,000", "z", "1,5"),
            ("nan", "", "w", ""), ("1d", "7 m2", "v", "2 ha")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    dec = C.numeric_decisions(df)
    # a: '1d' is not a plain number -> 3/4; b: '1,250,000' -> '1.250.000' fails -> 3/4 (reference parity);
    # blanks and 'nan' do not count; d: 4/4
    assert dec == {"a": False, "b": False, "c": False, "d": True}
    got = [r.d for r in C.clean_numeric(df).orderBy("c").collect()]  # c order: v w x y z
    assert got == [2.0, None, 12.0, 5.0, 1.5]
    assert C.numeric_decisions(df, ["b"], thousands=True) == {"b": True}


def test_coerce_rejects_java_suffixes(spark):
    df = spark.createDataFrame([("1d",), ("2f",), ("nan",), (" 3.5 ",), ("1e3",), ("-.5",)], "s string")
    assert [r[0] for r in df.select(C.coerce_numeric("s")).collect()] == [None, None, None, 3.5, 1000.0, -0.5]


def test_parking_and_fireplace_text(spark):
    rows = [("Total spaces: 3 (2 covered)", "1 Gas"), ("2 Garage", "Wood"), ("RV", ""), ("", None), (None, "12")]
    df = spark.createDataFrame(rows, "parking_spaces string, fireplace string")
    out = add_derived_features(df, 2025).collect()
    assert [r.n_parking_spaces for r in out] == [3.0, 2.0, None, None, None]
    assert [r.n_covered_parking for r in out] == [2.0, 0.0, 0.0, 0.0, 0.0]
    assert [r.has_garage for r in out] == [0.0, 1.0, 0.0, 0.0, 0.0]
    assert [r.has_rv_parking for r in out] == [0.0, 0.0, 1.0, 0.0, 0.0]
    assert [r.n_fireplaces for r in out] == [1.0, 1.0, 0.0, 0.0, 5.0]  # clip 0..5
    assert [r.has_gas_fireplace for r in out] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_clip_keeps_nulls_and_zero_denominators(spark):
    rows = [(None, 0.0, 0.0, 0.0, 100.0), (1700.0, 1000.0, 5.0, 2.0, 0.0), (2030.0, 10.0, 0.0, 1.0, 50.0)]
    df = spark.createDataFrame(rows, "year_built double, floor_area_sqft double, rooms double, bathrooms double, price double")
    out = add_derived_features(df, 2025).collect()
    assert out[0].age is None and out[0].room_density is None and out[0].ppsf is None
    assert out[1].age == 200.0 and out[1].room_density == 0.5 and out[1].bath_ratio == 0.4 and out[1].ppsf == 50.0
    assert out[2].age == 0.0 and out[2].bath_ratio is None and out[2].ppsf == 50.0


def test_flags(spark):
    df = spark.createDataFrame([(None,), ("",), ("ab",), ("abc",), ("  ab  ",)], "view string")
    assert [r.has_view for r in add_derived_features(df).collect()] == [0.0, 0.0, 0.0, 1.0, 0.0]


@pytest.mark.parametrize("n,expect_fenced", [(9, False), (10, False), (19, False), (20, True)])
def test_fence_minimum_rows(spark, n, expect_fenced):
    rows = [(i, float(100 + i)) for i in range(n - 1)] + [(n, 1e9)]
    df = spark.createDataFrame(rows, "k int, y double")
    out = FL.outlier_fence(df, "y", 3.0, min_rows=20).count()
    assert out == (n - 1 if expect_fenced else n)


def test_leakage_guard():
    kept, removed = FL.leakage_guard(["price", "sqft", "ppsf", "district"], "sold_price")
    assert kept == ["sqft", "district"] and removed == ["price", "ppsf"]
    kept, removed = FL.leakage_guard(["ppsf", "district"], "sold_price")
    assert kept == ["ppsf", "district"] and removed == []
    assert FL.leakage_guard(["price", "ppsf"], "price") == (["ppsf"], [])


def test_any_token_filter(spark):
    df = spark.createDataFrame([("Elevator, Storage",), ("Pool",), (None,)], "f string")
    assert FL.any_token_filter(df, {"f": ["Storage", "Gym"]}).count() == 1


def test_hidden_columns():
    assert C.is_hidden_col("listing_agent_phone") and C.is_hidden_col("Street") and C.is_hidden_col("_source")
    assert not C.is_hidden_col("agency") and not C.is_hidden_col("price")
