"""Driver contract: entry() smoke, every oracle key has a query, oracle checks at sf0.001."""

import importlib.util
import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_entry_smoke(spark):
    df = _entry().entry(spark)
    assert df.count() > 0
    assert {"cat_column", "cat_value", "mean_target", "median_target", "n_rows"} <= set(df.columns)


def test_oracle_keys_subset_of_queries():
    m = _entry()
    assert set(m.oracle_sql()) <= set(m.queries())


FAST_ORACLE = ["category_impact", "category_impact_multi", "clean_numeric", "derived_parking", "filter_tokens", "outlier_fence",
               "correlation_matrix", "linear_cv", "encode_target", "segment_models", "undervalued", "privacy_mask",
               "feature_subsets", "page_records", "typical_values"]


@pytest.mark.parametrize("name", FAST_ORACLE)
def test_oracle_sf0001(spark, name):
    import sys

    sys.path.insert(0, os.path.join(ROOT, "tests"))
    from oracle_check import compare

    res = compare(spark, "/root/testdata/sf0.001", {name}, verbose=False)
    assert res[name][0] == "ok", res[name]


def test_entry_importable_without_session(tmp_path):
    """queries() / oracle_sql() must not need an active SparkContext (the driver may read SQL first)."""
    import subprocess
    import sys

    code = ("import importlib.util; s = importlib.util.spec_from_file_location('e', %r); m = importlib.util.module_from_spec(s); "
            "s.loader.exec_module(m); print(len(m.queries()), len(m.oracle_sql()))") % os.path.join(ROOT, "__spark_entry__.py")
    out = subprocess.run([sys.executable, "-c", code], cwd=str(tmp_path), capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    n_q, n_sql = map(int, out.stdout.split())
    assert n_q >= n_sql > 0
