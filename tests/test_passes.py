"""Operators read their rows as often as they say, and give the same figures by brute force."""

import statistics
import uuid

from valuelens.operators import filters as FL
from valuelens.operators import models as MD
from valuelens.operators import profile as P
from valuelens.operators import valuation as V

CITIES, DISTRICTS = ["a", "b", None, ""], ["x", None, "y", "z", "x"]
ROWS = [(i, CITIES[i % 4], DISTRICTS[i % 5], None if i % 7 == 0 else float(i % 11), None if i % 3 else i) for i in range(60)]
SCHEMA = "id int, city string, district string, price double, rooms int"


def counted(spark, folder, rows=ROWS, schema=SCHEMA):
    """Rows in one partition, and a function that tells how often they were made."""
    at = str(folder)

    def note(batches):
        with open(f"{at}/{uuid.uuid4().hex}", "w"):
            pass
        yield from batches

    return spark.createDataFrame(rows, schema).coalesce(1).mapInArrow(note, schema), lambda: len(list(folder.iterdir()))


def test_profile_reads_once(spark, tmp_path):
    df, passes = counted(spark, tmp_path)
    got = {r["column_name"]: r for r in P.dataset_profile(df).collect()}
    assert passes() == 1
    for i, c in enumerate(["id", "city", "district", "price", "rooms"]):
        cells = [r[i] for r in ROWS if r[i] is not None]
        text = c in ("city", "district")
        want = (i, "categorical" if text else "numeric", len(ROWS), round(1 - len(cells) / len(ROWS), 3), len(set(cells)) if text else None)
        assert tuple(got[c][k] for k in ("position", "kind", "n_rows", "null_rate", "n_distinct")) == want
    only = {r["column_name"]: (r["null_rate"], r["n_distinct"], r["n_rows"]) for r in P.dataset_profile(df.select("price")).collect()}
    assert only == {"price": (round(9 / 60, 3), None, 60)}
    only = {r["column_name"]: (r["null_rate"], r["n_distinct"], r["n_rows"]) for r in P.dataset_profile(df.select("city")).collect()}
    assert only == {"city": (0.25, 3, 60)}


def test_coverage_reads_training_rows_once(spark, tmp_path):
    train, passes = counted(spark, tmp_path)
    scored = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "b", None), (4, "q", "q"), (5, "", "z")], "id int, city string, district string")
    got = {r["id"]: (r["n_district"], r["n_city"]) for r in V.attach_coverage(scored, train).collect()}
    assert passes() == 1
    n = lambda i, v: sum(r[i] == v for r in ROWS) if v is not None else 0
    assert got == {r["id"]: (n(2, r["district"]), n(1, r["city"])) for r in scored.collect()}


def test_fair_values_read_training_rows_once(spark, tmp_path):
    train, passes = counted(spark, tmp_path)
    score = V.group_median_model(train, "price", ["city", "district"])
    got = {r["id"]: r["prediction"] for r in score(spark.createDataFrame([(1, "a", "x"), (2, "q", "q")], "id int, city string, district string")).collect()}
    assert passes() == 1
    assert got == {1: statistics.median(r[3] for r in ROWS if r[1:3] == ("a", "x") and r[3] is not None), 2: statistics.median(r[3] for r in ROWS if r[3] is not None)}


def test_usable_target_makes_other_columns_only_if_needed(spark, tmp_path):
    df, passes = counted(spark, tmp_path, [(1, "12", None), (2, None, None)], "id int, price string, sold_price string")
    assert FL.usable_target(df, "price") == "price" and passes() == 1
    assert FL.usable_target(df, "sold_price") == "price" and passes() == 3
    assert FL.usable_target(df.select("sold_price"), "sold_price") is None


def test_training_keeps_its_rows_once(spark, monkeypatch):
    """The rows of the fence and the encoders are kept by the training: no second copy."""
    keeps = []
    for module, name in ((MD.FL, "outlier_fence"), (MD.E, "fit_encoders")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), **k: (keeps.append(k.get("keep", True)), _f(*a, **k))[1])
    rows = spark.createDataFrame([(i, float(i), 2.0 * i + 1) for i in range(40)], "id int, x double, y double")
    assert MD.train_model(rows, "y", ["x"], ["id"], "linear", use_log=False).metrics["r2"] > 0.999
    assert keeps == [False, False]
