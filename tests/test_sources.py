"""Geography files, result corpus, CSV sniffing (literal fixtures written to the scratch store)."""

import json

from valuelens.session import scratch_dir
from valuelens.sources import cache as CA
from valuelens.sources import csv as CSV
from valuelens.sources import geography as G


def _write_text(spark, path, lines):
    spark.createDataFrame([(ln,) for ln in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def test_geography_shapes_agree(spark):
    base = scratch_dir(spark, "geo-test")
    _write_text(spark, f"{base}/cities", [json.dumps({"province": "P", "country": "C", "cities": ["A", "B"]})])
    _write_text(spark, f"{base}/districts", [json.dumps({"province": "P", "country": "C", "districts": [
        {"district": "a1", "city": "A"}, {"district": "a2", "city": "A"}, {"district": "b1", "city": "B"}]})])
    _write_text(spark, f"{base}/hier", [json.dumps({"country": "C", "province": "P", "cities": {
        "A": {"districts": ["a1", "a2"], "district_count": 2}, "B": {"districts": ["b1"], "district_count": 1}}})])
    assert G.read_cities(spark, f"{base}/cities").count() == 2
    d = {(r.district, r.city) for r in G.read_districts(spark, f"{base}/districts").collect()}
    h = {(r.district, r.city) for r in G.read_hierarchy(spark, f"{base}/hier").collect()}
    assert d == h and len(d) == 3


def test_result_corpus(spark):
    base = scratch_dir(spark, "corpus-test")
    rows = [json.dumps([{"features": ["district", "lot_ratio"], "n_features": 2, "model": "Random Forest", "r2": 12.5, "mae": 4321.0}]),
            json.dumps([])]
    _write_text(spark, base, rows)
    c = CA.read_corpus(spark, base).collect()
    assert len(c) == 1 and c[0].r2 == 12.5 and c[0].mape is None


def test_sniff_semicolon(spark):
    base = scratch_dir(spark, "sniff-test")
    _write_text(spark, base, ["a;b;c", "1;2;3"])
    df, enc = CSV.read_csv(spark, base)
    assert df.columns == ["a", "b", "c"] and enc == "utf-8"


def test_folder_stream_runs_take_only_new_files(spark):
    from valuelens.streaming.folder_stream import ingest_once, read_sink

    base = scratch_dir(spark, "stream-test")
    schema = "id BIGINT, v STRING"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).coalesce(1).write.option("header", True).csv(f"{base}/ads")
    ingest_once(spark, f"{base}/ads", schema, f"{base}/sink", f"{base}/ckpt")
    assert read_sink(spark, f"{base}/sink").count() == 2
    ingest_once(spark, f"{base}/ads", schema, f"{base}/sink", f"{base}/ckpt")  # nothing new: nothing added
    assert read_sink(spark, f"{base}/sink").count() == 2
    spark.createDataFrame([(3, "c")], schema).coalesce(1).write.mode("append").option("header", True).csv(f"{base}/ads")
    ingest_once(spark, f"{base}/ads", schema, f"{base}/sink", f"{base}/ckpt")
    out = read_sink(spark, f"{base}/sink")
    assert sorted(r.id for r in out.collect()) == [1, 2, 3]
    assert {r._source.split("/")[0] for r in out.collect()} == {"ads"}


def test_source_management(spark):
    from valuelens.sources import manage as M

    primary = spark.createDataFrame([(1, "10")], "id long, price string")
    sold = spark.createDataFrame([(2, 20.0, 5.0)], "id long, price double, fee double")
    u = M.append_source(primary, sold, "sold/x.csv", "sold")
    assert dict(u.dtypes)["price"] == "string"  # clashing types reconciled to text
    rows = {r.id: r for r in u.collect()}
    assert rows[1]._source == "primary" and rows[1]._sample_weight == 1.0 and rows[1].fee is None
    assert rows[2]._file_type == "sold" and rows[2]._sample_weight == 3.0
    s = {r.source: r for r in M.source_summary(u, M.toggle([], "primary")).collect()}
    assert s["primary"].excluded and s["sold/x.csv"].total_active_rows == 1
    assert M.remove_source(u, "primary").count() == 1
    assert {r._sample_weight for r in M.set_weight(u, "sold/x.csv", 5.0).where("id = 2").collect()} == {5.0}
    assert M.toggle(M.toggle([], "a"), "a") == []


def test_listing_fields(spark):
    from valuelens.sources.pages import listing_fields

    html = "<h2 class=x itemprop='address'> 12 Oak St , Kitsilano, Vancouver </h2><p>Floor Area: 1,850 sqft</p><td>Property taxes: $4,100 (2024)</td>"
    pages = spark.createDataFrame([(1, html), (2, "<h2 itemprop=\"address\">Main St</h2>Property Taxes: $900"), (3, "<p>nothing</p>"), (4, None)], "page_id long, html string")
    got = [tuple(r) for r in listing_fields(pages).orderBy("page_id").collect()]
    assert got == [
        (1, "12 Oak St", "Kitsilano", "Vancouver", 1850.0, "$4,100 (2024)", 2024),
        (2, "Main St", None, None, None, "$900", None),
        (3, None, None, None, None, None, None),
        (4, None, None, None, None, None, None),
    ]
