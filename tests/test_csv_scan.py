"""CSV by byte ranges against the one-task reader, and folders of files with unlike headers."""

import os

import numpy as np
import pytest

from valuelens.sources import csv_scan as CS
from valuelens.sources import folders as FO
from valuelens.sources.csv import read_csv


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def quoted(v):
    return '"' + v.replace('"', '""') + '"'


def rows(n, seed=1):
    r = np.random.default_rng(seed)
    cells = ["plain", "", "with, comma", 'a "quoted" word', "two\nlines", "three\n\n\"lines\"\nof, it", "é€", "x" * 300, "\n" * 40, "end\r\nof line"]
    return [[str(i), cells[int(r.integers(len(cells)))], cells[int(r.integers(len(cells)))]] for i in range(n)]


def one_task(spark, path, sep=","):
    return spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).option("lineSep", "\n").csv(path)


def test_ranges_equal_the_one_task_reader(spark, tmp_path, small_ranges):
    data = rows(400)
    path = str(tmp_path / "a.csv")
    with open(path, "w", newline="") as f:
        f.write("id,first,second\n" + "".join(f"{i},{quoted(a) if a else ''},{quoted(b)}\n" for i, a, b in data))
    infos = CS.scan(spark, path)
    assert len(infos) == 1 and infos[0].open_ranges and infos[0].sep == "," and infos[0].encoding == "utf-8"
    tables, problems = CS.read_files(spark, path)
    assert problems == [] and tables[0].names == ["id", "first", "second"]
    got = tables[0].rows.orderBy("_range", "_place").collect()
    want = one_task(spark, path).collect()
    assert [tuple(r)[:3] for r in got] == [tuple(r) for r in want]
    assert [(r.id, r.first or "", r.second or "") for r in got] == [tuple(x) for x in data]
    assert tables[0].rows.rdd.getNumPartitions() > 10 and CS._lines(spark, path).select("range_start").distinct().count() > 10
    # an open quote: the rest is one record, as for the other reader
    with open(path, "a") as f:
        f.write('400,"never closed\n401,x,y\n')
    last = read_csv(spark, path)[0].where("id = '400'").collect()
    assert len(last) == 1 and last[0]["first"].startswith("never closed")


@pytest.mark.parametrize(("encoding", "sep", "want"), [("utf-8", ";", "utf-8"), ("utf-8-sig", "\t", "utf-8"), ("cp1251", "|", "cp1251"), ("latin-1", ",", "latin-1")])
def test_encodings(spark, tmp_path, encoding, sep, want, small_ranges):
    text = {"cp1251": "Ванкувер", "latin-1": "caf\xe9 \x98"}.get(encoding, "é Ванкувер")
    path = str(tmp_path / "b.csv")
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(sep.join(["id", "name"]) + "\r\n" + "".join(sep.join([str(i), quoted(text + "\n" + "y" * 60)]) + "\r\n" for i in range(50)))
    df, enc = read_csv(spark, path)
    assert enc == want and df.columns == ["id", "name"]
    assert {r.name for r in df.collect()} == {text + "\n" + "y" * 60} and df.count() == 50


def test_headers(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    with open(path, "w") as f:
        f.write("a,,a,b\n1,2,3,4\n5,6\n\n7,8,9,10,11\n")
    tables, problems = CS.read_files(spark, path, strict=False)
    assert tables[0].names == one_task(spark, path).columns == ["a0", "_c1", "a2", "b"]
    assert [tuple(r)[:4] for r in tables[0].rows.orderBy("_range", "_place").collect()] == [("1", "2", "3", "4"), ("5", "6", None, None), ("7", "8", "9", "10")]
    assert CS.read_files(spark, path)[0] == [] and "5 fields" in CS.read_files(spark, path)[1][0][1]
    with pytest.raises(ValueError):
        open(path, "w").close()
        read_csv(spark, path)


def test_folders_of_unlike_files(spark, tmp_path):
    os.makedirs(tmp_path / "ads")
    os.makedirs(tmp_path / "sold")
    files = {
        "ads/one.csv": "price,city,floor_area_sqft\n100,Rome,1000 sqft\n200,\"Paris, France\",900\n",
        "ads/two a+b.csv": "city;price\nOslo;5\n",
        "ads/ragged.csv": "a,b\n1,2,3\n",
        "ads/empty.csv": "",
        "ads/notes.txt": "price\n1\n",
        "sold/three.csv": "price,city,floor_area_sqft\n300,Bern,800\n",
    }
    for name, text in files.items():
        with open(tmp_path / name, "w") as f:
            f.write(text)
    table, problems = FO.load_folders(spark, str(tmp_path), 2025)
    got = sorted((r.city, float(r.price), r.floor_area_sqft, r._source, r._file_type, r._sample_weight) for r in table.collect())
    assert got == [
        ("Bern", 300.0, 800.0, "sold/three.csv", "sold", 3.0),
        ("Oslo", 5.0, None, "listings/two a+b.csv", "listings", 1.0),
        ("Paris, France", 200.0, 900.0, "listings/one.csv", "listings", 1.0),
        ("Rome", 100.0, 1000.0, "listings/one.csv", "listings", 1.0),
    ]
    assert sorted(r.source for r in problems.collect()) == ["listings/empty.csv", "listings/ragged.csv"]
    nothing, none = FO.load_folders(spark, str(tmp_path / "missing"))
    assert nothing is None and none.count() == 0
