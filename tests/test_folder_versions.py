"""Watching a folder whose files are rewritten, added and removed."""

import os

from valuelens.session import scratch_dir
from valuelens.streaming import folder_versions as FV


def put(folder, name, text, when):
    os.makedirs(folder, exist_ok=True)
    with open(folder / name, "w") as f:
        f.write(text)
    os.utime(folder / name, (when, when))


def state(spark, root):
    return sorted((r._source, r.price, getattr(r, "city", None)) for r in FV.current(spark, root, ref_year=2025).collect())


def test_rewritten_and_removed_files(spark, tmp_path):
    folder, root = tmp_path / "ads", scratch_dir(spark, "watch")
    FV.watch_once(spark, str(folder), root)  # no folder yet
    put(folder, "a.csv", "price,city\n1,Rome\n2,\"Pa\nris\"\n", 1000)
    put(folder, "b c+d.csv", "city;price\nOslo;5\n", 1000)
    FV.watch_once(spark, str(folder), root)
    first = [("listings/a.csv", 1.0, "Rome"), ("listings/a.csv", 2.0, "Pa\nris"), ("listings/b c+d.csv", 5.0, "Oslo")]
    assert state(spark, root) == first
    FV.watch_once(spark, str(folder), root)  # nothing new
    assert state(spark, root) == first
    put(folder, "a.csv", "price,city\n7,Bern\n", 2000)  # rewritten under its name
    put(folder, "e.csv", "price\n9\n", 2000)
    FV.watch_once(spark, str(folder), root)
    second = [("listings/a.csv", 7.0, "Bern"), ("listings/b c+d.csv", 5.0, "Oslo"), ("listings/e.csv", 9.0, None)]
    assert state(spark, root) == second
    put(folder, "a.csv", "price,city\n8,Bern\n", 2000)  # same time and size: only what the listing shows can be seen
    os.remove(folder / "e.csv")
    FV.watch_once(spark, str(folder), root)
    assert state(spark, root) == second[:2]
    put(folder, "a.csv", "price,city\n8,Bern\n", 3000)
    FV.watch_once(spark, str(folder), root)
    assert state(spark, root) == [("listings/a.csv", 8.0, "Bern"), second[1]]


def test_a_retried_batch_counts_once(spark, tmp_path):
    folder, root = tmp_path / "ads", scratch_dir(spark, "watch")
    put(folder, "a.csv", "price,city\n1,Rome\n", 1000)
    assert FV.announce(spark, str(folder), root) == 1 and FV.announce(spark, str(folder), root) == 0
    batch = spark.read.schema(FV.VERSION + ", seen timestamp").json(f"{root}/versions")
    for _ in range(2):
        FV.process(batch, 0, root)
        assert state(spark, root) == [("listings/a.csv", 1.0, "Rome")]
