"""Aliases that last: old ones stay, new ones follow, writers at one version do not overwrite each other."""

import json

from valuelens.operators import alias_store as AS
from valuelens.session import scratch_dir


def frame(spark, rows):
    return spark.createDataFrame(rows, "street string, city string, other_city string, n int")


def table(spark, root):
    return {(r.kind, r.value): r.alias for r in AS.aliases(spark, root).collect()}


def test_old_aliases_stay_and_new_ones_follow(spark):
    root = scratch_dir(spark, "aliases")
    first = frame(spark, [("Oak St", "Rome", "x", 1), ("Main St", "Bern", "x", 2), (None, "", "x", 3), ("nan", "HIDDEN", "x", 4)])
    masked = sorted(map(tuple, AS.mask_lasting(first, root).collect()), key=str)
    assert masked == sorted([("Address #2", "City 2", "x", 1), ("Address #1", "City 1", "x", 2), (None, "", "x", 3), ("nan", "HIDDEN", "x", 4)], key=str)
    before = table(spark, root)
    assert before == {("address", "Main St"): "Address #1", ("address", "Oak St"): "Address #2", ("city", "Bern"): "City 1", ("city", "Rome"): "City 2"}
    second = frame(spark, [("Aaa St", "Aachen", "x", 1), ("Oak St", "Rome", "x", 2)] + [(f"B{k:03d}", "Rome", "x", k) for k in range(50)])
    AS.mask_lasting(second, root).collect()
    after = table(spark, root)
    assert before.items() <= after.items() and after["address", "Aaa St"] == "Address #3" and after["city", "Aachen"] == "City 3"
    assert len(set(after.values())) == len(after) == 4 + 52
    AS.extend(first, root)  # nothing new: no version
    assert len(AS._versions(spark, root)) == 2 and table(spark, root) == after
    assert AS.mask_lasting(first, root, enabled=False).collect() == first.collect()
    assert AS.private_values(first, ["n"]).count() == 0


def test_writers_of_one_version_do_not_overwrite(spark, monkeypatch):
    root = scratch_dir(spark, "aliases")
    mine = frame(spark, [("a", "x", "", 1), ("b", "x", "", 1)])
    theirs = frame(spark, [("b", "y", "", 1), ("c", "y", "", 1)])
    real, calls = AS._claim, []

    def claim(s, path, text):
        if not calls:  # another writer commits first
            calls.append(path)
            AS.extend(theirs, root)
        return real(s, path, text)

    monkeypatch.setattr(AS, "_claim", claim)
    AS.extend(mine, root)
    got = table(spark, root)
    assert got == {("address", "b"): "Address #1", ("address", "c"): "Address #2", ("city", "y"): "City 1", ("address", "a"): "Address #3", ("city", "x"): "City 2"}
    assert [v["version"] for v in AS._versions(spark, root)] == [1, 2]
    assert not real(spark, f"{root}/versions/{1:012d}.json", json.dumps({}))
