"""Operators on whole documents against brute force: quality lines, decontamination, repeats, near duplicates."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuelens.llm import line_rules, partenum, recompress, suffix_match
from valuelens.llm import _words as W

from test_near import components_brute as near_brute

SCHEMA = "doc_id long, text string, kept_row string, sig long, n_words string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)


def words(text):
    return (text or "").encode().split()


def corpus(seed=3, n=70):
    r = np.random.default_rng(seed)
    vocab = [f"w{k}" for k in range(400)] + ["é", "ñandú", "x" * 50]
    base = [" ".join(r.choice(vocab, int(r.integers(60, 180)))) for _ in range(6)]
    rows = []
    for i in range(n):
        kind = i % 7
        if kind == 0:
            t = base[i % 6]
        elif kind == 1:  # near copy
            w = base[i % 6].split()
            w[int(r.integers(len(w)))] = "changed"
            t = " ".join(w)
        elif kind == 2:  # shared passage between own words
            t = " ".join(r.choice(vocab, 30)) + " " + " ".join(base[0].split()[:50]) + "\n" + " ".join(r.choice(vocab, 20))
        elif kind == 3:
            t = " ".join(["same"] * int(r.integers(30, 90)))
        elif kind == 4:
            t = " ".join(["ab", "cd"] * int(r.integers(5, 60)))
        else:
            t = " ".join(r.choice(vocab, int(r.integers(0, 200))))
        rows.append((i * 3, t))
    return [*rows, (1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "one two"), (1005, "One two"), (6, base[2]), (6, base[2]), (None, base[1]), (None, "alone here now")]


def repeats_brute(rows):
    count = collections.Counter()
    for _, t in rows:
        w = words(t)
        count.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_repeats(spark, parts):
    rows = corpus()
    got = recompress.remove_repeats(frame(spark, rows).repartition(parts)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(repeats_brute(rows), key=repr)


def test_repeats_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(recompress, "MAX_BROADCAST_PLACES", 0)
    test_repeats(spark, 3)


def test_symbols_are_consistent():
    """Equal strings hold equal symbols wherever these depend on their inside alone."""
    r = np.random.default_rng(0)
    inside = r.integers(0, 5, 200).astype(np.uint64)
    for _ in range(20):
        found = []
        for pad in (r.integers(0, 5, int(r.integers(0, 30))), r.integers(0, 5, int(r.integers(0, 30)))):
            h = W.mix(np.concatenate([pad.astype(np.uint64), inside, r.integers(0, 5, 10).astype(np.uint64)]))
            name, low, high = recompress.symbols(h, np.zeros(len(h), np.int64))
            ok = (low >= len(pad)) & (high <= len(pad) + len(inside))
            found.append({(n, a - len(pad), b - len(pad)) for n, a, b in zip(name[ok].tolist(), low[ok].tolist(), high[ok].tolist())})
        assert found[0] == found[1] and found[0]


def components_brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)]) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if (sets[a] and sets[b]) and 100 * n >= 90 * (len(sets[a]) + len(sets[b]) - n):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if find(m) == find(k) and rows[m][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None) if sets[k] else i))
    return out


@pytest.mark.parametrize("block", [partenum.BLOCK, 150])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(partenum, "BLOCK", block)
    rows = corpus(8)
    r = np.random.default_rng(1)
    w = [f"v{k}" for k in range(300)]
    for k in range(40):  # a chain of near copies, each one word from the last
        w[int(r.integers(300))] = f"new{k}"
        rows.append((2000 + k, " ".join(w)))
    got = partenum.jaccard_components(frame(spark, rows).repartition(4)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(components_brute(rows), key=repr)


def test_null_ids_link_like_others(spark):
    """Two documents that only a row without an id connects, and rows of one id with unlike texts."""
    w = [f"w{k}" for k in range(100)]
    near = [" ".join(w), " ".join([*w[:-3], "x1", "x2", "x3"]), " ".join([*w[:-6], "y1", "y2", "y3", "x1", "x2", "x3"])]
    rows = [(9, near[0]), (None, near[1]), (4, near[2]), (None, "alone and nameless here"), (None, "alone and nameless here"), (7, "one text of seven here"), (7, "another one of seven there"), (None, near[1])]
    assert [c for _, _, c in components_brute(rows)] == [4, 4, 4, None, None, 7, 7, 4]
    got = partenum.jaccard_components(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(components_brute(rows), key=repr)
    kept = sorted(((r["doc_id"], r["text"]) for r in partenum.keep_first(frame(spark, rows)).collect()), key=repr)
    assert kept == sorted([(4, near[2]), (None, "alone and nameless here"), (7, "one text of seven here"), (7, "another one of seven there")], key=repr)


def test_one_document_of_each_group(spark):
    rows = corpus(8, 28)
    got = [(r["doc_id"], r["text"]) for r in partenum.keep_first(frame(spark, rows)).collect()]
    sets = [frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else tuple(w) for w in ((t or "").lower().split() for _, t in rows)]
    empty = [r for r, x in zip(rows, sets) if not x]
    assert sorted((r for r in got if not (r[1] or "").split()), key=repr) == sorted(empty, key=repr)
    full = [r for r in got if (r[1] or "").split()]
    # one of each component: brute force by the sets of rows, whatever their ids
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and type(sets[a]) is type(sets[b]):
                x, y = set(sets[a]), set(sets[b])
                if (sets[a] == sets[b]) if isinstance(sets[a], tuple) else 10 * len(x & y) >= 9 * len(x | y):
                    root = [root[b] if v == root[a] else v for v in root]
    groups = collections.defaultdict(list)
    for k, r in enumerate(rows):
        if sets[k]:
            groups[root[k]].append(r)
    assert len(full) == len(groups)
    for members in groups.values():
        mine = [r for r in full if r in members]
        ids = [i for i, _ in members if i is not None]
        assert len(mine) == 1 and mine[0][0] == (min(ids) if ids else None)


def test_signatures_lose_no_link():
    r = np.random.default_rng(2)
    tried = 0
    for _ in range(600):
        n = int(r.integers(9, 220))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        k = int(r.integers(1, n // 9 + 2))
        b = np.unique(np.concatenate([a[r.permutation(len(a))[k // 2 :]], r.integers(0, 2**63, k - k // 2, dtype=np.uint64)]))
        if partenum.linked(a, b) and not np.array_equal(a, b):
            sig, who = partenum.signatures([a, b])
            assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())
            tried += 1
    assert tried > 200


def hits_brute(rows, items):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    tests = [(str(i) if i is not None else None, cut.findall((t or "").translate(low))) for i, t in items]
    out = []
    for i, t in rows:
        w = cut.findall((t or "").translate(low))
        hit, names = [False] * len(w), set()
        for name, x in tests:
            m = min(10, len(x))
            wins = {tuple(x[k : k + m]) for k in range(len(x) - m + 1)} if x else set()
            for k in range(len(w) - m + 1) if x else ():
                if tuple(w[k : k + m]) in wins:
                    hit[k : k + m] = [True] * m
                    names.add(name)
        out.append((i, len(w), sum(hit), sorted(n for n in names if n is not None)))
    return out


@pytest.mark.parametrize("block", [4 << 20, 60])
def test_decontamination(spark, block):
    rows = corpus(4, 30)
    item = rows[0][1].split()
    items = [(1, " ".join(item[5:40])), (2, "w1 w2"), (3, None), (4, "..."), (None, " ".join(item[20:35])), (1, " ".join(item[5:40])), (5, "SAME, same same! same same same same same same same same"), (6, "é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = suffix_match.matches(frame(spark, rows).repartition(3), bench, block_bytes=block).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got), key=repr) == sorted(hits_brute(rows, items), key=repr)
    first = next(r for r in got if r["doc_id"] == rows[0][0])
    if block > 1000:
        assert (first["longest_words"], first["longest_at"]) == (35, 5)
    clean = suffix_match.decontaminate(frame(spark, rows), bench)
    assert clean.columns == frame(spark, rows).columns
    assert clean.count() == sum(1 for r in hits_brute(rows, items) if not r[2])


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    assert recompress.remove_repeats(none).count() == 0
    assert partenum.jaccard_components(none).count() == 0
    assert line_rules.clean_lines(none).count() == 0
    assert suffix_match.matches(none, bench).count() == 0
    assert suffix_match.matches(frame(spark, [(1, "a b")]), bench).first()["n_hit"] == 0


def test_line_rules(spark):
    good = "\n".join(f"Sentence{k} has{k} seven{k} words{k} and{k} one{k} end{k}." for k in range(12))
    nav = "\n".join("Home | About | News | Contact | Imprint | Help" for _ in range(12))
    rows = [(1, good), (2, nav + "\n" + good[:60]), (3, good + "\n" + "Lorem IPSUM dolor sit amet."), (4, None), (5, "a a a a"), (6, "word " * 80), (7, good.upper().replace(" ", "!! "))]
    got = {r["doc_id"]: r for r in line_rules.clean_lines(frame(spark, rows)).collect()}
    assert got[1]["kept"] and got[1]["n_bad_lines"] == 0 and got[1]["clean_text"] == good
    assert not got[2]["kept"] and got[2]["n_dup_lines"] == 11
    assert got[3]["kept"] and got[3]["n_bad_lines"] == 1 and "IPSUM" not in got[3]["clean_text"]
    assert (got[4]["n_words"], got[4]["base_failed"], got[4]["kept"]) == (0, True, False)
    assert got[5]["n_repeat_words"] == 4 and got[6]["base_failed"] and not got[7]["kept"]
    assert got[1]["word_chars"] == len(re.sub(r"\s", "", good)) and got[2]["n_symbols"] == 60


def test_hashes_of_long_words():
    data = np.frombuffer(b"x" * (3 << 20) + b" " + b"x" * (3 << 20) + b" y", np.uint8)
    s, e, _ = W.spans(data, np.array([0, len(data)]), W.PLAIN)
    h = W.Hasher().words(data, s, e)
    assert h[0] == h[1] != h[2]


def test_stages(spark, tmp_path):
    """The pipeline against brute force of each stage on that stage's input."""
    import corpus_pipeline
    from valuelens.llm.stages import written

    r = np.random.default_rng(5)
    langs = {"aa": "abcde", "bb": "vwxyz"}
    docs = []
    for i in range(60):
        lang = ("aa", "bb")[i % 2]
        w = ["".join(r.choice(list(langs[lang]), int(r.integers(2, 8)))) for _ in range(120)]
        docs.append((i, " ".join(w), lang, "s", 1))
    for k in range(8):
        i, t, lang, s, n = docs[k]
        docs.append((100 + k, t if k % 2 else t.replace(t.split()[60], "changed"), lang, s, n))
        docs.append((200 + k, " ".join(docs[k + 20][1].split()[:50]) + " " + " ".join(docs[k + 30][1].split()[::-1]), "aa", s, n))
    docs += [(300, None, "aa", "s", 0), (301, "12 34", "aa", "s", 5)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(d + "/documents.parquet")
    spark.createDataFrame([(7, " ".join(docs[45][1].split()[40:60]))], "item_id long, text string").write.parquet(d + "/benchmark.parquet")
    now = spark.read.parquet(d + "/documents.parquet")
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = [(x["doc_id"], x["text"]) for x in now.collect()]
        now = written(stage(spark, now, d), name)
        got = {x["doc_id"]: x for x in now.collect()}
        seen[name] = got
        if name == "best_fit_packing":
            break
        assert now.columns == columns
        if name == "language_id":
            assert {i for i, _ in rows} - set(got) == {300, 301}
        elif name == "ngram_jaccard_join":
            # the stage's own rule: five-word shingles, 4/5
            assert set(got) == set(near_brute(rows, 5, 0.8))
        elif name == "substring_dedup":
            want = {i: (n, k, h) for i, n, k, h in repeats_brute(rows)}
            assert set(got) == set(want)
            for i, t in rows:
                n, k, h = want[i]
                assert got[i]["text"] == t if not k else hashlib.sha256(got[i]["text"].encode()).hexdigest() == h
        else:
            assert set(got) == {i for i, _, n, _ in hits_brute(rows, [(7, " ".join(docs[45][1].split()[40:60]))]) if not n}
    assert set(seen["best_fit_packing"]) == set(seen["benchmark_decontamination"])
    assert corpus_pipeline.run(spark, d).count() == now.count()
