"""Filter audit against brute force over all orders, and its tries against dictionaries."""

import re
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from valuelens.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, mask int, part string, n long"


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        t = t or ""
        if i is not None:
            least[t] = min(i, least.get(t, i))
    fails = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "".join(c for c, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and i > least[t])) if bad)
        fails.append((lang or "", f, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {x[0] for x in fails}:
        own = [x for x in fails if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, c in enumerate(order):
                gone = [x for x in left if c in x[1]]
                earlier = [x for x in own if x not in left and c in x[1]]
                before = sum(1 for x in own if c in x[1]) - len(gone)
                assert before >= 0 or earlier
                left = [x for x in left if c not in x[1]]
                out[part, order, k + 1] = (len(left), len(gone), before, sum(x[1] == c for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone))
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
    return sorted((*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items())


def corpus(seed=2, n=160):
    r = np.random.default_rng(seed)
    head = "Shared header " * 40
    texts = [" ".join(f"w{k}" for k in r.integers(0, 400, int(r.integers(1, 260)))) for _ in range(30)]
    texts += [head + t for t in texts[:12]] + ["", "A" * 30, "é" * 20 + "AB", "a # b", texts[0] + " ", texts[0][:-1], "long " * 30_000]
    rows = [(int(i), texts[int(r.integers(len(texts)))], [None, "", "de", "fr"][int(r.integers(4))]) for i in r.permutation(n)]
    rows += [(1000 + k, texts[3], "hot") for k in range(80)] + [(None, texts[3], "hot"), (None, None, "de"), (None, "", None), (3, texts[3], "de"), (3, texts[3], "de"), (2000, None, "fr")]
    labels = [(int(i), int(r.integers(2)), int(r.integers(2))) for i in range(0, n, 2)] + [(1003, 1, 1), (1003, 0, None), (None, 1, 1), (2000, None, 1), (7777, 1, 1)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, 1, "p", 2) for i, t, lang in rows], SCHEMA)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("parts", "few", "block"), [(1, 10**6, 8 << 20), (7, 0, 2_000)])
def test_audit(spark, monkeypatch, parts, few, block):
    monkeypatch.setattr(filter_audit, "MAX_BROADCAST_LABELS", few)
    monkeypatch.setattr(filter_audit, "BLOCK_BYTES", block)
    rows, labels = corpus()
    docs, known = frames(spark, rows, labels)
    got = filter_audit.audit(docs.repartition(parts), known).collect()
    assert sorted(map(tuple, got)) == brute(rows, labels)


def test_empty(spark):
    docs, labels = frames(spark, [], [])
    assert filter_audit.audit(docs, labels).collect() == []
    docs, labels = frames(spark, [(None, None, None)], [])
    assert len(filter_audit.audit(docs, labels).collect()) == 600


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=12)))
def test_trie_holds_all_texts(texts):
    trie = filter_audit.Trie()
    for k, t in enumerate(texts):
        filter_audit.add(trie.insert(t).held, ("p",), 1, k, 1)
    found = {t: node.held["p",] for t, node in trie.terminals()}
    assert found == {t: [texts.count(t), texts.index(t), 1] for t in texts}
    assert len(list(trie.held())) == len(set(texts))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6), st.integers(1, 9)), max_size=40), st.integers(1, 8))
def test_separators_split_texts(heads, ranges):
    heads = list(dict(heads).items())
    found = filter_audit.separators(heads, ranges)
    assert found == sorted(set(found)) and len(found) <= ranges
    if ranges > 1 and len(heads) > 3 * ranges:
        assert found


def test_shared_header_is_cut_behind_it(spark):
    head = "x" * 600
    rows = [(f"{head}{k:05d} text",) for k in range(400)]
    found = filter_audit.ranges_of(spark.createDataFrame(rows, "text string"))
    assert len(found) > 4 and all(s.startswith(head.encode()) for s in found)
