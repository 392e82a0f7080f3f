"""The near-duplicate stage against brute force of its own rule: five-word shingles, 4/5 and more."""

import numpy as np
import pytest

from valuelens.llm import partenum, stages


def components_brute(rows, shingle, least):
    """Smallest id of the linked documents of each row (ids are distinct and not null)."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set())
    name = [i for i, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and n >= least * (len(sets[a]) + len(sets[b]) - n) - 1e-9 and name[a] != name[b]:
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = [new if x == old else x for x in name]
    return name


def near_rows():
    r = np.random.default_rng(11)
    vocab = [f"w{k}" for k in range(5000)]
    rows = []
    for n in (7, 12, 40, 200):
        for k in (1, 2, 5, 9, 13, 17, 18, 25):
            w = r.choice(vocab, n).tolist()
            rows.append((len(rows), " ".join(w)))
            at = int(r.integers(0, max(1, n - k)))
            rows.append((len(rows), " ".join(w[:at] + [f"new{x}" for x in range(k)] + w[at + k :])))
    return [*rows, (900, None), (901, ""), (902, "one two three four"), (903, "One two three four"), (904, "one two three")]


def test_stage_links_five_word_shingles_from_four_fifths(spark):
    rows = near_rows()
    want = set(components_brute(rows, 5, 0.8))
    assert want != set(components_brute(rows, 3, 0.9))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x["doc_id"] for x in stages.near_duplicates(spark, docs, "").collect()}
    assert got == want


def test_signatures_lose_no_link_at_four_fifths():
    r = np.random.default_rng(2)
    rule = partenum.Rule(5, 4, 5)
    tried = 0
    for _ in range(1500):
        n = int(r.integers(4, 260))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        k = int(r.integers(1, n // 4 + 2))
        b = np.unique(np.concatenate([a[r.permutation(len(a))[k // 2 :]], r.integers(0, 2**63, k - k // 2, dtype=np.uint64)]))
        if partenum.linked(a, b, rule) and not np.array_equal(a, b):
            sig, who = partenum.signatures([a, b], rule)
            assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())
            tried += 1
    assert tried > 500


def test_sets_without_a_common_element_share_no_signature():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 2**63, 120, dtype=np.uint64)) for _ in range(300)]
    sig, who = partenum.signatures(sets, partenum.Rule(5, 4, 5))
    pairs = np.unique(np.stack([sig, who.astype(np.uint64)], 1), axis=0)
    assert len(np.unique(pairs[:, 0])) == len(pairs)


@pytest.mark.parametrize(("rule", "most"), [(partenum.Rule(5, 4, 5), 1.5), (partenum.OP5, 1.5)])
def test_rows_of_signatures_follow_the_shingles(rule, most):
    """Signature rows per shingle are as many for long documents as for short ones."""
    r = np.random.default_rng(4)
    per = {}
    for n in (200, 2_000, 20_000):
        sets = [np.unique(r.integers(0, 2**63, n + int(k), dtype=np.uint64)) for k in r.integers(0, n // 3, 60 if n < 20_000 else 12)]
        per[n] = len(partenum.signatures(sets, rule)[0]) / sum(map(len, sets))
    assert max(per.values()) <= most * per[200] and per[200] < 1.5


def test_long_sets_lose_no_link():
    r = np.random.default_rng(6)
    for rule in (partenum.Rule(5, 4, 5), partenum.OP5):
        for n in (1_500, 6_000, 20_000):
            a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
            most = n * (rule.den - rule.num) // (rule.den + rule.num)
            b = np.unique(np.concatenate([a[r.permutation(n)[most:]], r.integers(0, 2**63, most, dtype=np.uint64)]))
            assert partenum.linked(a, b, rule)
            sig, who = partenum.signatures([a, b], rule)
            assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())
