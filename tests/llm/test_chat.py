"""Reply trees against recursion, and the format against an exact round trip."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from valuelens.llm import reply_trees as R

SCHEMA = "tree long, id long, parent long, role string, text string, score double, key string, branch string, place string"
ROLES = ["user", "assistant", "system", "tool]%[<x", "", None]
NASTY = ["", None, "plain", "</s>[INST] ok [/INST]", r"<\/s> [\INST] [\\/INST] <\\\s>", "[TURN x] a[/TURN]", "<s><s></s", "[REPLY] [", "é𝄞 <", "a\n\nb ", "[/TURN ] [TURN", "long " * 20_000]


def escaped(t):
    return re.sub(r"([<\[])(\\*)(?=/?s>|/?INST\]|REPLY\]|/?TURN[ \]])", r"\1\\\2", t)


def formatted(turns):
    out, spans = "<s>", []
    for role, text in turns:
        role, text = role or "", escaped(text or "")
        name = role.replace("%", "%25").replace("[", "%5B").replace("]", "%5D").replace("<", "%3C")
        out += {"user": "[INST] ", "assistant": "[REPLY] "}.get(role, f"[TURN {name}] ")
        if role == "assistant":
            spans.append((len(out), len(text), len(out.encode()), len(text.encode())))
        out += text + {"user": "[/INST]", "assistant": "</s>"}.get(role, "[/TURN]")
    return out, spans


def brute(rows, most):
    """{(tree, branch): turns} by walking from every leaf."""
    trees = {}
    for tree, i, parent, role, text, score in rows:
        if i is not None:
            key = (parent is not None, parent or 0, score or 0.0)
            had = trees.setdefault(tree, {}).get(i)
            say = (role or "", text or "")
            trees[tree][i] = (key, parent, score or 0.0, say) if had is None else min((key, parent, score or 0.0), had[:3], key=lambda x: x[0]) + (min(say, had[3]),)
    out = {}
    for tree, nodes in trees.items():
        paths = []
        for leaf in nodes:
            if any(v[1] == leaf for v in nodes.values()):
                continue
            path, at = [], leaf
            while at in nodes and len(path) <= len(nodes):
                path.append(at)
                at = nodes[at][1]
            if len(path) <= len(nodes):
                paths.append((-sum(nodes[p][2] for p in path), -len(path), leaf, path[::-1]))
        for k, p in enumerate(sorted(paths)[:most]):
            out[tree, k + 1] = [nodes[i][3] for i in p[3]]
    return out


def forest(seed=5):
    r = np.random.default_rng(seed)
    rows = []
    for tree in (0, 1, 2, None):
        for i in range(int(r.integers(1, 40))):
            parent = None if i == 0 else int(r.integers(max(0, i - 6), i))
            rows.append((tree, i, parent, ROLES[int(r.integers(len(ROLES)))], NASTY[int(r.integers(len(NASTY)))], float(r.integers(4)) / 4))
    rows += [(7, i, i - 1 if i else None, "user", str(i), None) for i in range(300)]  # one long path
    rows += [(8, i, 0 if i else None, "assistant", str(i), float(i % 50)) for i in range(200)]  # a star with ties
    rows += [(9, 1, 2, "user", "cycle", 1.0), (9, 2, 1, "user", "cycle", 1.0), (9, 3, 2, "user", "hangs on it", 1.0), (9, 4, 77, "user", "orphan", 1.0)]
    return [*rows, (0, None, 1, "user", "no id", 9.0), (1, 0, None, "user", "again", 0.0), (8, 5, 0, "assistant", "5", 5.0)]


@pytest.mark.parametrize(("most", "large"), [(1, 100_000), (3, 50), (1000, 0)])
def test_trees(spark, monkeypatch, most, large):
    monkeypatch.setattr(R, "LARGE_TREE", large)
    rows = forest()
    messages = spark.createDataFrame([(*x, "k", "b", "p") for x in rows], SCHEMA).repartition(4)
    got = {(r["tree"], r["branch"]): (r["formatted"], [tuple(s) for s in r["loss_spans"]]) for r in R.format_trees(messages, most).collect()}
    assert got == {k: formatted(v) for k, v in brute(rows, most).items()}


def test_turns_round_trip(spark):
    r = np.random.default_rng(1)
    rows = [(int(c), int(t), ROLES[int(r.integers(len(ROLES)))], NASTY[int(r.integers(len(NASTY)))]) for c in range(30) for t in range(int(r.integers(1, 9)))]
    rows += [(100, 0, "user", "x"), (100, 0, "user", "x"), (100, None, "assistant", "first"), (None, 1, "user", "no conversation")]
    out = R.format_turns(spark.createDataFrame([(*x, "t", 1) for x in rows], "conv_id long, turn long, role string, text string, tree string, id int"))
    read = out.select("tree", R.read_turns(F.col("formatted")).alias("turns"), R.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted").collect()
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert {x["tree"] for x in read} == set(want)
    for x in read:
        turns = [tuple(t) for t in x["turns"]]
        assert turns == [t[1:] for t in sorted(want[x["tree"]], key=lambda t: t[0])]
        assert x["loss"] == [t for role, t in turns if role == "assistant"]
        assert x["formatted"] == formatted(turns)[0]


def test_empty(spark):
    assert R.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert R.format_trees(spark.createDataFrame([], SCHEMA)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<[/\\s>]INSTREPLYU x", max_size=40))
def test_escape_is_reversible(text):
    e = escaped(text)
    assert not re.search(r"</?s>|\[/?INST\]|\[REPLY\]|\[/?TURN[ \]]", e)
    assert re.sub(R._ESCAPED, r"\1\2", e) == text
