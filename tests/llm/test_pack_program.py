"""The configuration program: its fractions, its bound, and packings close to it."""

import numpy as np
import pytest

from valuelens.llm import pack


def histogram(lengths):
    return {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}


def shapes():
    r = np.random.default_rng(1)
    normal = lambda m, s, n: np.minimum(np.maximum(1, r.lognormal(m, s, n).astype(int)), 2047)
    return {
        "uniform": r.integers(1, 2048, 50_000),
        "log-normal": normal(6.0, 1.0, 300_000),
        "short log-normal": normal(5.5, 1.2, 50_000),
        "few log-normal": normal(6.0, 1.0, 10_000),
        "middle": r.integers(300, 900, 50_000),
        "half": r.integers(650, 1100, 50_000),
        "with full ones": np.concatenate([r.integers(1, 2049, 500), np.full(40, 2048)]),
    }


SHAPES = shapes()


@pytest.mark.parametrize("name", SHAPES)
def test_never_more_than_best_fit_and_near_the_bound(name):
    want = histogram(SHAPES[name])
    patterns = pack.solve(want)
    got = {}
    for copies, pattern in patterns:
        assert copies > 0 and sum(k * m for k, m in pattern) <= pack.CAPACITY
        for k, m in pattern:
            got[k] = got.get(k, 0) + copies * m
    assert got == want
    n = sum(c for c, _ in patterns)
    p = pack.program(want)
    assert p.bound <= n + 1e-6
    alone = sum(c for c, _ in pack.best_fit(want))
    assert n <= alone
    if alone <= 1.005 * p.bound + 1:
        assert n <= 1.005 * p.bound + 1


@pytest.mark.parametrize(("name", "least"), [("log-normal", 0.75), ("few log-normal", 0.9), ("middle", 0.99), ("uniform", 0.8)])
def test_fractions_cover_what_they_say(name, least):
    want = histogram(SHAPES[name])
    p = pack.program(want)
    cover = np.zeros(len(p.lengths))
    for amount, some, times in p.shares:
        assert amount > 0 and pack.CAPACITY - pack.SPARE <= (p.lengths[some] * times).sum() <= pack.CAPACITY
        cover[some] += amount * times / p.demand[some]
    assert np.allclose(cover, p.cover) and cover.max() <= 1 + 1e-9
    assert (cover * p.demand).sum() >= least * p.demand.sum()
    # rounding keeps the sum of the shares, as far as pieces last
    for scale in (1.0, 0.5):
        placed, rest = pack.rounded(p, scale)
        whole, fractions = sum(n for n, _ in placed), scale * sum(a for a, _, _ in p.shares)
        assert whole <= fractions + 1 and whole >= 0.8 * fractions
        for copies, pattern in placed:
            for k, m in pattern:
                rest[k] = rest.get(k, 0) + copies * m
        assert rest == {k: n for k, n in want.items() if k < pack.CAPACITY}


def test_program_of_few_lengths():
    assert pack.solve({}) == [] and pack.program({}).shares == []
    assert sum(n for n, _ in pack.solve({100: 1000})) == 50
    assert sum(n for n, _ in pack.solve({1200: 10, 1100: 7, 900: 3, 2048: 2})) == 19
    assert pack.bound({1000: 4}) == 2.0
    assert sum(n for n, _ in pack.solve({2048: 3})) == 3


def test_bound_is_below_the_best_packing():
    """Small instances against all packings."""
    from functools import lru_cache

    r = np.random.default_rng(3)
    for _ in range(30):
        sizes = tuple(sorted(r.integers(2, 11, 7).tolist(), reverse=True))

        @lru_cache(maxsize=None)
        def fewest(rest, room=0):
            if not rest:
                return 0
            tries = [1 + fewest(rest[1:], 10 - rest[0])]
            for i, s in enumerate(rest):
                if s <= room:
                    tries.append(fewest(rest[:i] + rest[i + 1 :], room - s))
            return min(tries)

        best = fewest(sizes)
        want = histogram(np.array(sizes))
        n = sum(c for c, _ in pack.solve(want, 10))
        assert pack.program(want, 10).bound <= best + 1e-9 <= n + 1e-9
        assert n <= best + 1
