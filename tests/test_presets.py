"""The registered tree queries run the presets uncut."""

import pytest

from valuelens.operators import search as SR
from valuelens.operators import selection as SL
from valuelens.plans import q_search, q_selection, q_train


class Reached(Exception):
    pass


def stop(seen):
    def run(*args, **kw):
        seen.append((args, kw))
        raise Reached

    return run


CUTS = {"trees", "max_depth", "cv_folds", "k", "stages"}


@pytest.mark.parametrize("name", ["forest_fit", "gbt_fit", "stacking_fit", "forest_spread"])
def test_fits_take_the_preset(monkeypatch, name):
    seen = []
    monkeypatch.setattr(q_train, "_train", stop(seen))
    with pytest.raises(Reached):
        getattr(q_train, f"q_{name}")(None, "")
    assert not CUTS & set(seen[0][1])


def test_smart_select_takes_the_preset(spark, monkeypatch):
    from conftest import SMOKE

    seen = []
    monkeypatch.setattr(SL, "smart_select", stop(seen))
    with pytest.raises(Reached):
        q_selection.q_smart_select(spark, SMOKE)
    assert not CUTS & set(seen[0][1])


def test_halving_takes_all_subsets_and_the_default_stages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(q_search, "_search_input", lambda *a: None)
    monkeypatch.setattr(SR, "halving_search", stop(seen))
    with pytest.raises(Reached):
        q_search.q_halving_search(spark, "")
    args, kw = seen[0]
    assert not CUTS & set(kw) and args[2] == q_search.SEARCH
    assert args[3].count() == 2 ** len(q_search.SEARCH) - 1
