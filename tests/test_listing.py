"""Joins that build the listings."""

from conftest import SMOKE
from pyspark.sql import functions as F

from valuelens.plans import listing


def _joins(df) -> tuple[int, int]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[-1]
    return plan.count("SortMergeJoin"), plan.count("BroadcastHashJoin")


def test_tables_above_the_bound_are_not_broadcast(spark, monkeypatch):
    """A compressed file says little about the rows a broadcast would put into the driver."""
    digest = lambda d: sorted(tuple(map(str, r)) for r in d.groupBy().agg(F.count("*"), F.sum(F.xxhash64(*d.columns) % 1000003)).collect())
    small = listing.listing_view(spark, SMOKE)
    assert _joins(listing.lineitem_part(spark, SMOKE)) == (0, 1)
    rows = digest(small)
    monkeypatch.setattr(listing, "BROADCAST_ROWS", 10)
    assert _joins(listing.lineitem_part(spark, SMOKE)) == (1, 0)
    large = listing.listing_view(spark, SMOKE)
    assert _joins(large) == (3, 1)  # only nation
    assert digest(large) == rows
