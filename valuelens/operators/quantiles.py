"""Exact group quantiles that never hold an unbounded group in one task.

Semantics: linear interpolation between order statistics (the default of
numpy/pandas and of Spark's ``percentile`` / DuckDB's ``quantile_cont``):
``pos = p * (n - 1)``, ``q = v[floor(pos)] + frac(pos) * (v[ceil(pos)] - v[floor(pos)])``.

Strategy
--------
1. One aggregate pass counts the rows of every group (map-side combined).
2. If the largest group holds at most ``max_group_rows`` values, Spark's
   exact ``percentile`` aggregate is used: its per-group state is a value-count
   map, bounded by the group size that was just checked.
3. Otherwise (a hot group, or the whole table as one group) the order
   statistics are found by histogram narrowing.  Every value gets monotone
   bucket ids from its sign, binary exponent and leading mantissa bits
   (pure arithmetic, exact on doubles).  Level 1 counts rows per (group,
   12-bit bucket); a running sum over those bucket counts (at most a few
   thousand rows per group) locates the bucket holding each wanted rank.
   Level 2 repeats that inside the chosen buckets with 32 mantissa bits, and
   level 3 counts the distinct values inside the chosen 32-bit buckets (at
   most 2^20 distinct doubles fit in one).  Each level is a grouped count
   with map-side combine, so a hot group is spread over all tasks; the
   windows only ever see bounded histogram rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuelens.session import broadcast_limit_rows, cut

DEFAULT_MAX_GROUP_ROWS = 2_000_000  # exact-percentile state per group stays ~100 MB

_KEY = "_qk"  # constant key used when quantiles are taken over the whole frame


def _exponent(a: Column) -> Column:
    """floor(log2(a)) for a > 0, corrected so that 2^e <= a < 2^(e+1) exactly."""
    e0 = F.floor(F.log2(a))
    e1 = F.when(a < F.pow(F.lit(2.0), e0), e0 - 1).otherwise(e0)
    return F.when(a >= F.pow(F.lit(2.0), e1 + 1), e1 + 1).otherwise(e1)


def ordered_bucket(v: Column, bits: int) -> Column:
    """Monotone (non-decreasing in v) bucket id using ``bits`` mantissa bits."""
    a = F.abs(v)
    e = _exponent(a)
    mant = a / F.pow(F.lit(2.0), e) - 1.0  # in [0, 1), exact
    q = F.floor(mant * float(2**bits))
    pos = (e + 1075).cast("long") * F.lit(2**bits).cast("long") + q.cast("long") + 1
    return F.when(v > 0, pos).when(v < 0, -pos).otherwise(F.lit(0).cast("long"))


def with_buckets(df: DataFrame, v: str) -> DataFrame:
    """``df`` with monotone (non-decreasing in ``v``) bucket ids ``_b1`` (12 mantissa bits) and ``_b2`` (32): those of ``ordered_bucket``.

    Exponent and power of two are columns of their own: as parts of one expression they would be
    worked out again at each mention, which costs a hundred times as much.
    """
    a = F.abs(F.col(v))
    # floor(log2(a)); the logarithm may be off by one at powers of two, and infinity counts as the largest exponent
    d = df.withColumn("_ba", a).withColumn("_be", F.when(F.col("_ba") > 0, F.least(F.floor(F.log2("_ba")), F.lit(1023))).otherwise(F.lit(0)).cast("int"))
    d = d.withColumn("_bm", F.col("_ba") / F.pow(F.lit(2.0), F.col("_be")))  # exact, in (1/2, 4)
    off = F.when(F.col("_bm") < 1, -1).when(F.col("_bm") >= 2, 1).otherwise(0)
    d = d.withColumn("_bo", F.when(F.col("_ba") == float("inf"), F.lit(1)).otherwise(off))
    mant = F.when(F.col("_ba") == float("inf"), F.lit(0.0)).when(F.col("_bo") < 0, F.col("_bm") * 2).when(F.col("_bo") > 0, F.col("_bm") / 2).otherwise(F.col("_bm")) - 1.0
    d = d.withColumn("_bq", (F.col("_be") + F.col("_bo") + 1075).cast("long") * 2**32 + F.floor(mant * float(2**32)).cast("long"))
    # never null, and known to be so: a join's test for nulls would be pushed down and work the columns out once more
    sign = lambda c: F.coalesce(F.when(F.col(v) > 0, c + 1).when(F.col(v) < 0, -c - 1), F.lit(0).cast("long"))
    return d.withColumns({"_b1": sign(F.shiftright("_bq", 20)), "_b2": sign(F.col("_bq"))}).drop("_ba", "_be", "_bm", "_bo", "_bq")


def _rank_targets(stats: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """(keys, _r) for every 0-based order statistic the interpolation needs."""
    ranks = []
    for p in probs:
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        ranks.append(F.floor(pos).cast("long"))
        ranks.append(F.ceil(pos).cast("long"))
    return stats.select(*keys, F.explode(F.array_distinct(F.array(*ranks))).alias("_r"))


def _locate(hist: DataFrame, part: list[str], order: str, targets: DataFrame, join_keys: list[str], below: str) -> DataFrame:
    """For each target rank find the histogram row whose cumulative span holds it."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("_cum", F.sum("_c").over(w))
    j = targets.join(cum, on=join_keys, how="inner")
    rel = F.col("_r") - F.col(below)
    j = j.where((rel >= F.col("_cum") - F.col("_c")) & (rel < F.col("_cum")))
    return j.withColumn(below, F.col(below) + F.col("_cum") - F.col("_c")).drop("_cum", "_c")


def _semi(df: DataFrame, cand: DataFrame, on: list[str], bound: int) -> DataFrame:
    """Keep rows of ``df`` whose key is a candidate; ``bound`` (groups x ranks) proves the candidate
    table small enough to broadcast, otherwise the planner picks the join.

    An inner join of distinct candidates: a semi join would be pushed below the bucket's columns and work them out
    once more as one expression.
    """
    cand = cand.select(*[F.col(c).alias(f"_s_{c}") for c in on]).distinct()
    if bound <= broadcast_limit_rows(df.sparkSession):
        cand = F.broadcast(cand)
    return df.join(cand, [F.col(c) == F.col(f"_s_{c}") for c in on], "inner").drop(*[f"_s_{c}" for c in on])


def _narrowing(base: DataFrame, keys: list[str], v: str, stats: DataFrame, probs: Sequence[float], n_groups: int, rows: Column, keep: bool = True) -> DataFrame:
    """The wanted order statistics; ``rows`` counts a bucket's rows (or adds up their weights)."""
    bound = n_groups * 2 * len(probs)  # at most two order statistics per probability and group
    targets = _rank_targets(stats, keys, probs).withColumn("_below", F.lit(0).cast("long"))
    data = with_buckets(base.persist() if keep else base, v)  # (keys, value) projection, read three times

    # level 1: histogram of 12-bit buckets per group
    h1 = data.groupBy(*keys, "_b1").agg(rows.alias("_c"))
    t1 = cut(_locate(h1, keys, "_b1", targets, keys, "_below"), "located")  # small, and made now: a reader of its plan may not find it in the cache
    # level 2: inside chosen 12-bit buckets, 32-bit buckets
    d2 = _semi(data, t1, keys + ["_b1"], bound)
    h2 = d2.groupBy(*keys, "_b1", "_b2").agg(rows.alias("_c"))
    t2 = cut(_locate(h2, keys + ["_b1"], "_b2", t1, keys + ["_b1"], "_below"), "located")  # small, and made now: a reader of its plan may not find it in the cache
    # level 3: distinct values inside chosen 32-bit buckets (<= 2^20 per bucket)
    d3 = _semi(data, t2, keys + ["_b2"], bound)
    h3 = d3.groupBy(*keys, "_b2", v).agg(rows.alias("_c"))
    t3 = _locate(h3, keys + ["_b2"], v, t2.drop("_b1"), keys + ["_b2"], "_below")
    return t3.select(*keys, "_r", F.col(v).alias("_val"))


def _interpolate(stats: DataFrame, picked: DataFrame, keys: list[str], probs: Sequence[float], names: Sequence[str], extra: list[str]) -> DataFrame:
    m = picked.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_r", "_val"))).alias("_m"))
    out = stats.join(m, on=keys, how="left")
    cols = []
    for p, name in zip(probs, names):
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo = F.element_at("_m", F.floor(pos).cast("long"))
        hi = F.element_at("_m", F.ceil(pos).cast("long"))
        cols.append((lo + (pos - F.floor(pos)) * (hi - lo)).alias(name))
    return out.select(*keys, "_n", *extra, *cols)


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
    *,
    extra: dict[str, str] | None = None,
    max_group_rows: int = DEFAULT_MAX_GROUP_ROWS,
    weight: str | None = None,
    keep: bool = True,
) -> DataFrame:
    """Exact quantiles of ``value`` per group of ``keys`` (nulls ignored).

    Narrowing keeps its rows between the passes, unless ``keep`` says that ``df`` is cheap to read again.

    With ``weight`` a row counts as so many rows: the narrowing goes by cumulated weights, ``_n`` is their sum,
    and ``avg`` and ``sum`` of ``extra`` are weighted.  Rows without a positive weight do not count.  Weights that are not
    whole numbers are taken in thousandths.

    Returns ``keys + [_n] + extra + names`` with one row per group that has a
    value.  ``extra`` maps output names to aggregate function names (``avg``,
    ``min``, ``max``, ``sum``, ``stddev_pop``...) computed on the same values in
    the counting pass, so callers get their other statistics for free.
    """
    keys = list(keys)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    no_keys = not keys
    if no_keys:
        df = df.withColumn(_KEY, F.lit(0))
        keys = [_KEY]
    base = df.select(*keys, F.col(value).cast("double").alias("_v"), *([F.col(weight).cast("double").alias("_w")] if weight else []))
    base = base.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    extra = dict(extra or {})
    rows, frequency, unit = F.count(F.lit(1)), F.lit(1), 1
    if weight:
        base = base.where("_w > 0")
        if base.agg(F.max(F.col("_w") != F.floor("_w"))).first()[0]:
            unit = 1000
        base = base.withColumn("_w", F.round(F.col("_w") * unit).cast("long")).where("_w > 0")
        rows, frequency = F.sum("_w"), F.col("_w")
    weighted = {"sum": F.sum(F.col("_v") * frequency) / unit, "avg": F.sum(F.col("_v") * frequency) / F.sum(frequency)} if weight else {}
    aggs = [rows.alias("_n")] + [weighted.get(fn, getattr(F, fn)("_v")).alias(name) for name, fn in extra.items()]
    stats = base.groupBy(*keys).agg(*aggs).persist()
    info = stats.agg(F.max("_n").alias("m"), F.count(F.lit(1)).alias("g")).first()
    biggest, n_groups = info["m"] or 0, info["g"]
    if biggest <= max_group_rows:
        pct = base.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs]), frequency).alias("_p"))
        out = stats.join(pct, on=keys, how="inner").select(
            *keys, "_n", *extra, *[F.col("_p")[i].alias(n) for i, n in enumerate(names)]
        )
    else:
        stats = cut(stats, "counted")
        picked = _narrowing(base, keys, "_v", stats, probs, n_groups, rows, keep)
        out = _interpolate(stats, picked, keys, probs, names, list(extra))
    if unit > 1:
        out = out.withColumn("_n", F.col("_n") / unit)
    if no_keys:
        out = out.drop(_KEY)
    return out


def quantile_row(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str] | None = None, **kw) -> DataFrame:
    """Whole-frame quantiles as a one-row DataFrame (``_n`` + names)."""
    return group_quantiles(df, [], value, probs, names, **kw)


def fence_bounds(df: DataFrame, value: str, k: float = 3.0, **kw) -> DataFrame:
    """One row: q1, q3, lo = q1 - k*IQR, hi = q3 + k*IQR, _n."""
    q = quantile_row(df, value, [0.25, 0.75], ["_q1", "_q3"], **kw)
    iqr = F.col("_q3") - F.col("_q1")
    return q.select("_n", "_q1", "_q3", (F.col("_q1") - k * iqr).alias("_lo"), (F.col("_q3") + k * iqr).alias("_hi"))


def leave_fold_out_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    fold: str,
    k: int,
    value: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
) -> DataFrame:
    """Exact quantiles of ``value`` per (keys, held-out fold) over the rows of all OTHER folds.

    No row is replicated: every narrowing level counts rows per (keys, fold, bucket)
    once, and the leave-fold-out histogram of a held fold is the all-folds count
    minus its own count.  Only histogram-sized tables carry the held-fold dimension.
    Returns ``keys + [_held, _n] + names`` (``_n`` rows outside the held fold).
    """
    spark = df.sparkSession
    keys = list(keys)
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    if not keys:
        df = df.withColumn(_KEY, F.lit(0))
        keys = [_KEY]
    base = df.select(*keys, F.col(fold).cast("long").alias("_f"), F.col(value).cast("double").alias("_v"))
    base = base.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    data = with_buckets(base.persist(), "_v")
    folds = F.broadcast(spark.range(k).select(F.col("id").alias("_held")))  # k rows
    gk = keys + ["_held"]

    def leave_out(own: DataFrame, sel: DataFrame | None, hist: list[str]) -> DataFrame:
        """(gk..., hist..., _c) = all-folds count - own-fold count, for the held folds wanted."""
        tot = own.groupBy(*keys, *hist).agg(F.sum("_c").alias("_t"))
        if sel is None:
            wanted = tot.crossJoin(folds)
        else:
            wanted = sel.join(tot, keys + hist[:-1] if len(hist) > 1 else keys)
        mine = own.withColumnRenamed("_f", "_held").withColumnRenamed("_c", "_o")
        j = wanted.join(mine, gk + hist, "left")
        return j.select(*gk, *hist, (F.col("_t") - F.coalesce(F.col("_o"), F.lit(0))).alias("_c")).where(F.col("_c") > 0)

    own_n = data.groupBy(*keys, "_f").agg(F.count(F.lit(1)).alias("_c"))
    stats = leave_out(own_n, None, []).withColumnRenamed("_c", "_n").persist()
    n_groups = stats.count()
    targets = _rank_targets(stats, gk, probs).withColumn("_below", F.lit(0).cast("long"))

    own1 = data.groupBy(*keys, "_f", "_b1").agg(F.count(F.lit(1)).alias("_c"))
    t1 = cut(_locate(leave_out(own1, None, ["_b1"]), gk, "_b1", targets, gk, "_below"), "located")  # small, and made now: a reader of its plan may not find it in the cache
    bound = n_groups * 2 * len(probs)
    d2 = _semi(data, t1, keys + ["_b1"], bound)
    own2 = d2.groupBy(*keys, "_f", "_b1", "_b2").agg(F.count(F.lit(1)).alias("_c"))
    lo2 = leave_out(own2, t1.select(*gk, "_b1").distinct(), ["_b1", "_b2"])
    t2 = cut(_locate(lo2, gk + ["_b1"], "_b2", t1, gk + ["_b1"], "_below"), "located")  # small, and made now: a reader of its plan may not find it in the cache
    d3 = _semi(data, t2, keys + ["_b2"], bound)
    own3 = d3.groupBy(*keys, "_f", "_b2", "_v").agg(F.count(F.lit(1)).alias("_c"))
    lo3 = leave_out(own3, t2.select(*gk, "_b2").distinct(), ["_b2", "_v"])
    t3 = _locate(lo3, gk + ["_b2"], "_v", t2.drop("_b1"), gk + ["_b2"], "_below")
    picked = t3.select(*gk, "_r", F.col("_v").alias("_val"))
    out = _interpolate(stats, picked, gk, probs, names, [])
    return out.drop(_KEY) if _KEY in out.columns else out
