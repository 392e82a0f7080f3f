"""Levels of histogram trees over tables that no task can hold: one pass per level for many models.

The top of every tree, down to nodes of at most ``local_rows`` rows, grows from sums that all tasks
make of their rows; below that a node's rows meet in one task (see ``trees``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuelens.operators import trees as TR
from valuelens.session import cut

BIG, SMALL, LEAF, SPLIT = range(4)
SHIFT = 32  # a node below top node i has an id of i << SHIFT and up


class Top:
    """The top of one tree: nodes of which the driver knows splits, weights and sums."""

    def __init__(self, fit: int, tree: int) -> None:
        self.fit, self.tree = fit, tree
        self.feature, self.bin, self.left, self.value, self.gain = [-1], [0], [-1], [0.0], [0.0]
        self.state, self.depth = [BIG], [0]

    def arrays(self) -> TR.Nodes:
        n = len(self.feature)
        return TR.Nodes(np.array(self.feature, np.int32), np.array(self.bin, np.int32), np.array(self.left, np.int64), np.array(self.value), np.array(self.gain), np.zeros(n, np.int64))

    def of(self, state: int) -> list[int]:
        return [i for i, s in enumerate(self.state) if s == state]

    def settle(self, i: int, found: dict, spec: TR.Fit, local_rows: int) -> None:
        """Take a node's best split, or end it."""
        total, s = found["total"], found["s"]
        self.value[i] = s / total if total else 0.0
        if total <= local_rows and i == 0:
            self.state[i] = SMALL
            return
        parent = s * s / total if total else 0.0
        if found["feature"] < 0 or found["score"] <= parent + 1e-10 * abs(parent) + 1e-12:
            self.state[i] = LEAF
            return
        self.state[i], self.feature[i], self.bin[i], self.left[i], self.gain[i] = SPLIT, found["feature"], found["bin"], len(self.feature), found["score"] - parent
        depth = self.depth[i] + 1
        for w, part in ((found["left_total"], found["left_s"]), (total - found["left_total"], s - found["left_s"])):
            end = w < max(2 * spec.min_leaf, 1) or (spec.max_depth is not None and depth >= spec.max_depth)
            for own, v in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.value, part / w if w else 0.0), (self.gain, 0.0), (self.depth, depth)):
                own.append(v)
            self.state.append(LEAF if end else BIG if w > local_rows else SMALL)


_BEST = "slot int, feature int, bin int, score double, total double, s double, left_total double, left_s double"


def _best(p: int, columns: dict[int, tuple[int, ...]], min_leaf: dict[int, int]) -> Callable[[pa.Table], pa.Table]:
    """The best split of a node from the sums of all tasks."""

    def run(t: pa.Table) -> pa.Table:
        slot = t.column("slot")[0].as_py()
        w, s = (reduce(np.add, (np.frombuffer(x, np.float64) for x in t.column(c).to_pylist())).reshape(p, TR.MAX_BINS) for c in ("w", "wy"))
        first = columns[slot][0] if columns[slot] else 0
        total, whole = float(w[first].sum()), float(s[first].sum())
        out = {"slot": slot, "feature": -1, "bin": 0, "score": -np.inf, "total": total, "s": whole, "left_total": 0.0, "left_s": 0.0}
        for j in columns[slot]:
            cw, cs = w[j].cumsum()[:-1], s[j].cumsum()[:-1]
            rest = total - cw
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where((cw >= min_leaf[slot]) & (rest >= min_leaf[slot]), cs * cs / cw + (whole - cs) ** 2 / rest, -np.inf)
            k = int(score.argmax())
            if score[k] > out["score"]:
                out |= {"feature": j, "bin": k, "score": float(score[k]), "left_total": float(cw[k]), "left_s": float(cs[k])}
        types = {f.name: f.type for f in pa.schema([("slot", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32())])}
        return pa.table({c: pa.array([v], types.get(c, pa.float64())) for c, v in out.items()})

    return run


def _level(rows: DataFrame, p: int, fits: Sequence[TR.Fit], tops: list[Top], target: Callable) -> dict[tuple[int, int], dict]:
    """Best splits of all BIG nodes of ``tops``: {(place in tops, node): split}, one pass over the rows."""
    slots = {(m, i): s for s, (m, i) in enumerate((m, i) for m, t in enumerate(tops) for i in t.of(BIG))}
    if not slots:
        return {}
    spec = [(t.fit, t.tree, t.arrays(), {i: slots[m, i] for i in t.of(BIG)}) for m, t in enumerate(tops)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w_sum, wy_sum = (np.zeros((len(slots), p, TR.MAX_BINS)) for _ in range(2))
        for b in batches:
            if not b.num_rows:
                continue
            d = TR._rows_of(b, p)
            for k, tree, nodes, own in spec:
                fit = fits[k]
                w = d.weights(fit, tree)
                train = np.flatnonzero(w)
                w = w[train]
                if not own or not len(train):
                    continue
                of_node = np.full(len(nodes.feature), -1, np.int64)
                of_node[list(own)] = range(len(own))
                local = of_node[TR.leaves(nodes, d.bins, train, np.zeros(1, np.int64))[0]]
                use = local >= 0
                train, w, local = train[use], w[use], local[use]
                wy = w * target(d, b, k)[train]
                place = list(own.values())
                for j in fit.columns:
                    key = local * TR.MAX_BINS + d.bins[j][train]
                    for into, v in ((w_sum, w), (wy_sum, wy)):
                        into[place, j] += np.bincount(key, v, len(own) * TR.MAX_BINS).reshape(len(own), TR.MAX_BINS)
        yield pa.record_batch(
            [pa.array(np.arange(len(slots), dtype=np.int32)), pa.array([x.tobytes() for x in w_sum], pa.binary()), pa.array([x.tobytes() for x in wy_sum], pa.binary())],
            names=["slot", "w", "wy"],
        )

    at = {s: key for key, s in slots.items()}
    columns = {s: fits[tops[m].fit].columns for s, (m, _) in at.items()}
    least = {s: max(fits[tops[m].fit].min_leaf, 1) for s, (m, _) in at.items()}
    best = rows.mapInArrow(sums, "slot int, w binary, wy binary").groupBy("slot").applyInArrow(_best(p, columns, least), _BEST)
    return {at[r["slot"]]: r.asDict() for r in best.collect()}  # one row per BIG node, PASS_NODES at most


def _target_y(d: TR.Rows, b: pa.RecordBatch, k: int) -> np.ndarray:
    return d.y


def _raw_gains(k: int, tree: int, gain: np.ndarray) -> pa.RecordBatch:
    return TR._out("raw", k, len(gain), tree=tree, feature=np.arange(len(gain)), value=gain, n=1)


def _gain_of(nodes: TR.Nodes, p: int) -> np.ndarray:
    inner = nodes.feature >= 0
    return np.bincount(nodes.feature[inner], nodes.gain[inner], p)


def _top_rows(tops: list[Top], fits: Sequence[TR.Fit], p: int, scale: float = 1.0) -> list[pa.RecordBatch]:
    """What the tops give to the result: their gains, and the nodes that are wanted (small ones come with their subtree)."""
    out = []
    for t in tops:
        nodes = t.arrays()
        out.append(_raw_gains(t.fit, t.tree, _gain_of(nodes, p)))
        if fits[t.fit].keep:
            ids = np.array([i for i, s in enumerate(t.state) if s in (SPLIT, LEAF)], np.int64)
            out.append(TR._out("node", t.fit, len(ids), tree=t.tree, node=ids << SHIFT, feature=nodes.feature[ids], bin=nodes.bin[ids], left=np.where(nodes.left[ids] >= 0, nodes.left[ids] << SHIFT, -1), value=TR.snapped(nodes.value[ids] * scale, fits[t.fit].grid if fits[t.fit].rate else 0.0)))
    return out


def _frame(rows: DataFrame, parts: list[pa.RecordBatch]) -> DataFrame:
    return rows.sparkSession.createDataFrame([tuple(r.values()) for b in parts for r in b.to_pylist()], TR.GROWN)


def _forest_group(rows: DataFrame, p: int, fits: Sequence[TR.Fit], tops: list[Top], local_rows: int) -> DataFrame:
    """Grow some trees: level by level at the top, then their small nodes in tasks."""
    while any(t.of(BIG) for t in tops):
        for (m, i), found in _level(rows, p, fits, tops, _target_y).items():
            tops[m].settle(i, found, fits[tops[m].fit], local_rows)
    spec = [(t.fit, t.tree, t.arrays(), {i: None for i in t.of(SMALL)}) for t in tops]
    units: list[tuple[int, int, int, int]] = []
    for m, (k, tree, _, own) in enumerate(spec):
        for i in own:
            own[i] = len(units)
            units.append((k, tree, i, tops[m].depth[i]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = TR._rows_of(b, p)
            for k, tree, nodes, own in spec:
                fit = fits[k]
                take = np.flatnonzero((d.weights(fit, tree) > 0) | d.scored(fit))
                if not len(take) or not own:
                    continue
                at = TR.leaves(nodes, d.bins, take, np.zeros(1, np.int64))[0]
                order = np.argsort(at, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    if int(at[part[0]]) in own:
                        r = take[part]
                        yield TR._unit_rows(own[int(at[part[0]])], TR.Rows(*(x[r] for x in d[:6]), d.bins[:, r]))

    def below(t: pa.Table) -> pa.Table:
        k, tree, i, depth = units[t.column("unit")[0].as_py()]
        fit, d = fits[k], TR._unit_table(t, p)
        w = d.weights(fit, tree)
        on, score = np.flatnonzero(w), np.flatnonzero(d.scored(fit))
        nodes = TR.grow(d.bins, d.y, on, np.zeros(len(on), np.int64), w[on], 1, fit.columns, fit.min_leaf, None if fit.max_depth is None else fit.max_depth - depth, fit.grid > 0)
        out = [_raw_gains(k, tree, _gain_of(nodes, p))]
        if fit.keep:
            out.append(TR._node_rows(k, nodes, tree, first_id=i << SHIFT))
        if len(score):
            out.append(TR._out("oof", k, len(score), row=d.row[score], y=d.y[score], value=nodes.value[TR.leaves(nodes, d.bins, score, np.zeros(1, np.int64))[0]], n=1))
        return pa.Table.from_batches(out)

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Held-out rows that end in a leaf of a top."""
        for b in batches:
            if not b.num_rows:
                continue
            d = TR._rows_of(b, p)
            for (k, _, nodes, own) in spec:
                score = np.flatnonzero(d.scored(fits[k]))
                if len(score):
                    at = TR.leaves(nodes, d.bins, score, np.zeros(1, np.int64))[0]
                    mine = ~np.isin(at, list(own))
                    yield TR._out("oof", k, int(mine.sum()), row=d.row[score[mine]], y=d.y[score[mine]], value=nodes.value[at[mine]], n=1)

    out = _frame(rows, _top_rows(tops, fits, p)).union(rows.mapInArrow(ended, TR.GROWN))
    if units:
        dealt = rows.mapInArrow(deal, TR.UNIT).repartition(min(4 * len(units), TR.UNITS), "unit")
        out = out.union(dealt.groupBy("unit").applyInArrow(below, TR.GROWN))
    return cut(out, "grown")


def _boosted(rows: DataFrame, p: int, fits: Sequence[TR.Fit], which: list[int]) -> DataFrame:
    """All boosted fits, round by round: every round's trees are tops down to their leaves."""
    at = {k: c for c, k in enumerate(which)}
    spec = [fits[k] for k in which]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(spec), 2))
        for b in batches:
            if b.num_rows:
                d = TR._rows_of(b, p)
                for c, fit in enumerate(spec):
                    w = d.weights(fit._replace(subsample=1.0), 0)
                    total[c] += w.sum(), (w * d.y).sum()
        yield pa.record_batch([pa.array(np.arange(len(spec), dtype=np.int32)), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["c", "n", "s"])

    sums = {r["c"]: r for r in rows.mapInArrow(start, "c int, n double, s double").groupBy("c").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()}
    means = [float(TR.snapped(sums[c]["s"] / sums[c]["n"], spec[c].grid)) if sums[c]["n"] else 0.0 for c in range(len(spec))]
    now = cut(rows.withColumn("f", F.array(*map(F.lit, means)).cast("array<double>")), "round")
    place = now.columns.index("f")
    schema = T.StructType(now.schema.fields)
    parts = [TR._out("node", k, 1, tree=-1, node=0, feature=-1, bin=0, left=-1, value=means[c]) for c, k in enumerate(which) if fits[k].keep]

    def residual(d: TR.Rows, b: pa.RecordBatch, k: int) -> np.ndarray:
        return d.y - TR._matrix(b.column(place), len(spec))[:, at[k]]

    for t in range(max((f.trees for f in spec), default=0)):
        tops = [Top(k, t) for k in which if t < fits[k].trees]
        while any(x.of(BIG) for x in tops):
            for (m, i), found in _level(now, p, fits, tops, residual).items():
                tops[m].settle(i, found, fits[tops[m].fit], -1)
        grown = [(at[x.fit], x.arrays(), fits[x.fit]) for x in tops]
        for x in tops:
            parts += _top_rows([x], fits, p, fits[x.fit].rate)

        def step(batches: Iterator[pa.RecordBatch], grown=grown) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    d, f = TR._rows_of(b, p), TR._matrix(b.column(place), len(spec)).copy()
                    for c, nodes, fit in grown:
                        f[:, c] += TR.snapped(fit.rate * nodes.value, fit.grid)[TR.leaves(nodes, d.bins, np.arange(len(f)), np.zeros(1, np.int64))[0]]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * len(spec)), pa.array(f.ravel()))
                    yield pa.record_batch([*b.columns[:place], lists, *b.columns[place + 1 :]], names=b.schema.names)

        now = cut(now.mapInArrow(step, schema), "round")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d, f = TR._rows_of(b, p), TR._matrix(b.column(place), len(spec))
                for c, k in enumerate(which):
                    on = np.flatnonzero(d.scored(fits[k]))
                    yield TR._out("oof", k, len(on), row=d.row[on], y=d.y[on], value=f[on, c], n=1)

    return cut(_frame(rows, parts).union(now.mapInArrow(held, TR.GROWN)), "grown")


def grow_large(rows: DataFrame, p: int, fits: Sequence[TR.Fit], local_rows: int, n: int) -> DataFrame:
    """The records of ``trees.GROWN`` for all fits on a table of ``n`` rows."""
    models = [(k, t) for k, f in enumerate(fits) if not f.rate for t in range(f.trees)]
    group = max(1, TR.PASS_NODES // max(1, 2 * n // local_rows))
    parts = [_forest_group(rows, p, fits, [Top(*m) for m in models[a : a + group]], local_rows) for a in range(0, len(models), group)]
    boosted = [k for k, f in enumerate(fits) if f.rate]
    if boosted:
        parts.append(_boosted(rows, p, fits, boosted))
    table = reduce(DataFrame.union, parts)
    # gains of a tree come from its top and its subtrees: shares of the whole tree's
    raw = table.where("kind = 'raw'").groupBy("fit", "tree", "feature").agg(F.sum("value").alias("value"))
    whole = raw.groupBy("fit", "tree").agg(F.sum("value").alias("whole"))
    shares = raw.join(whole, ["fit", "tree"]).select(F.lit("gain").alias("kind"), "fit", "tree", "feature", F.coalesce(F.try_divide("value", "whole"), F.lit(0.0)).alias("value"), F.lit(1).alias("n"))
    return table.where("kind <> 'raw'").unionByName(shares, allowMissingColumns=True)
