"""Histogram trees for many models at once: forests and boosting for all (subset, fold, tree).

Features are binned once to bytes.  A model's rows are those outside its held-out fold; a
tree's bootstrap weights are Poisson(1) numbers made from a hash of the row's key and the
tree, so they depend on neither partitioning nor model.  All trees grow level by level
from (tree, node, feature, bin) sums of weights and targets; a level's best split per
node is a maximum over the bins.  While a node has more rows than a task may hold (``rows_of_a_task``), its
level is one pass over the table for all models: every task adds up its rows, the sums
of a node are added in one group, and only the chosen splits come back.  Once a node's
rows fit, they go to one task, which grows the subtree below it with the same sums in
numpy; a table that fits from the start goes there at the root, and then a task grows a
block of models on one copy of the rows.  Boosting does the same: its rounds run in one task per
model where the rows fit, else by passes.

What comes out are tables: out-of-fold predictions, tree nodes, importances.  The driver
holds the fits' parameters and the splits of nodes above that bound, of which there are at most
2 * rows / bound per tree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuelens.operators.quantiles import group_quantiles
from valuelens.session import cut, ship_package

MAX_BINS = 64
LOCAL_ROWS = 500_000  # rows of a task, whatever their width ...
LOCAL_BYTES = 112 << 20  # ... or as many as have so many bytes
ROW_BYTES = 40  # of a row besides its bins
DEALT_BYTES = 8 << 30  # of the copies of the rows that blocks of models get; 64 blocks at least
CARRIED = 64 << 20  # bytes of bins that move along with a tree's entries
UNIT_TREES = 50  # trees of one task's block at most
ENTRIES = 2_000_000  # (tree, row) pairs grown together
STEP_NODES = 1_024  # nodes whose sums are searched together, so that they stay in the cache
PASS_NODES = 4_096  # nodes whose sums a task holds in one pass
UNITS = 512  # blocks of models, and partitions for them (four a block, so that few share one), at most
_POISSON = np.cumsum([0.36787944117144233 / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880)])
_OWN = ("row", "h", "fold", "inner", "y", "weight", "bins")
GROWN = "kind string, fit int, tree int, node long, feature int, bin int, left long, row long, y double, value double, n int"


class Fit(NamedTuple):
    """One model: its columns, the folds it leaves out, and its settings.  ``rate`` 0 is a forest, else boosting."""

    columns: tuple[int, ...]
    trees: int
    min_leaf: int = 1
    max_depth: int | None = None
    held: int = -1
    inner: int = -1
    rate: float = 0.0
    subsample: float = 1.0
    keep: bool = False  # its nodes are wanted
    grid: float = 0.0  # targets are multiples of it, so that their sums are exact; in boosting so are means and node values


def snapped(v, grid: float):
    """``v`` as multiples of ``grid``, if there is one."""
    return np.round(v / grid) * grid if grid else v


# ------------------------------------------------------------------ hashes and bins
def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _uniform(h: np.ndarray, tree: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(h.view(np.uint64) ^ _mix(np.full(1, tree + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(11)) * 2.0**-53


def tree_weights(fit: Fit, h: np.ndarray, tree: int) -> np.ndarray:
    """Weights of rows in a tree: Poisson(1) copies for a forest, the rows drawn for a round of boosting."""
    if not fit.rate:
        return np.searchsorted(_POISSON, _uniform(h, tree), "right").astype(np.float64)
    return np.ones(len(h)) if fit.subsample >= 1 else (_uniform(h, tree) < fit.subsample).astype(np.float64)


def bin_edges(x: DataFrame, cols: Sequence[str]) -> list[np.ndarray]:
    """Upper edges of the bins per column: between the values if there are at most ``MAX_BINS``, else exact quantiles."""
    long = x.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "_f", "_x").where("_x is not null")
    values = long.groupBy("_f", "_x").agg(F.lit(1).alias("one"))
    few = values.groupBy("_f").agg(F.count("*").alias("n")).collect()  # one row per column
    small = [r["_f"] for r in few if r["n"] <= MAX_BINS]
    large = [r["_f"] for r in few if r["n"] > MAX_BINS]
    edges: dict[str, np.ndarray] = {}
    if small:
        for r in values.where(F.col("_f").isin(small)).groupBy("_f").agg(F.collect_list("_x").alias("v")).collect():  # at most MAX_BINS each
            v = np.sort(np.array(r["v"]))
            edges[r["_f"]] = (v[:-1] + v[1:]) / 2
    if large:
        names = [f"_q{k}" for k in range(1, MAX_BINS)]
        q = group_quantiles(long.where(F.col("_f").isin(large)), ["_f"], "_x", [k / MAX_BINS for k in range(1, MAX_BINS)], names)
        for r in q.collect():
            edges[r["_f"]] = np.unique([float(r[n]) for n in names])
    return [edges.get(c, np.empty(0)) for c in cols]


def _bin(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """(columns, rows) bytes: the number of edges below a value."""
    return np.stack([np.searchsorted(e, values[:, j], "left").astype(np.uint8) for j, e in enumerate(edges)]) if len(edges) else np.empty((0, len(values)), np.uint8)


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def binned_rows(x: DataFrame, cols: Sequence[str], y: str, keys: Sequence[str], fold, inner, edges: list[np.ndarray], weight=None) -> DataFrame:
    """(row, h, fold, inner, y, weight, bins, keys...) written once; ``fold``, ``inner`` and ``weight`` are columns or None.

    A row of weight 3 counts as three rows in every sum; rows without a positive weight are learned from by none.
    """
    ship_package(x.sparkSession)
    h = F.xxhash64(*[F.col(k) for k in keys]) if keys else F.xxhash64(*[F.col(c) for c in cols], y)
    given = x.select(
        F.monotonically_increasing_id().alias("row"), h.alias("h"), (F.lit(-1) if fold is None else fold).cast("int").alias("fold"),
        (F.lit(-1) if inner is None else inner).cast("int").alias("inner"), F.col(y).cast("double").alias("y"),
        (F.lit(1.0) if weight is None else F.coalesce(weight.cast("double"), F.lit(0.0))).alias("weight"),
        F.array(*[F.col(c).cast("double") for c in cols]).alias("x"), *[F.col(k) for k in dict.fromkeys(keys) if k not in _OWN],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = np.ascontiguousarray(_bin(_matrix(b.column(6), len(cols)), edges).T)
            yield pa.record_batch([*b.columns[:6], pa.array([r.tobytes() for r in bins], pa.binary()), *b.columns[7:]], names=[*b.schema.names[:6], "bins", *b.schema.names[7:]])

    from pyspark.sql import types as T

    schema = T.StructType([*given.schema.fields[:6], T.StructField("bins", T.BinaryType()), *given.schema.fields[7:]])
    return cut(given.mapInArrow(run, schema), "binned")


# ------------------------------------------------------------------ growing in a task
class Nodes(NamedTuple):
    """Nodes of some trees; the roots are 0, 1, ...; a leaf has feature -1; the right child is left + 1."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    tree: np.ndarray


def _best_split(local: np.ndarray, b: np.ndarray, w: np.ndarray, wy: np.ndarray, total: np.ndarray, s: np.ndarray, min_leaf: int, width: int = MAX_BINS, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(score, bin) of each node's best cut of one feature of ``width`` bins; the score is the sum over sides of s^2 / w.

    Where sums are ``exact`` both forms give the same, and the one that is faster for this width is taken.
    """
    k = len(total)
    key, cells = local * width + b, k * width
    if k * (width if exact else MAX_BINS) <= 2 * len(key) + 65_536:
        sums = np.bincount(key, w, cells).reshape(k, width), np.bincount(key, wy, cells).reshape(k, width)
        top, by = np.empty(k), np.empty(k, np.int64)
        step = STEP_NODES * MAX_BINS // width
        for a in range(0, k, step):
            part = slice(a, a + step)
            cw, cs = (v[part].cumsum(1)[:, :-1] for v in sums)
            rest = total[part, None] - cw
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where((cw >= min_leaf) & (rest >= min_leaf), cs * cs / cw + (s[part, None] - cs) ** 2 / rest, -np.inf)
            by[part] = score.argmax(1)
            top[part] = score[np.arange(len(score)), by[part]]
        return top, by
    # sorted by (node, bin), places below them in the same numbers: plain numbers sort faster than places by key
    shift = max(1, (len(key) - 1).bit_length())
    packed = (key << shift) | np.arange(len(key))
    packed.sort()
    order = packed & ((1 << shift) - 1)
    key = packed >> shift
    start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    at, rw, rs = key.take(start), np.add.reduceat(w.take(order), start), np.add.reduceat(wy.take(order), start)
    node = at // width
    first = np.searchsorted(node, np.arange(k))
    runs = np.diff(first, append=len(node))
    cw, cs = rw.cumsum(), rs.cumsum()
    cw -= np.repeat(cw[first] - rw[first], runs)
    cs -= np.repeat(cs[first] - rs[first], runs)
    rest = np.repeat(total, runs) - cw
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((cw >= min_leaf) & (rest >= min_leaf), cs * cs / cw + (np.repeat(s, runs) - cs) ** 2 / rest, -np.inf)
    best = np.maximum.reduceat(score, first)
    hit = np.flatnonzero(score == np.repeat(best, runs))
    where = np.zeros(k, np.int64)
    where[node[hit][::-1]] = hit[::-1]
    return best, at[where] % width


def grow(bins: np.ndarray, y: np.ndarray, row: np.ndarray, tree: np.ndarray, w: np.ndarray, n_trees: int, columns: Sequence[int], min_leaf: int, max_depth: int | None, exact: bool = False) -> Nodes:
    """Trees from (tree, row, weight) entries with positive weights.  ``exact``: no sum of the targets is rounded.

    Entries of a node lie together (left sides before right sides at every level), so sums by node stay in the cache.
    Up to ``CARRIED`` bytes of bins move along with them, so that no level reads the table again.
    """
    place, wy = tree.astype(np.int64), w * y[row]
    total, s = np.bincount(place, w, n_trees), np.bincount(place, wy, n_trees)
    owner, cols = np.arange(n_trees), np.array(columns, np.int64)
    width = [max(2, int(bins[j].max()) + 1) if len(row) else 2 for j in columns]
    own = np.stack([bins[j].take(row) for j in columns]) if len(cols) and len(cols) * len(row) <= CARRIED else None
    base, depth, levels = 0, 0, []
    keep = np.arange(len(row))  # the entries in their new order
    while True:
        k = len(total)
        feature, at, left, gain = np.full(k, -1, np.int32), np.zeros(k, np.int32), np.full(k, -1, np.int64), np.zeros(k)
        value = np.divide(s, total, out=np.zeros(k), where=total > 0)
        levels.append((feature, at, left, value, gain, owner))
        can = (total >= max(2 * min_leaf, 1)) & (max_depth is None or depth < max_depth)
        ids = np.flatnonzero(can)
        if not len(ids) or not len(cols):
            break
        keep = keep[can.take(place.take(keep))]
        w, wy, local = w.take(keep), wy.take(keep), (can.cumsum() - 1).take(place.take(keep))
        if own is None:
            row = row.take(keep)
        else:
            own = own.take(keep, axis=1)
        parent = s[ids] ** 2 / total[ids]
        best, by, cutoff = parent + 1e-10 * np.abs(parent) + 1e-12, np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
        for c, j in enumerate(columns):
            score, b = _best_split(local, bins[j].take(row) if own is None else own[c], w, wy, total[ids], s[ids], min_leaf, width[c], exact)
            better = score > best
            best[better], by[better], cutoff[better] = score[better], c, b[better]
        split = by >= 0
        if not split.any():
            break
        child = 2 * (split.cumsum() - 1)
        feature[ids], at[ids], left[ids] = np.where(split, cols[by], -1), cutoff, np.where(split, base + k + child, -1)
        gain[ids] = np.where(split, best - parent, 0.0)
        cut_by = np.maximum(by, 0).take(local)
        right = (bins[cols.take(cut_by), row] if own is None else own.reshape(-1).take(cut_by * len(local) + np.arange(len(local)))) > cutoff.take(local)
        place, go = child.take(local) + right, split.take(local)
        keep = np.concatenate([np.flatnonzero(go & ~right), np.flatnonzero(go & right)])
        owner = np.repeat(owner[ids[split]], 2)
        base, depth = base + k, depth + 1
        total, s = np.bincount(place.take(keep), w.take(keep), len(owner)), np.bincount(place.take(keep), wy.take(keep), len(owner))
    return Nodes(*(np.concatenate(c) for c in zip(*levels, strict=True)))


def leaves(nodes: Nodes, bins: np.ndarray, rows: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """(roots, rows): the leaf each row reaches from each root."""
    at = np.repeat(roots.astype(np.int64), len(rows))
    r = np.tile(rows, len(roots))
    live = np.flatnonzero(nodes.feature[at] >= 0)
    while len(live):
        here = at[live]
        f = nodes.feature[here]
        here = nodes.left[here] + (bins[f, r[live]] > nodes.bin[here])
        at[live] = here
        live = live[nodes.feature[here] >= 0]
    return at.reshape(len(roots), len(rows))


def importances(nodes: Nodes, n_trees: int, p: int) -> np.ndarray:
    """Per feature, the sum over trees of its share of a tree's gain."""
    inner = nodes.feature >= 0
    share = np.bincount(nodes.tree[inner] * p + nodes.feature[inner], nodes.gain[inner], n_trees * p).reshape(n_trees, p)
    whole = share.sum(1, keepdims=True)
    return np.divide(share, whole, out=np.zeros(share.shape), where=whole > 0).sum(0)


class Rows(NamedTuple):
    row: np.ndarray
    h: np.ndarray
    fold: np.ndarray
    inner: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    bins: np.ndarray  # (columns, rows)

    def weights(self, fit: Fit, tree: int) -> np.ndarray:
        """What each row counts in a tree of the fit; 0 if it is held out or not drawn."""
        return tree_weights(fit, self.h, tree) * np.maximum(self.weight, 0.0) * self.learned(fit)

    def learned(self, fit: Fit) -> np.ndarray:
        """Which rows the fit learns from."""
        return (self.fold != fit.held if fit.held >= 0 else np.ones(len(self.row), bool)) & (self.inner != fit.inner if fit.inner >= 0 else True)

    def scored(self, fit: Fit) -> np.ndarray:
        """Which rows it predicts: of its inner fold, else of its fold, else none."""
        if fit.inner >= 0:
            return (self.inner == fit.inner) & ((self.fold != fit.held) | (fit.held < 0))
        return (self.fold == fit.held) & (fit.held >= 0)


def _out(kind: str, fit: int, size: int, /, **cols) -> pa.RecordBatch:
    kinds = {"tree": pa.int32(), "node": pa.int64(), "feature": pa.int32(), "bin": pa.int32(), "left": pa.int64(), "row": pa.int64(), "y": pa.float64(), "value": pa.float64(), "n": pa.int32()}
    arrays = [pa.array([kind] * size, pa.string()), pa.array(np.full(size, fit, np.int32))]
    arrays += [pa.nulls(size, t) if c not in cols else pa.array(np.asarray(cols[c]) if np.ndim(cols[c]) else np.full(size, cols[c])).cast(t) for c, t in kinds.items()]
    return pa.record_batch(arrays, names=["kind", "fit", *kinds])


def _node_rows(k: int, nodes: Nodes, first_tree: int, shift: int = 0, first_id: int = 0) -> pa.RecordBatch:
    ids = np.arange(len(nodes.feature), dtype=np.int64)
    return _out("node", k, len(ids), tree=nodes.tree + first_tree, node=first_id + ids, feature=nodes.feature, bin=nodes.bin,
                left=np.where(nodes.left >= 0, nodes.left + first_id, -1), value=nodes.value)


def _run_forest(k: int, fit: Fit, low: int, high: int, d: Rows) -> Iterator[pa.RecordBatch]:
    """Trees low .. high - 1 of a forest on rows that fit."""
    score = np.flatnonzero(d.scored(fit))
    sums, gains = np.zeros(len(score)), np.zeros(len(d.bins))
    step = max(1, ENTRIES // max(1, len(d.y)))
    for a in range(low, high, step):
        b = min(a + step, high)
        parts = []
        for t in range(a, b):
            w = d.weights(fit, t)
            on = np.flatnonzero(w)
            parts.append((on, np.full(len(on), t - a), w[on]))
        row, tree, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        nodes = grow(d.bins, d.y, row, tree, w, b - a, fit.columns, fit.min_leaf, fit.max_depth, fit.grid > 0)
        gains += importances(nodes, b - a, len(d.bins))
        if len(score):
            sums += nodes.value[leaves(nodes, d.bins, score, np.arange(b - a))].sum(0)
        if fit.keep:
            yield _node_rows(k, nodes, a)
    if len(score):
        yield _out("oof", k, len(score), row=d.row[score], y=d.y[score], value=sums, n=high - low)
    yield _out("gain", k, len(gains), feature=np.arange(len(gains)), value=gains, n=high - low)


def _run_boosting(k: int, fit: Fit, d: Rows) -> Iterator[pa.RecordBatch]:
    """All rounds of a boosted model on rows that fit; node values are scaled by the rate, tree -1 is the mean."""
    train, score = np.flatnonzero(d.learned(fit)), np.flatnonzero(d.scored(fit))
    whole = d.weights(fit._replace(subsample=1.0), 0)
    mean = float(snapped(np.average(d.y, weights=whole), fit.grid)) if whole.any() else 0.0
    now, gains = np.full(len(d.y), mean), np.zeros(len(d.bins))
    both = np.concatenate([train, score])
    if fit.keep:
        yield _out("node", k, 1, tree=-1, node=0, feature=-1, bin=0, left=-1, value=mean)
    for t in range(fit.trees):
        w = d.weights(fit, t)
        on = np.flatnonzero(w)
        nodes = grow(d.bins, d.y - now, on, np.zeros(len(on), np.int64), w[on], 1, fit.columns, fit.min_leaf, fit.max_depth, fit.grid > 0)
        gains += importances(nodes, 1, len(d.bins))
        nodes = nodes._replace(value=snapped(nodes.value * fit.rate, fit.grid))
        now[both] += nodes.value[leaves(nodes, d.bins, both, np.zeros(1, np.int64))[0]]
        if fit.keep:
            yield _node_rows(k, nodes, t)
    if len(score):
        yield _out("oof", k, len(score), row=d.row[score], y=d.y[score], value=now[score], n=1)
    yield _out("gain", k, len(gains), feature=np.arange(len(gains)), value=gains, n=fit.trees)


# ------------------------------------------------------------------ units: blocks of models on one copy of the rows
UNIT = "unit long, row array<long>, h array<long>, fold array<int>, inner array<int>, y array<double>, weight array<double>, bins binary"


def _unit_rows(unit: int, d: Rows) -> pa.RecordBatch:
    """Rows of a unit as one record."""
    one = lambda v, t: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v).cast(t))
    return pa.record_batch(
        [pa.array([unit], pa.int64()), one(d.row, pa.int64()), one(d.h, pa.int64()), one(d.fold, pa.int32()), one(d.inner, pa.int32()), one(d.y, pa.float64()), one(d.weight, pa.float64()), pa.array([d.bins.T.tobytes()], pa.binary())],
        names=["unit", *_OWN],
    )


def _rows_of(b: pa.RecordBatch, p: int) -> Rows:
    """Rows of a batch of ``binned_rows``."""
    plain = [b.column(c).to_numpy(zero_copy_only=False) for c in range(6)]
    return Rows(*plain, np.ascontiguousarray(np.frombuffer(b"".join(b.column(6).to_pylist()), np.uint8).reshape(b.num_rows, p).T))


def _unit_table(t: pa.Table, p: int) -> Rows:
    plain = [t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in _OWN[:6]]
    order = np.argsort(plain[0], kind="stable")  # sums in one order, whatever order the parts came in
    bins = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(len(order), p)
    return Rows(*(x[order] for x in plain), np.ascontiguousarray(bins[order].T))


def _units(fits: Sequence[Fit], size: int = 0) -> list[list[tuple[int, int, int]]]:
    """Blocks of (fit, first tree, last tree + 1): as even as whole boosted models allow, about ``UNITS`` at most.

    Every block gets a copy of ``size`` bytes, so there are fewer of them where these are large.
    """
    trees = sum(f.trees for f in fits)
    most = max(1, min(UNIT_TREES, -(-trees // 64)), -(-trees // max(64, min(UNITS, DEALT_BYTES // max(1, size)))))
    out: list[list[tuple[int, int, int]]] = []
    room = 0
    for k, f in enumerate(fits):
        a = 0
        while a < f.trees:
            n = f.trees if f.rate else min(f.trees - a, room or most)
            if not room or f.rate:
                out.append([])
                room = most
            out[-1].append((k, a, a + n))
            a, room = a + n, 0 if f.rate else room - n
    return out


def _grow_units(rows: DataFrame, p: int, fits: Sequence[Fit], n: int) -> DataFrame:
    """All fits, blocks of models per task: every block gets one copy of the ``n`` rows."""
    units = _units(fits, n * (ROW_BYTES + p))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _rows_of(b, p)
                for u in range(len(units)):
                    yield _unit_rows(u, d)

    def run(t: pa.Table) -> pa.Table:
        u = t.column("unit")[0].as_py()
        d = _unit_table(t, p)
        out = []
        for k, low, high in units[u]:
            out += list(_run_boosting(k, fits[k], d) if fits[k].rate else _run_forest(k, fits[k], low, high, d))
        return pa.Table.from_batches(out)

    dealt = rows.select(*_OWN).mapInArrow(deal, UNIT)
    return dealt.repartition(min(4 * len(units), UNITS), "unit").groupBy("unit").applyInArrow(run, GROWN)


class Grown(NamedTuple):
    """What all fits gave, written once."""

    table: DataFrame

    def predictions(self) -> DataFrame:
        """(fit, row, y, prediction) of the held-out rows."""
        return self.table.where("kind = 'oof'").groupBy("fit", "row").agg(F.first("y").alias("y"), (F.sum("value") / F.sum("n")).alias("prediction"))

    def nodes(self, fit: int) -> DataFrame:
        """(tree, node, feature, bin, left, value) of a fit that keeps them; ids are per block of trees."""
        return self.table.where(f"kind = 'node' and fit = {int(fit)}").select("tree", "node", "feature", "bin", "left", "value")

    def gains(self) -> DataFrame:
        """(fit, feature, importance): mean share of the gain, normalized to 1."""
        per = self.table.where("kind = 'gain'").groupBy("fit", "feature").agg(F.sum("value").alias("value"))
        whole = per.groupBy("fit").agg(F.sum("value").alias("whole"))
        return per.join(whole, "fit").select("fit", "feature", F.coalesce(F.try_divide("value", "whole"), F.lit(0.0)).alias("importance"))


def rows_of_a_task(p: int) -> int:
    """Rows of ``p`` columns that may meet in one task."""
    return max(LOCAL_ROWS, LOCAL_BYTES // (ROW_BYTES + p))


def grow_fits(rows: DataFrame, p: int, fits: Sequence[Fit], local_rows: int | None = None) -> Grown:
    """Grow all ``fits`` on ``binned_rows``."""
    n, local_rows = rows.count(), rows_of_a_task(p) if local_rows is None else local_rows
    if n <= local_rows:
        return Grown(cut(_grow_units(rows, p, fits, n), "grown"))
    from valuelens.operators import tree_levels

    return Grown(tree_levels.grow_large(rows, p, fits, local_rows, n))
