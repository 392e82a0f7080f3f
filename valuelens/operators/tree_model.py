"""Fitted tree models: scoring by node tables, per-tree spread, and cross-validated fits of the presets.

A model is a table of nodes (tree, node, feature, bin, left, value) and the edges of its bins.
Trees are scored in blocks of at most ``BLOCK_NODES`` nodes: a block meets the binned rows (``PART_BYTES`` of them
at a time) in one task, which walks them through its trees and gives three sums per row, from which
prediction and spread follow.  No node passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuelens.operators import trees as TR
from valuelens.session import cut, ship_package

BLOCK_NODES = 4_000_000
PART_BYTES = 64 << 20  # of the binned rows that meet a block in one task
JOINED_ROWS = 200_000  # rows whose sums are broadcast to them
WALKS = 250_000  # (row, tree) pairs walked together


@dataclass
class TreeModel:
    columns: list[str]
    edges: list[list[float]]
    nodes: DataFrame
    boosted: bool  # tree values are added, not averaged
    trees: int
    importance: list[float]  # per column


def _dense(t: pa.Table) -> tuple[np.ndarray, ...]:
    """(feature, bin, left, right, value, roots) with positions instead of ids."""
    tree, node, feature, cutoff, left, value = (t.column(c).to_numpy() for c in ("tree", "node", "feature", "bin", "left", "value"))
    order = np.lexsort((node, tree))
    tree, node, feature, cutoff, left, value = (a[order] for a in (tree, node, feature, cutoff, left, value))
    right = np.where(left & 0xFFFFFFFF == 0, left + (1 << 32), left + 1)  # below the top of a tree ids have low bits
    starts = np.concatenate([[0], np.flatnonzero(np.diff(tree)) + 1, [len(tree)]]) if len(tree) else np.zeros(1, np.int64)
    at_left, at_right = np.zeros(len(tree), np.int64), np.zeros(len(tree), np.int64)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        at_left[a:b], at_right[a:b] = a + np.searchsorted(node[a:b], left[a:b]), a + np.searchsorted(node[a:b], right[a:b])
    return feature.astype(np.int16), cutoff.astype(np.uint8), at_left.astype(np.int32), at_right.astype(np.int32), value, starts[:-1].astype(np.int32)


def _walk(dense: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """(trees, rows) values."""
    feature, cutoff, left, right, value, roots = dense
    n = bins.shape[1]
    at, r = np.repeat(roots, n), np.tile(np.arange(n), len(roots))
    live = np.flatnonzero(feature[at] >= 0)
    while len(live):
        here = at[live]
        here = np.where(bins[feature[here], r[live]] <= cutoff[here], left[here], right[here])
        at[live] = here
        live = live[feature[here] >= 0]
    return value[at].reshape(len(roots), n)


_PACKED = np.dtype([("tree", "<i4"), ("node", "<i8"), ("feature", "<i2"), ("bin", "u1"), ("left", "<i8"), ("value", "<f8")])


def _blocks(model: TreeModel) -> dict[int, int]:
    """The block of each tree."""
    per_tree = sorted((r["tree"], r["n"]) for r in model.nodes.groupBy("tree").agg(F.count("*").alias("n")).collect())  # one row per tree
    out: dict[int, int] = {}
    block, size = -1, BLOCK_NODES
    for tree, n in per_tree:
        if block < 0 or size + n > BLOCK_NODES:
            block, size = block + 1, 0
        out[tree], size = block, size + n
    return out


def _packed_nodes(block_of: dict[int, int]):
    """Batches of nodes as (block, nodes) records."""
    low = min(block_of, default=0)
    blocks = np.full(max(block_of, default=0) - low + 1, -1, np.int64)
    for tree, block in block_of.items():
        blocks[tree - low] = block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.empty(b.num_rows, _PACKED)
            for i, c in enumerate(_PACKED.names):
                own[c] = b.column(i).to_numpy(zero_copy_only=False)
            of = blocks[own["tree"] - low]
            found = np.unique(of)
            yield pa.record_batch([pa.array(found), pa.array([own[of == k].tobytes() for k in found], pa.binary())], names=["block", "nodes"])

    return run


def tree_sums(df: DataFrame, model: TreeModel, log: bool) -> DataFrame:
    """``df`` (with the encoded columns) and sums over trees: ``_t1`` of values, ``_t2`` and ``_t3`` of prices (expm1 of values if ``log``) and their squares."""
    spark = df.sparkSession
    ship_package(spark)
    given = cut(df.withColumns({"_rid": F.monotonically_increasing_id(), "_tx": F.array(*[F.col(c).cast("double") for c in model.columns])}), "scored")
    block_of, edges = _blocks(model), [np.array(e) for e in model.edges]
    blocks, n = max(block_of.values(), default=-1) + 1, given.count()
    parts = -(-n * (len(edges) + 8) // PART_BYTES) or 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bins = np.ascontiguousarray(TR._bin(TR._matrix(b.column(1), len(edges)), edges).T).tobytes()
            rows = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0).cast(pa.int64()))
            part = pa.array([int(TR._mix(np.array([b.column(0)[0].as_py()], np.uint64))[0] % np.uint64(parts))], pa.int64())
            for k in range(blocks):
                yield pa.record_batch([pa.array([k], pa.int64()), part, rows, pa.array([bins], pa.binary())], names=["block", "part", "rows", "bins"])

    def walk(nodes: pa.Table, rows: pa.Table) -> pa.Table:
        rid = rows.column("rows").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        bins = np.ascontiguousarray(np.frombuffer(b"".join(rows.column("bins").to_pylist()), np.uint8).reshape(len(rid), len(edges)).T)
        own = np.frombuffer(b"".join(nodes.column("nodes").to_pylist()), _PACKED)
        dense = _dense(pa.table({c: own[c] for c in _PACKED.names}))
        sums = np.zeros((3, len(rid)))
        step = max(1, WALKS // max(1, len(dense[5])))
        for a in range(0, len(rid), step):
            v = _walk(dense, bins[:, a : a + step])
            with np.errstate(over="ignore"):
                e = np.expm1(v) if log else v
                sums[:, a : a + step] = v.sum(0), e.sum(0), (e * e).sum(0)
        return pa.table([rid, *sums], names=["_rid", "_t1", "_t2", "_t3"])

    dealt = given.select("_rid", "_tx").mapInArrow(deal, "block long, part long, rows array<long>, bins binary")
    nodes = model.nodes.select(*_PACKED.names).mapInArrow(_packed_nodes(block_of), "block long, nodes binary")
    nodes = nodes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    tasks = max(1, min(blocks * parts * 4, TR.UNITS))  # so that few blocks share a task
    dealt, nodes = (d.repartition(tasks, "block", "part") for d in (dealt, nodes))
    found = nodes.groupBy("block", "part").cogroup(dealt.groupBy("block", "part")).applyInArrow(walk, "_rid long, _t1 double, _t2 double, _t3 double")
    sums = cut(found.groupBy("_rid").agg(*[F.sum(c).alias(c) for c in ("_t1", "_t2", "_t3")]), "sums")
    side = F.broadcast(sums) if n <= JOINED_ROWS else sums
    out = given.drop("_tx").join(side, "_rid", "left").drop("_rid")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("_t1", "_t2", "_t3")})


def predict_trees(df: DataFrame, model: TreeModel, out: str) -> DataFrame:
    """``df`` with the model's raw prediction."""
    scale = 1.0 if model.boosted else float(model.trees)
    return tree_sums(df, model, False).withColumn(out, F.col("_t1") / scale).drop("_t1", "_t2", "_t3")


# ------------------------------------------------------------------ cross-validated fits of a preset
class Slot(NamedTuple):
    """What a fit is for: the model of one subset (``job``) without ``fold``; in stacking one base (``part``) without an inner fold."""

    job: int
    fold: int
    part: str
    inner: int


def _settings(preset: dict, trees: int | None, max_depth: int | None) -> dict:
    if preset["kind"] == "gbt":
        return {"trees": trees or preset["trees"], "min_leaf": preset["min_leaf"], "max_depth": preset["depth"], "rate": preset["lr"], "subsample": preset["subsample"]}
    return {"trees": trees or preset["trees"], "min_leaf": preset["min_leaf"], "max_depth": max_depth}


def plan_fits(job: int, preset: dict, columns: Sequence[int], folds: Sequence[int], trees: int | None = None, max_depth: int | None = None, keep: int | None = None, grid: float = 0.0) -> list[tuple[Slot, TR.Fit]]:
    """The fits of one preset on some columns: one per held-out fold (-1: none).  ``keep``: the fold whose nodes are wanted; ``grid``: that of the fits."""
    out = []
    for fold in folds:
        parts = {preset["kind"]: preset} if preset["kind"] != "stacking" else preset["base"]
        for part, own in parts.items():
            spec = _settings(own, trees, max_depth) | {"grid": grid}
            for inner in range(preset.get("cv", 0)):
                out.append((Slot(job, fold, part, inner), TR.Fit(tuple(columns), held=fold, inner=inner, **spec)))
            out.append((Slot(job, fold, part, -1), TR.Fit(tuple(columns), held=fold, keep=fold == keep, **spec)))
    return out


def out_of_fold(grown: TR.Grown, slots: Sequence[Slot], stacking: bool) -> tuple[DataFrame, DataFrame | None]:
    """(job, fold, row, y, raw) of all held-out rows, and stacking's meta models (job, fold, _fold, _intercept, _coef)."""
    from valuelens.operators import linear as L

    spark = grown.table.sparkSession
    names = spark.createDataFrame([(i, *s) for i, s in enumerate(slots)], "fit int, job int, fold int, part string, inner int")  # one row per fit
    found = grown.predictions().join(F.broadcast(names), "fit")
    if not stacking:
        return found.select("job", "fold", "row", "y", F.col("prediction").alias("raw")), None
    is_inner = (F.col("inner") >= 0).alias("is_inner")
    base = [F.max(F.when(F.col("part") == p, F.col("prediction"))).alias(p) for p in ("forest", "gbt")]
    both = cut(found.groupBy("job", "fold", "row", is_inner).agg(F.first("y").alias("y"), *base), "bases")
    meta = L.fit_linear(both.where("is_inner"), ["forest", "gbt"], "y", ["job", "fold"])
    scored = L.predict(both.where("not is_inner"), meta, ["forest", "gbt"], ["job", "fold"], out="raw")
    return scored.select("job", "fold", "row", "y", "raw"), meta


def kept_model(grown: TR.Grown, slots: Sequence[Slot], fits: Sequence[TR.Fit], fold: int, part: str, columns: list[str], edges: list[np.ndarray]) -> TreeModel:
    """The stored model of a fold's complete fit."""
    k = next(i for i, s in enumerate(slots) if s.fold == fold and s.part == part and s.inner < 0)
    gains = {r["feature"]: r["importance"] for r in grown.gains().where(F.col("fit") == k).collect()}  # one row per column
    return TreeModel(columns, [e.tolist() for e in edges], grown.nodes(k), part == "gbt", fits[k].trees, [float(gains.get(j, 0.0)) for j in range(len(columns))])
