"""Embedding whitening by a multiplicity-weighted covariance.

Every usable vector becomes integers x = floor(1024 * c) + 100000.  Identical x vectors are
grouped first; a distinct vector with its multiplicity (or one, ``weights="distinct"``) is
a weighted fit row.  Sums are exact integers; the covariance is the weighted matrix product
of vectors that were centred before they are multiplied, made per task and added by Spark.
Each distinct vector is whitened once, and the rows take their result back by a join.

Scale: the grouping counts per task before its shuffle, so a vector that a third of all
rows share costs one row per task.  A task sends the d(d+1)/2 entries of its product and nothing else
to the sum; the driver holds one d x d matrix.  The join back is on the vector's SHA-256.  Vectors
with more than 1/10,000 of all rows (so at most 10,000 of them) are joined by broadcast,
the rest by shuffle, so no task gets a hot vector's rows.

Cases: rows whose vector is null or has null or non-finite entries are dropped, and so are
vectors of another length than most have (of equally frequent lengths the longest counts)
and empty ones; entries beyond 2^52 in size count as 2^52.  Repeated rows and null ids are rows like others.  A
component without variance has ``whitened`` null and takes no part in ``identity_error``;
``explained`` is null if nothing varies.  A ``deviation`` beyond a long is null.  An empty
table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuelens.llm._shared import cut, ship_package

SCALE, SHIFT, LIMIT = 1024.0, 100_000, 2.0**52
#: a vector with more than this share of all rows, and more than HOT_ROWS, is joined by broadcast
HOT_SHARE, HOT_ROWS = 10_000, 1_000
#: eigenvalues below this share of the largest one are noise of the arithmetic
FLAT = 1e-12
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Fit(NamedTuple):
    """What the fit list gives: its size, sums, the covariance's trace, and the components with their eigenvalues."""

    n: int
    sums: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # one column per component


def pack_rows(x: np.ndarray) -> list[bytes]:
    """Each row of int64 as bytes, plane by plane, so that equal high bytes lie together."""
    planes = np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(len(x), -1, 8).transpose(0, 2, 1)).reshape(len(x), -1)
    return [r.tobytes() for r in planes]


def unpack_rows(packed: pa.Array) -> np.ndarray:
    """The inverse of ``pack_rows`` for rows of one length."""
    flat = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(len(packed), 8, -1)
    return np.ascontiguousarray(flat.transpose(0, 2, 1)).view("<i8").reshape(len(packed), -1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, x) of the usable vectors; x is empty for an empty vector."""
    for b in batches:
        col = b.column(1)
        size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = col.flatten()
        end = size.cumsum()
        values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries are nan
        bad = np.concatenate([[0], (~np.isfinite(values)).cumsum()])
        usable = (size > 0) & (bad[end] == bad[end - size]) & col.is_valid().to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(b)
        for d in np.unique(size[usable]).tolist():
            at = np.flatnonzero(usable & (size == d))
            own = values[(end[at] - d)[:, None] + np.arange(d)]
            x = np.clip(np.floor(SCALE * own), -LIMIT, LIMIT).astype(np.int64) + SHIFT
            for i, row in zip(at.tolist(), pack_rows(x), strict=True):
                out[i] = row
        at = pa.array(np.flatnonzero(usable))
        yield pa.record_batch([b.column(0).take(at), pa.array(out, pa.binary()).take(at)], names=["vec_id", "x"])


def _weighted(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return unpack_rows(b.column(0)), b.column(1).to_numpy(zero_copy_only=False)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dimension, sum) over a task; dimension -1 holds the weights."""
    total = None
    for b in batches:
        if b.num_rows:
            x, w = _weighted(b)
            own = np.concatenate([[w.sum()], (x * w[:, None]).sum(axis=0)])
            total = own if total is None else total + own
    if total is not None:
        yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32) - 1), pa.array(total)], names=["dim", "total"])


def _products(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(i, j, v): upper half of the weighted product of centred vectors over a task."""
    total = None
    for b in batches:
        if b.num_rows:
            x, w = _weighted(b)
            z = x - mean
            own = (z * w[:, None]).T @ z
            total = own if total is None else total + own
    if total is not None:
        i, j = np.triu_indices(len(mean))
        yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])


def _matrix(entries: DataFrame, d: int) -> np.ndarray:
    """A symmetric d x d matrix from the parts of all tasks."""
    out = np.zeros((d, d))
    for r in entries.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # d(d+1)/2 numbers, whatever the rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def eigen(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues, falling, and their unit vectors as columns; the entry of largest size is positive."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    lead = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.where(vectors[lead, np.arange(len(order))] < 0, -1.0, 1.0)


def exact_deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sums of (n * x - S)^2 as exact integers, null beyond a long."""
    rough = ((n * x.astype(np.float64) - sums.astype(np.float64)) ** 2).sum(axis=1)
    if len(rough) and rough.max() < 2.0**62 and n * float(np.abs(x).max()) < 2.0**62:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    big = (((n * x.astype(object)) - sums.astype(object)) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in big]


def _whitened(batches: Iterator[pa.RecordBatch], fit: Fit) -> Iterator[pa.RecordBatch]:
    """(x, rows, weight, deviation, z): each distinct vector once."""
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(fit.values > FLAT * max(fit.values[0], 0.0), 1 / np.sqrt(fit.values), np.nan)
    for b in batches:
        if b.num_rows:
            x, _ = _weighted(b)
            z = ((x - fit.sums / fit.n) @ fit.vectors) * scale
            flat = pa.array(z.ravel(), mask=np.isnan(z).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * z.shape[1]), flat)
            yield pa.record_batch([*b.columns, pa.array(exact_deviation(x, fit.n, fit.sums), pa.int64()), lists], names=["x", "weight", "rows", "deviation", "z"])


def _z_products(batches: Iterator[pa.RecordBatch], mean: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(mean), len(mean)))
    for b in batches:
        if b.num_rows:
            z = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)[:, : len(mean)] - mean
            total += (z * b.column(0).to_numpy(zero_copy_only=False)[:, None]).T @ z
    i, j = np.triu_indices(len(mean))
    yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])


def distinct_vectors(rows: DataFrame, weights: str) -> DataFrame:
    """(x, weight, rows) of the vectors of the most frequent length."""
    counted = cut(rows.groupBy("x").agg(F.count("*").alias("rows")), "vectors")
    lengths = counted.groupBy(F.length("x").alias("size")).agg(F.sum("rows").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if lengths is not None:
        counted = counted.where(F.length("x") == lengths["size"])
    weight = F.lit(1).cast("long") if weights == "distinct" else F.col("rows")
    return counted.select("x", weight.alias("weight"), "rows")


def fit_components(distinct: DataFrame, most: int) -> Fit | None:
    """Sums, covariance and components of the weighted vectors; None if there are none."""
    totals = distinct.mapInArrow(_sums, "dim int, total long").groupBy("dim").agg(F.sum("total").alias("total")).collect()
    if not totals:
        return None
    by_dim = {r["dim"]: int(r["total"]) for r in totals}
    n, sums = by_dim[-1], np.array([by_dim[k] for k in range(len(by_dim) - 1)], np.int64)
    mean = sums / n
    cov = _matrix(distinct.mapInArrow(lambda b: _products(b, mean), "i int, j int, v double"), len(sums)) / n
    return Fit(n, sums, float(np.trace(cov)), *eigen(cov, most))


def identity_error(white: DataFrame, fit: Fit) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity, over the components that vary."""
    live = int((fit.values > FLAT * max(fit.values[0], 0.0)).sum())
    if not live:
        return None
    means = white.agg(*(F.sum(F.col("z")[k] * F.col("weight")).alias(f"m{k}") for k in range(live))).first()
    mean = np.array([means[k] for k in range(live)]) / fit.n
    cov = _matrix(white.select("weight", "z").mapInArrow(lambda b: _z_products(b, mean), "i int, j int, v double"), live) / fit.n
    return float(np.abs(cov - np.eye(live)).max())


def whiten(embeddings: DataFrame, components: int = 8, weights: str = "rows") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each usable row and component."""
    spark = embeddings.sparkSession
    ship_package(spark)
    given = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = given.mapInArrow(_packed, "vec_id long, x binary")
    distinct = distinct_vectors(rows, weights)
    fit = fit_components(distinct, components)
    if fit is None:
        return spark.createDataFrame([], RESULT)
    white = cut(distinct.mapInArrow(lambda b: _whitened(b, fit), "x binary, weight long, rows long, deviation long, z array<double>"), "white")
    error = identity_error(white, fit)

    total = white.agg(F.sum("rows")).first()[0]
    keyed = white.select(F.unhex(F.sha2("x", 256)).alias("w_key"), "rows", "deviation", "z")
    least = max(total // HOT_SHARE, HOT_ROWS)
    hot = keyed.where(F.col("rows") > least).select("w_key", "deviation", "z")  # at most HOT_SHARE rows
    cold = keyed.where(F.col("rows") <= least).select("w_key", "deviation", "z")
    ids = rows.select("vec_id", F.unhex(F.sha2("x", 256)).alias("key"))
    met = ids.join(F.broadcast(hot), F.col("key") == F.col("w_key")).unionByName(
        ids.join(F.broadcast(hot.select(F.col("w_key").alias("h_key"))), F.col("key") == F.col("h_key"), "left_anti").join(cold, F.col("key") == F.col("w_key"))
    )
    share = F.array(*(F.lit(float(e) / fit.trace if fit.trace > 0 else None).cast("double") for e in fit.values))
    return met.select("vec_id", "deviation", F.posexplode("z").alias("k", "whitened")).select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share[F.col("k")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
