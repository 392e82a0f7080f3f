"""Gram sums: row count, column sums and cross products of a list of expressions, per key.

Each task multiplies its batches with numpy (X^T X) and sends one packed row per key, so the
plan stays the same size whatever the number of columns.  The packed rows are added in two
grouped steps, first by (key, salt), then by key: a key that every task holds never meets
in one task unsummed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuelens.session import ship_package

SALTS = 32
HELD_NUMBERS = 4_000_000  # cross products a task holds before it sends what it has


def _rows(names: Sequence[str], types: Sequence[pa.DataType], keys: list[tuple], sums: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate(types)]
    cols += [pa.array([s[0] for s in sums], pa.int64())]
    cols += [pa.array([s[i].ravel().tolist() for s in sums], pa.list_(pa.float64())) for i in (1, 2)]
    return pa.record_batch(cols, names=[*names, "_n", "_S", "_P"])


def _products(names: Sequence[str], q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        types: list[pa.DataType] = []
        for b in batches:
            types = [b.column(i).type for i in range(len(names))]
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[len(names) :]], 1) if q else np.zeros((b.num_rows, 0))
            seen = [b.column(i).dictionary_encode() for i in range(len(names))]
            codes = np.zeros(b.num_rows, np.int64)
            for c in seen:  # nulls count as a value of their own
                own = c.indices.fill_null(len(c.dictionary)).to_numpy(zero_copy_only=False)
                codes = np.unique(codes * (len(c.dictionary) + 1) + own, return_inverse=True)[1]
            first = np.unique(codes, return_index=True)[1]
            code_of = {tuple(b.column(i)[int(at)].as_py() for i in range(len(names))): code for code, at in enumerate(first)}
            order = np.argsort(codes, kind="stable")
            cuts = np.searchsorted(codes[order], np.arange(len(code_of) + 1))
            for key, code in code_of.items():
                part = x[order[cuts[code] : cuts[code + 1]]]
                old = held.setdefault(key, [0, np.zeros(q), np.zeros((q, q))])
                old[0] += len(part)
                old[1] += part.sum(0)
                old[2] += part.T @ part
            if len(held) * q * q > HELD_NUMBERS:
                yield _rows(names, types, list(held), list(held.values()))
                held = {}
        if held:
            yield _rows(names, types, list(held), list(held.values()))

    return run


def _add(names: Sequence[str]):
    def run(t: pa.Table) -> pa.Table:
        total = [np.vstack(t.column(c).to_numpy()).sum(0).tolist() for c in ("_S", "_P")]
        cols = {k: t.column(k).slice(0, 1) for k in names}
        cols |= {"_n": pa.array([sum(t.column("_n").to_pylist())], pa.int64())}
        cols |= {c: pa.array([v], pa.list_(pa.float64())) for c, v in zip(("_S", "_P"), total, strict=True)}
        return pa.table(cols)

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, s = [], []
    for b in batches:
        x = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        ok = [~np.isnan(v) for v in x]
        n.append([int(o.sum()) for o in ok])
        s.append([float(v[o].sum()) for v, o in zip(x, ok, strict=True)])
    if n:
        lists = (pa.array([np.sum(v, 0).tolist()], pa.list_(t)) for v, t in ((n, pa.int64()), (s, pa.float64())))
        yield pa.record_batch([*lists], names=["n", "s"])


def centres(df: DataFrame, exprs: Sequence[Column]) -> list[float]:
    """About the mean of each expression (0 without a value): what to shift by before multiplying."""
    if not exprs:
        return []
    ship_package(df.sparkSession)
    each = df.select(*[e.cast("double").alias(f"_x{i}") for i, e in enumerate(exprs)]).mapInArrow(_sums, "n array<long>, s array<double>").collect()  # one row per task
    n, s = (np.sum([r[c] for r in each], 0) if each else np.zeros(len(exprs)) for c in ("n", "s"))
    return [float(b / a) if a and np.isfinite(b) else 0.0 for a, b in zip(n, s, strict=True)]


def gram(df: DataFrame, exprs: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., _n, _S array, _P array): count, sums and q x q cross products (row by row) of non-null doubles."""
    ship_package(df.sparkSession)
    names = [*keys, "_salt"]
    given = df.select(*keys, F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("_salt"), *[e.cast("double").alias(f"_x{i}") for i, e in enumerate(exprs)])
    more = T.StructType.fromDDL("_n long, _S array<double>, _P array<double>").fields
    schema = T.StructType([given.schema[k] for k in names] + more)
    partial = given.mapInArrow(_products(names, len(exprs)), schema)
    salted = partial.groupBy(*names).applyInArrow(_add(names), schema)
    if not keys:
        salted, keys = salted.withColumn("_all", F.lit(0)), ["_all"]
    last = T.StructType([salted.schema[k] for k in keys] + more)
    out = salted.groupBy(*keys).applyInArrow(_add(list(keys)), last)
    return out.drop("_all")
