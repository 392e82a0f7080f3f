"""Model registry (S13): save, load, list newest first, rename, delete.

A model is a folder on the shared store: ``meta`` (one JSON row: id, name,
type, target, features, metrics, encoder metadata), the encoder statistics
tables, the linear coefficients (or stacking's meta model) and the nodes of its trees.
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuelens.operators import encode as E
from valuelens.operators.models import TrainedModel
from valuelens.operators.tree_model import TreeModel


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save_model(spark: SparkSession, root: str, m: TrainedModel, name: str = "", model_id: str | None = None) -> str:
    mid = model_id or _dt.datetime.now().strftime("%Y%m%d_%H%M%S_%f")
    base = f"{root.rstrip('/')}/{mid}"
    specs = []
    for i, s in enumerate(m.encoders.specs):
        d = {k: getattr(s, k) for k in ("name", "kind", "out", "classes", "vocab", "fill_fit", "fill_score", "vmin", "vmax", "global_median", "has_ppsf", "area_col")}
        if s.stats is not None:
            s.stats.write.mode("overwrite").parquet(f"{base}/stats_{i}")
        specs.append(d)
    if m.coefs is not None:
        m.coefs.write.mode("overwrite").parquet(f"{base}/coefs")
    trees = {}
    for part, own in m.trees.items():
        own.nodes.write.mode("overwrite").parquet(f"{base}/trees_{part}")
        trees[part] = {"columns": own.columns, "edges": own.edges, "boosted": own.boosted, "trees": own.trees, "importance": own.importance}
    meta = {"id": mid, "name": name or f"Model {mid}", "model_type": m.model_type, "target_col": m.target, "feature_cols": m.features,
            "use_log": m.use_log, "r2_cv": m.metrics.get("r2_cv"), "mae_cv": m.metrics.get("mae_cv"), "r2_score": m.metrics.get("r2"),
            "train_source": m.train_source, "created": _dt.datetime.now().strftime("%Y-%m-%d %H:%M"), "specs": json.dumps(specs),
            "trees": json.dumps(trees), "version": 0}
    spark.createDataFrame([meta]).coalesce(1).write.mode("overwrite").json(f"{base}/meta")
    return mid


def list_models(spark: SparkSession, root: str) -> DataFrame:
    """Registry rows, newest id first."""
    try:
        d = spark.read.json(f"{root.rstrip('/')}/*/meta")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "id string, name string")
    last = d.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct("*"), "version").alias("m"))
    return last.select("m.*").drop("specs", "trees", "version").orderBy(F.desc("id"))


def _meta(spark: SparkSession, base: str) -> dict:
    """The last row written to a model's ``meta``."""
    return spark.read.json(f"{base}/meta").orderBy(F.desc("version")).first().asDict()


def load_model(spark: SparkSession, root: str, mid: str) -> TrainedModel:
    base = f"{root.rstrip('/')}/{mid}"
    meta = _meta(spark, base)
    enc = E.Encoders(meta["target_col"])
    for i, d in enumerate(json.loads(meta["specs"])):
        s = E.FeatureSpec(**d)
        if s.kind == "target":
            s.stats = spark.read.parquet(f"{base}/stats_{i}")
            s.stats_rows = s.stats.count()
        enc.specs.append(s)
    m = TrainedModel(meta["model_type"], meta["target_col"], list(meta["feature_cols"]), enc, bool(meta["use_log"]),
                     train_source=meta.get("train_source") or "")
    fs, p = _fs(spark, f"{base}/coefs")
    if fs.exists(p):
        m.coefs = spark.read.parquet(f"{base}/coefs")
    for part, own in json.loads(meta["trees"]).items():
        m.trees[part] = TreeModel(nodes=spark.read.parquet(f"{base}/trees_{part}"), **own)
    m.metrics = {"r2_cv": meta.get("r2_cv"), "mae_cv": meta.get("mae_cv"), "r2": meta.get("r2_score")}
    return m


def rename_model(spark: SparkSession, root: str, mid: str, new_name: str) -> None:
    """Give a model another name: one more row in its ``meta``, of which the last one written counts.

    The new row is a file that a reader sees whole or not at all, and nothing is deleted: a
    crash at any point leaves the old name or the new one.
    """
    base = f"{root.rstrip('/')}/{mid}"
    meta = _meta(spark, base)
    meta["name"] = new_name.strip() or meta["name"]
    meta["version"] = (meta.get("version") or 0) + 1
    spark.createDataFrame([meta]).coalesce(1).write.mode("append").json(f"{base}/meta")


def delete_model(spark: SparkSession, root: str, mid: str) -> None:
    fs, p = _fs(spark, f"{root.rstrip('/')}/{mid}")
    if fs.exists(p):
        fs.delete(p, True)
