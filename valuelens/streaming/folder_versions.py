"""Folder watching that takes rewritten and removed files.

A file source remembers file names, so a file that is rewritten under its name is not read
again.  Here each look at the folder compares its listing with the versions announced so far and
appends one announcement per new, changed or vanished file; announcements are what is
streamed.  A micro batch reads the announced files (any headers, by ``csv_scan``) and overwrites
two folders that carry its number: the rows, and a manifest of their versions.  A batch that is
retried writes the same folders again, so it counts once.  Readers take, of each file, the rows
of its last manifest entry: a newer version replaces the older rows, a vanished file has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valuelens.operators.clean import clean_numeric
from valuelens.operators.features import add_derived_features
from valuelens.sources.csv_scan import read_files

VERSION = "path string, modified timestamp, length long"  # a vanished file has length -1
ROWS = "_path string, _row map<string,string>, _batch long"


def _stored(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """What has been written to a folder, nothing if there is none yet."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _last(versions: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("path").orderBy(*[F.desc(c) for c in order])
    return versions.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def announce(spark: SparkSession, folder: str, root: str, pattern: str = "*.csv") -> int:
    """Append an announcement for each file whose version has not been announced; how many there are."""
    try:
        here = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").alias("modified"), "length")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        here = spark.createDataFrame([], VERSION)
    known = _last(_stored(spark, f"{root}/versions", VERSION + ", seen timestamp", "json"), "seen", "modified")
    known = known.select("path", F.col("modified").alias("k_modified"), F.col("length").alias("k_length"))
    both = here.join(known, "path", "full")
    changed = both.where("(length is not null and (k_length is null or length <> k_length or modified <> k_modified)) or (length is null and k_length >= 0)")
    new = changed.select("path", F.coalesce("modified", "k_modified").alias("modified"), F.coalesce("length", F.lit(-1)).alias("length"), F.current_timestamp().alias("seen"))
    rows = new.collect()  # one row per changed file
    if rows:
        spark.createDataFrame(rows, VERSION + ", seen timestamp").coalesce(1).write.mode("append").json(f"{root}/versions")
    return len(rows)


def process(batch: DataFrame, batch_id: int, root: str) -> None:
    """Rows and manifest of one micro batch; running it again gives the same state."""
    spark = batch.sparkSession
    versions = batch.collect()  # one row per announced file
    paths = sorted({r["path"] for r in versions if r["length"] > 0})
    tables = read_files(spark, paths, second="latin-1", strict=False)[0] if paths else []
    address = F.regexp_replace("_file", "^file:/+", "file:/")
    parts = [
        t.rows.select(
            F.url_decode(F.replace(address, F.lit("+"), F.lit("%2B"))).alias("_path"),
            F.map_from_arrays(F.array(*map(F.lit, t.names)), F.array(*[F.col(f"`{n}`") for n in t.names])).alias("_row"),
            F.lit(batch_id).cast("long").alias("_batch"),
        )
        for t in tables
    ]
    rows = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], ROWS)
    rows.write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")
    manifest = spark.createDataFrame([(r["path"], r["modified"], r["length"], batch_id, r["seen"]) for r in versions], VERSION + ", _batch long, seen timestamp")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/batch={batch_id}")


def watch_once(spark: SparkSession, folder: str, root: str) -> None:
    """Take what changed in ``folder`` since the last call into the state under ``root``, then stop."""
    announce(spark, folder, root)
    spark.createDataFrame([], VERSION + ", seen timestamp").write.mode("append").json(f"{root}/versions")  # the folder exists from the first call on
    stream = spark.readStream.schema(VERSION + ", seen timestamp").json(f"{root}/versions")
    query = stream.writeStream.foreachBatch(lambda df, n: process(df, n, root)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, root: str, file_type: str = "listings", weight: float = 1.0, ref_year: int | None = None) -> DataFrame:
    """The table as the last versions of the files give it: typed, with derived features, tagged ``_source = '<type>/<file>'``."""
    manifest = _last(_stored(spark, f"{root}/manifest", VERSION + ", _batch long, seen timestamp"), "seen", "_batch")
    live = manifest.where("length >= 0").select(F.regexp_replace("path", "^file:/+", "file:/").alias("l_path"), F.col("_batch").alias("l_batch"))
    rows = _stored(spark, f"{root}/rows", ROWS)
    rows = rows.join(live, (F.col("_path") == F.col("l_path")) & (F.col("_batch") == F.col("l_batch")), "left_semi")
    names = sorted(r["k"] for r in rows.select(F.explode(F.map_keys("_row")).alias("k")).distinct().collect())  # column names
    source = F.concat(F.lit(f"{file_type}/"), F.element_at(F.split("_path", "/"), -1))
    wide = rows.select(*[F.col("_row")[n].alias(n) for n in names], source.alias("_source"), F.lit(file_type).alias("_file_type"), F.lit(float(weight)).alias("_sample_weight"))
    return add_derived_features(clean_numeric(wide), ref_year)
