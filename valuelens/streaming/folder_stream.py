"""Folder watching as Structured Streaming.

The reference reloads its data folders whenever a file's mtime changes and
replaces the whole table.  Here a file-source stream over the folder with a
fixed schema tags each row with ``_source = <folder>/<file name>`` and
appends to a Parquet file sink; each ``availableNow`` run takes exactly the
files that arrived since the last run (the checkpoint remembers the rest), and
the file sink's commit log makes every batch exactly-once, so a lost executor
or a retried batch never duplicates rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def ingest_once(spark: SparkSession, folder: str, schema: StructType | str, sink: str, checkpoint: str, *,
                folder_name: str = "ads", file_type: str = "listings", weight: float = 1.0, sep: str = ",") -> None:
    """Process every file not seen before, then stop (trigger availableNow)."""
    stream = (spark.readStream.schema(schema).option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
              .option("multiLine", True).option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT).csv(folder))
    tagged = stream.select("*", F.concat(F.lit(f"{folder_name}/"), F.col("_metadata.file_name")).alias("_source"),
                           F.lit(file_type).alias("_file_type"), F.lit(float(weight)).alias("_sample_weight"))
    q = (tagged.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).outputMode("append").start())
    q.awaitTermination()


def read_sink(spark: SparkSession, sink: str) -> DataFrame:
    """The ingested table (the sink's commit log decides which files count)."""
    return spark.read.parquet(sink)
