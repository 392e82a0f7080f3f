"""Folder sources (S3): every CSV file of the ads/sold folders as one tagged table."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuelens.operators.clean import clean_numeric
from valuelens.operators.features import add_derived_features
from valuelens.sources.csv_scan import read_files
from valuelens.sources.manage import union_sources

# Fixed values from the reference: folder -> (file type, sample weight).
FOLDERS = {"ads": ("listings", 1.0), "sold": ("sold", 3.0)}
PROBLEMS = "source string, reason string"


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> list[str]:
    """File paths of a folder, through Spark's own file listing; none if there is no such folder."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).inputFiles()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(map(unquote, found))


def _name(uri: str) -> str:
    """File name of a file's address."""
    return unquote(uri.rsplit("/", 1)[-1])


def load_folders(spark: SparkSession, base: str, ref_year: int | None = None) -> tuple[DataFrame | None, DataFrame]:
    """S3: (table, problems).  All files of a folder are read in one scan, with one typed plan per distinct header.

    Rows are cleaned, derived and tagged ``_source = '<type>/<file>'``, and the tables are united by name.  A file that
    holds no table (empty, ragged, a header alone) is a row of ``problems``; a missing folder is none.
    """
    frames, problems = [], []
    for folder, (ftype, weight) in FOLDERS.items():
        paths = list_files(spark, f"{base.rstrip('/')}/{folder}")
        if not paths:
            continue
        tables, bad = read_files(spark, paths, second="latin-1")
        name = F.element_at(F.split("_file", "/"), -1)
        seen = {_name(f.path) for t in tables for f in t.files} | {_name(p) for p, _ in bad}
        problems += [(f"{ftype}/{_name(p)}", reason) for p, reason in bad]
        problems += [(f"{ftype}/{p.rsplit('/', 1)[-1]}", "the file is empty") for p in paths if p.rsplit("/", 1)[-1] not in seen]
        for t in tables:
            tagged = t.rows.withColumns({"_source": F.concat(F.lit(f"{ftype}/"), F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))), "_file_type": F.lit(ftype), "_sample_weight": F.lit(float(weight))})
            tags = ["_source", "_file_type", "_sample_weight"]
            frames.append(add_derived_features(clean_numeric(tagged.select(*[f"`{n}`" for n in t.names], *tags)), ref_year))
    table = union_sources(frames) if frames else None
    return table, spark.createDataFrame(problems, PROBLEMS)


def file_name_col() -> F.Column:
    return F.col("_metadata.file_name")
