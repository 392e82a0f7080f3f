"""Quoted CSV files of any size and any number, read by many tasks.

Files are scanned as lines in byte ranges, as Spark splits them.  A line break inside quotes
ends no record, and whether a range starts inside quotes depends on all ranges before it:
one pass reports the parity of quotes per range (with what tells the encoding, in the
same scan), a prefix sum over a file's ranges gives each range its state, and a second pass cuts
records at the breaks outside quotes.  A record that crosses ranges leaves a piece in each; pieces
meet by the range in which the record began.  Records are parsed by ``from_csv``, one plan per distinct header,
whatever the number of files.

Encoding per file: UTF-8 (a byte order mark is dropped) if all lines are valid, else windows-1251 unless byte 0x98 occurs,
else Latin-1.  Line ends are ``\\n`` or ``\\r\\n``; inside quotes they stay as they are.  What reaches the driver is a row per range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuelens.session import ship_package

DELIMITERS = (",", ";", "\t", "|")  # fixed values from the reference
BOM = b"\xef\xbb\xbf"


@dataclass(frozen=True)
class FileInfo:
    path: str
    sep: str
    encoding: str
    open_ranges: tuple[int, ...]  # starts of the ranges that begin inside quotes


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, range_start, place, line): raw lines; place follows the file inside a range."""
    d = spark.read.option("lineSep", "\n").text(paths)
    return d.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range_start"), F.monotonically_increasing_id().alias("place"), F.col("value").cast("binary").alias("line"))


def sniff(first: bytes, candidates: Sequence[str] = DELIMITERS) -> str:
    """The candidate that occurs most often in the header line (the first one on ties, ',' if there is none)."""
    counts = [(first.count(c.encode()), -i, c) for i, c in enumerate(candidates)]
    best = max(counts)
    return best[2] if best[0] else ","


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, range_start, quotes, odd, undefined, place, first) per range of a batch."""
    for b in batches:
        found: dict[tuple, list] = {}
        for file, start, place, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
            had = found.get((file, start))
            if had is None:
                had = found[file, start] = [0, 0, 0, place, line]
            had[0] += line.count(b'"')
            if not line.isascii():
                had[2] += b"\x98" in line
                try:
                    line.decode()
                except UnicodeDecodeError:
                    had[1] += 1
        rows = [(*k, *v) for k, v in found.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "range_start", "quotes", "odd", "undefined", "place", "first"])


def scan(spark: SparkSession, paths: str | Sequence[str], second: str = "cp1251") -> list[FileInfo]:
    """What the first pass finds of each file with a line; ``second`` is the encoding after UTF-8."""
    ship_package(spark)
    told = _lines(spark, paths).mapInArrow(_tell, "file string, range_start long, quotes long, odd long, undefined long, place long, first binary")
    per = told.groupBy("file", "range_start").agg(
        (F.sum("quotes") % 2).alias("parity"), F.sum("odd").alias("odd"), F.sum("undefined").alias("undefined"), F.min_by("first", "place").alias("first")
    )
    files: dict[str, list] = {}
    for r in per.collect():  # one row per byte range
        files.setdefault(r["file"], []).append(r)
    out = []
    for path, ranges in sorted(files.items()):
        ranges.sort(key=lambda r: r["range_start"])
        inside, opened = 0, []
        for r in ranges:
            if inside:
                opened.append(r["range_start"])
            inside = (inside + r["parity"]) % 2
        encoding = "utf-8" if not sum(r["odd"] for r in ranges) else second if second != "cp1251" or not sum(r["undefined"] for r in ranges) else "latin-1"
        out.append(FileInfo(path, sniff(bytes(ranges[0]["first"])), encoding, tuple(opened)))
    return out


# ------------------------------------------------------------------ records
_RECORD = "file string, range_start long, place long, kind int, record string, fields int"


def _closed(record: bytes, info: FileInfo, first: bool) -> tuple[str, int]:
    """A record's text and how many fields it has."""
    if first and record.startswith(BOM):
        record = record[len(BOM) :]
    if record.endswith(b"\r"):
        record = record[:-1]
    plain = record if b'"' not in record else b"".join(record.split(b'"')[::2])
    return record.decode(info.encoding, "replace"), plain.count(info.sep.encode()) + 1


def _cut(files: dict[str, FileInfo]):
    """Records of kind 0; pieces of records that cross ranges: 1 begins one, 2 goes on through a range, 3 ends it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, inside, leading = None, [], False, False
        out: list[tuple] = []

        def end_range() -> None:
            """What is open when a range ends: the begin of a record, or the middle of one."""
            if held:
                out.append((at[0], at[1], held[0][0], 2 if leading else 1, b"\n".join(x for _, x in held), 0))
                held.clear()

        def flush() -> pa.RecordBatch:
            rows = []
            for file, start, place, kind, record, _ in out:
                info = files[file]
                if kind:  # bytes as Latin-1 until the pieces are one
                    rows.append((file, start, place, kind, record.decode("latin-1"), 0))
                else:
                    text, fields = _closed(record, info, start == 0 and place == firsts.get(file))
                    rows.append((file, start, place, 0, text, fields))
            out.clear()
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32())
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in _RECORD.split(", ")])

        firsts: dict[str, int] = {}
        for b in batches:
            for file, start, place, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, start) != at:
                    end_range()
                    at = (file, start)
                    inside = leading = start in files[file].open_ranges
                    if start == 0:
                        firsts[file] = place
                held.append((place, line))
                inside ^= line.count(b'"') % 2 == 1
                if not inside:
                    if leading or len(held) > 1 or held[0][1].strip():
                        out.append((file, start, held[0][0], 3 if leading else 0, b"\n".join(x for _, x in held), 0))
                    held.clear()
                    leading = False
            yield flush()
        end_range()
        yield flush()

    return run


def records(spark: SparkSession, files: Sequence[FileInfo], paths: str | Sequence[str]) -> DataFrame:
    """(file, range_start, place, record, fields): one row per record of ``paths``, the header among them; (range_start, place) follow a file."""
    ship_package(spark)
    by_path = {f.path: f for f in files}
    cut_rows = _lines(spark, paths).mapInArrow(_cut(by_path), _RECORD)
    whole = cut_rows.where("kind = 0").drop("kind")
    pieces = cut_rows.where("kind > 0")

    def joined(t: pa.Table) -> pa.Table:
        """The crossing records of one file: as many as ranges at most."""
        rows = sorted(zip(t.column("range_start").to_pylist(), t.column("kind").to_pylist(), t.column("place").to_pylist(), t.column("record").to_pylist(), strict=True), key=lambda r: (r[0], {3: 0, 2: 1, 1: 2}[r[1]]))
        file, out, now = t.column("file")[0].as_py(), [], []
        for start, kind, place, text in rows:
            now.append((start, place, text.encode("latin-1")))
            if kind == 3:
                record, fields = _closed(b"\n".join(x for _, _, x in now), by_path[file], now[0][0] == 0)
                out.append((file, now[0][0], now[0][1], record, fields))
                now = []
        if now:  # a quote that nothing closes: the rest of the file is one record
            record, fields = _closed(b"\n".join(x for _, _, x in now), by_path[file], now[0][0] == 0)
            out.append((file, now[0][0], now[0][1], record, fields))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32())
        return pa.table({c: pa.array([r[i] for r in out], k) for i, (c, k) in enumerate(zip(("file", "range_start", "place", "record", "fields"), kinds, strict=True))})

    return whole.union(pieces.groupBy("file").applyInArrow(joined, "file string, range_start long, place long, record string, fields int"))


def header_names(fields: Sequence[str | None]) -> list[str]:
    """Column names as the CSV reader gives them: blank ones by place, repeated ones with their place."""
    low = [(f or "").lower() for f in fields]
    return [f"_c{i}" if not f else f"{f}{i}" if low.count(f.lower()) > 1 else f for i, f in enumerate(fields)]


@dataclass
class CsvTable:
    """Files that share a header and a delimiter."""

    names: list[str]
    files: list[FileInfo]
    rows: DataFrame  # the columns (strings) and _file, _range, _place


def read_files(spark: SparkSession, paths: str | Sequence[str], second: str = "cp1251", *, sep: str | None = None, strict: bool = True) -> tuple[list[CsvTable], list[tuple[str, str]]]:
    """(tables, problems): the files' records per distinct header, and (file, reason) of those that hold no table.

    A file with a record of more fields than its header is no table if ``strict``; else the further fields are left out.
    """
    files = scan(spark, paths, second)
    if sep is not None:
        files = [replace(f, sep=sep) for f in files]
    if not files:
        return [], []
    by_path = {f.path: f for f in files}
    every = records(spark, files, paths)
    heads = every.groupBy("file").agg(F.min(F.struct("range_start", "place", "record", "fields")).alias("h"), F.max("fields").alias("most")).collect()  # one row per file
    groups: dict[tuple, list[FileInfo]] = {}
    problems = []
    for r in sorted(heads, key=lambda r: r["file"]):
        if strict and r["most"] > r["h"]["fields"]:
            problems.append((r["file"], f"a record has {r['most']} fields, the header {r['h']['fields']}"))
        else:
            info = by_path[r["file"]]
            groups.setdefault((info.sep, r["h"]["record"], r["h"]["fields"]), []).append(info)
    starts = {r["file"]: r["h"]["place"] for r in heads}
    out = []
    for (sep, head, width), own in groups.items():
        options = {"sep": sep, "quote": '"', "escape": '"'}
        strings = ", ".join(f"c{i} string" for i in range(width))
        names = header_names(list(spark.range(1).select(F.from_csv(F.lit(head), strings, options).alias("h")).first()["h"]))
        firsts = spark.createDataFrame([(f.path, starts[f.path]) for f in own], "f_file string, f_place long")  # one row per file
        rows = every.join(F.broadcast(firsts), F.col("file") == F.col("f_file")).where((F.col("range_start") > 0) | (F.col("place") != F.col("f_place")))
        parsed = rows.select("file", "range_start", "place", F.from_csv("record", strings, options).alias("r"))
        out.append(CsvTable(names, own, parsed.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)], F.col("file").alias("_file"), F.col("range_start").alias("_range"), F.col("place").alias("_place"))))
    return out, problems
