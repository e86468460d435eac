"""Readers of delimited files and of file fingerprints; every file of a pattern is read by its own header."""

from __future__ import annotations

import csv
import datetime
import io
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import normalize
from ..functions.text import hashed_id

#: Columns of a file's rows: the canonical fields, and two headers that aren't aliases of any.
FIELDS = tuple(normalize.ALIASES)
OTHERS = {"poi_location": "poi location", "dated": "snapshot date"}
_ROWS = "_file string, file_hash string, _row long, payload map<string,string>, " + ", ".join(f"{c} string" for c in (*FIELDS, *OTHERS))
_BATCH = 8_192
#: Bytes of a file that Python gets as one value; Spark hands over as many at a time as fit its limit of a batch's bytes.
PIECE = 262_144


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with one header, the same in all, as text; ``rows`` reads files whose headers differ."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def places(header: list[str]) -> tuple[dict[str, int], dict[str, int]]:
    """(header to its place, canonical field or other header to its place) of one file; of equal headers the last counts."""
    at = {h: i for i, h in enumerate(header)}
    found = {field: at[h] for field, h in normalize.resolve_headers(header).items()}
    keys = {normalize.clean_key(h): i for h, i in at.items()}
    return at, found | {name: keys[key] for name, key in OTHERS.items() if key in keys}


class _Joined(io.RawIOBase):
    """A file's pieces, one after another, as a stream; only the piece at hand is held."""

    def __init__(self, pieces: Iterator[pa.Buffer]):
        self.pieces, self.rest = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, to: memoryview) -> int:
        while not self.rest:
            if (piece := next(self.pieces, None)) is None:
                return 0
            self.rest = memoryview(piece).cast("B")
        n = min(len(to), len(self.rest))
        to[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = (piece for batch in batches for piece in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True))
    # a file's pieces come together and in order, the first is number 0
    files = itertools.accumulate(pieces, lambda last, piece: (last[0] + (piece[2] == 0), piece), initial=(0, None))
    for (_, path, digest), parts in itertools.groupby(itertools.islice(files, 1, None), lambda f: (f[0], *f[1][:2])):
        reader = csv.reader(io.TextIOWrapper(io.BufferedReader(_Joined(part[3].as_buffer() for _, part in parts)), "utf-8-sig", "replace", newline=""))
        header = next((r for r in reader if r), [])
        at, named = places(header)
        start, rows = 1, []
        for row in (r for r in reader if r):
            rows.append(row)
            if len(rows) == _BATCH:
                yield _batch(path, digest, start, rows, at, named)
                start, rows = start + len(rows), []
        if rows:
            yield _batch(path, digest, start, rows, at, named)


def _batch(path: str, digest: str, start: int, rows: list[list[str]], at: dict[str, int], named: dict[str, int]) -> pa.RecordBatch:
    n, text = len(rows), pa.string()
    column = lambda i: pa.array([(r[i] or None) if i < len(r) else None for r in rows], text)
    maps = pa.array([[(h, (r[i] or None) if i < len(r) else None) for h, i in at.items()] for r in rows], pa.map_(text, text))
    fields = [column(named[c]) if c in named else pa.nulls(n, text) for c in (*FIELDS, *OTHERS)]
    return pa.RecordBatch.from_arrays([pa.array([path] * n, text), pa.array([digest] * n, text), pa.array(range(start, start + n), pa.int64()), maps, *fields], names=["_file", "file_hash", "_row", "payload", *FIELDS, *OTHERS])


def rows(spark: SparkSession, pattern: str) -> DataFrame:
    """The rows of all CSV files of a pattern, each file by its own header: columns may stand in any order, be missing or
    go by any alias.

    Besides the canonical fields as text there are ``_file`` (the whole path), file_hash, ``_row`` (1 is the file's first
    data row), payload (the row's values by the file's own headers), poi_location and dated (a header "snapshot date").
    Empty values are null; blank lines aren't rows; what lies beyond the header is left out. Files are read where Spark
    reads them, by any file system it knows, one task a file (2 GB at most), as quoted values may hold line ends. Python
    gets a file in pieces, and never holds it whole.
    """
    found = spark.read.format("binaryFile").load(pattern).where("length > 0").select("path", F.sha2("content", 256).alias("file_hash"), "content", "length")
    numbered = found.withColumn("no", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / PIECE).cast("int"))))
    return numbered.select("path", "file_hash", "no", F.substring("content", F.col("no") * PIECE + 1, F.lit(PIECE))).mapInArrow(_parsed, _ROWS)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_hash, file_size_bytes) of the files of a pattern; files are hashed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("file_hash"), F.col("length").alias("file_size_bytes"))


def name_date(path: Column | str) -> Column:
    """Year and month in a file's name (not in its folders), with day 1; else null."""
    found = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{4})[_-](\d{2})(?!\d)", 0)
    return F.try_to_date(F.concat(F.translate(found, "_", "-"), F.lit("-01")), "yyyy-MM-dd")


def snapshot_id(market: str, date: Column | str) -> Column:
    return F.concat(F.lit(f"snap_{market.lower()}_"), F.coalesce(F.date_format(date, "yyyy_MM_dd"), F.lit("undated")))


def snapshots(spark: SparkSession, pattern: str, market: str) -> tuple[DataFrame, DataFrame]:
    """(raw rows, snapshots) of the CSV files of a pattern.

    A file's date is the first that its column "snapshot date" has, else the one in its name; files without any make a
    snapshot without a date. Ids are market and date, so files of one date make one snapshot, and files of one name in
    different folders stay apart. Raw rows are those of ``rows`` (read once and written) with snapshot_id, snapshot_date
    and ``_copy``, which tells files of equal content apart. Snapshots have market, snapshot_id, snapshot_date,
    row_count, the sorted paths (the first is ``_file``), their size, and a hash of the files' hashes: the file's own
    where there is one. A file with a header only counts with 0, one of no bytes is no file.
    """
    raw = scratch.materialize(rows(spark, pattern), "csv-rows")
    dates = raw.groupBy("_file").agg(F.min_by(normalize.date("dated"), F.when(normalize.date("dated").isNotNull(), F.col("_row"))).alias("date"), F.count("*").alias("row_count"))
    found = fingerprints(spark, pattern).withColumnRenamed("path", "_file").join(dates, "_file", "left")
    found = found.withColumns({"snapshot_date": F.coalesce("date", name_date("_file")), "row_count": F.coalesce("row_count", F.lit(0))}).withColumn("snapshot_id", snapshot_id(market, "snapshot_date"))
    again = Window.partitionBy("snapshot_id", "file_hash").orderBy("_file")
    found = scratch.materialize(found.withColumn("_copy", F.row_number().over(again)), "csv-files")
    hashes = F.array_sort(F.collect_list("file_hash"))
    per_id = found.groupBy("snapshot_id", "snapshot_date").agg(
        F.sum("row_count").alias("row_count"), F.array_sort(F.collect_list("_file")).alias("files"), F.sum("file_size_bytes").alias("file_size_bytes"),
        F.when(F.count("*") == 1, F.first("file_hash")).otherwise(F.sha2(F.array_join(hashes, " "), 256)).alias("file_hash"),
    )
    raw = raw.join(found.select("_file", "snapshot_id", "snapshot_date", "_copy"), "_file")
    return raw, per_id.withColumns({"_file": F.col("files")[0], "market": F.lit(market)})


def manual_snapshot(spark: SparkSession, path: str, market: str, today: datetime.date) -> tuple[DataFrame, DataFrame]:
    """One file as a snapshot dated by its first row's last update, else ``today`` (UTC, given by the caller)."""
    raw = scratch.materialize(rows(spark, path), "csv-rows")
    first = raw.agg(F.min_by("last_updated_date", "_row").alias("updated"), F.count("*").alias("row_count"), F.first("file_hash").alias("file_hash"), F.first("_file").alias("_file"))
    dated = first.withColumn("snapshot_date", F.coalesce(normalize.date("updated"), F.lit(today))).withColumn("snapshot_id", snapshot_id(market, "snapshot_date")).drop("updated")
    date, name = dated.select("snapshot_date", "snapshot_id").first()
    return raw.withColumns({"snapshot_id": F.lit(name), "snapshot_date": F.lit(date), "_copy": F.lit(1)}), dated.withColumn("market", F.lit(market))


def normalized(raw: DataFrame, market: str, map_poi_location: bool = False, vote_dates: bool = False) -> DataFrame:
    """Normalized records of rows with ``snapshot_id``, ``snapshot_date`` and ``_file``.

    A row of ``snapshots`` goes by its file's hash and its number in the file. Other rows, which have no number, go by a
    hash of their content; those that are equal in every column get their number among each other, so all of them stay. With ``vote_dates`` each
    file's date columns decide whether the day or the month comes first; that reads the rows twice.
    """
    if {"_row", "_copy", "file_hash"} <= set(raw.columns):
        numbered = raw.withColumn("_raw_id", hashed_id("raw", "file_hash", "_copy", "_row"))
    else:
        columns = [c for c in raw.columns if c not in ("snapshot_id", "snapshot_date")]
        found = raw.withColumn("_content", hashed_id("raw", *(f"`{c}`" for c in columns)))
        found = found.withColumn("_again", F.row_number().over(Window.partitionBy("snapshot_id", "_content").orderBy("_file")))
        numbered = found.withColumn("_raw_id", F.concat_ws("_", "_content", "_again")).drop("_content", "_again")
    return normalize.normalize(numbered, market, F.col("snapshot_id"), F.col("snapshot_date"), "_raw_id", map_poi_location, ("_file",) if vote_dates else ())


def discovered(listing: DataFrame, report: str) -> DataFrame:
    """Documents of a listing (name, url, published) whose name contains ``report``, newest first. Fetching is the caller's."""
    return listing.where(F.lower("name").contains(report.lower())).orderBy(F.desc("published"), "name")

