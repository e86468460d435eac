"""Tables in Parquet, and the ways of changing them that need no row-level updates."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Store:
    """Named tables under one root, one folder each. Keys that are null match each other.

    A table's folder has a folder a version (v1, v2, ...); the latest that Spark finished (its ``_SUCCESS`` is there) is the
    table. A rewrite reads one version and writes the next, so a failure leaves the table as it was. The version before
    stays for readers that began with it. One writer a table at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _version(self, table: str) -> int:
        """The number of the latest finished version, 0 without one."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = sorted((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), reverse=True)
        return next((n for n in numbers if exists(self.spark, f"{self.path(table, n)}/_SUCCESS")), 0)

    def path(self, table: str, version: int | None = None) -> str:
        """The folder of a version; of the latest, or of the first to be, where none is given."""
        return f"{self.root}/{table}/v{version or self._version(table) or 1}"

    def has(self, table: str) -> bool:
        return self._version(table) > 0

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table))

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path(table))

    def overwrite(self, table: str, rows: DataFrame) -> None:
        """Replace the table by rows that may be read from it. What a failed attempt left is overwritten."""
        now = self._version(table)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(self.path(table, now + 1))
        if now > 1:
            _delete(self.spark, self.path(table, now - 1))

    def _outside(self, table: str, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        old, new = self.read(table).alias("o"), rows.select(*keys).distinct().alias("n")
        match = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
        return old.join(new, match, "left_anti")

    def upsert(self, table: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """Rows of the same keys are replaced, others added; of new rows with equal keys one stays."""
        rows = rows.dropDuplicates(list(keys))
        self.overwrite(table, self._outside(table, rows, keys).unionByName(rows, allowMissingColumns=True) if self.has(table) else rows)

    def insert_absent(self, table: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """Add the rows whose keys aren't there yet; a second call adds nothing."""
        rows = rows.dropDuplicates(list(keys))
        if self.has(table):
            new, old = rows.alias("n"), self.read(table).select(*keys).distinct().alias("o")
            rows = scratch.materialize(new.join(old, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys], "left_anti"), table)
        self.append(table, rows)

    def replace_slice(self, table: str, rows: DataFrame, partitions: Sequence[str]) -> None:
        """Replace the partitions that occur in ``rows``; the others aren't read or written. Spark moves a slice in at the
        job's end, inside the standing version: that is not one step, and a failure then is mended by writing it again."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(self.path(table))

    def delete(self, table: str, keys: DataFrame) -> None:
        """Drop the rows whose key columns occur in ``keys``."""
        if self.has(table):
            self.overwrite(table, self._outside(table, keys, keys.columns))

    def update(self, table: str, changes: DataFrame, keys: Sequence[str]) -> None:
        """Set the other columns of ``changes`` where keys match; nothing is added."""
        columns = [c for c in changes.columns if c not in keys]
        new = changes.select(*keys, F.struct(*columns).alias("_new")).dropDuplicates(list(keys))
        joined = self.read(table).join(new, list(keys), "left")
        order = self.read(table).columns
        self.overwrite(table, joined.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in order)))

    def drop(self, table: str) -> None:
        _delete(self.spark, f"{self.root}/{table}")

    def reset(self) -> None:
        _delete(self.spark, self.root)

    def counts(self, tables: Sequence[str]) -> dict[str, int]:
        return {t: self.read(t).count() if self.has(t) else 0 for t in tables}

    def orphans(self, child: str, parent: str, key: str, parent_key: str | None = None) -> DataFrame:
        """Rows of ``child`` whose non-null ``key`` has no row in ``parent``: the check of a foreign key."""
        there = self.read(parent).select(F.col(parent_key or key).alias(key)).distinct()
        return self.read(child).where(F.col(key).isNotNull()).join(there, key, "left_anti")


def write_csv(rows: DataFrame, path: str, columns: Sequence[str], single: bool = False, file_rows: int = 0) -> None:
    """Chosen columns, in order, with a header; ``single`` makes one file, for reports only. With ``file_rows`` a task goes
    on in another file after so many rows, as a reader's task takes a file whole."""
    out = rows.select(*columns)
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').option("maxRecordsPerFile", file_rows).csv(path)


def upsert_manifest(path: str | Path, entry: Mapping[str, object], keys: Sequence[str] = ("source_name", "local_path", "snapshot_date", "file_hash_sha256")) -> list[dict]:
    """A JSON list of entries on the driver's disk: the one with the same keys is replaced, entries stay sorted by them."""
    path = Path(path)
    name = lambda e: [str(e.get(k) or "") for k in keys]
    old = json.loads(path.read_text()) if path.exists() else []
    rows = sorted([e for e in old if name(e) != name(entry)] + [dict(entry)], key=name)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(rows, indent=2, sort_keys=True, default=str) + "\n")
    return rows


def write_json(path: str | Path, value: object) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, sort_keys=True, default=str) + "\n")


def write_markdown(path: str | Path, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text.rstrip() + "\n")
