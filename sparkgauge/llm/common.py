"""Shared plumbing of the training-data operators: table access, shared scratch tables, bounded model broadcast."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from .. import scratch

#: White space as the operators' contracts define it.
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table ``table`` under ``sf_dir``, by whatever file system Spark knows it."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return scratch.path(spark, name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, and survives lost executors."""
    return scratch.materialize(df, name)


#: Keys that are salted, at most: those with more than one in HOT of all rows. So their list has a bounded size, and no
#: part of a key, salted or not, has more than that share of all rows (or ``least`` rows).
HOT = 20_000


def salted_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, by: str, least: int = 256, how: str = "inner", also: tuple[str, ...] = (), merge: bool = False) -> DataFrame:
    """``left`` joined with ``right`` (one row for each ``key`` and ``also``), a hot key's rows dealt by a hash of ``by`` to as
    many parts as its count asks for.

    ``counts`` (``key``, _rows) tells how many rows of ``left`` a key has; it is read twice, so it should be a written table.
    A part is meant to have max(``least``, all rows / HOT) rows; a key with more of them is hot.
    ``merge``: both sides are shuffled whatever their sizes, so that costs grow evenly with the input.
    """
    target = max(least, -(-(counts.agg(F.sum("_rows")).first()[0] or 0) // HOT))
    hot = counts.where(F.col("_rows") > target).select(key, F.ceil(F.col("_rows") / target).cast("int").alias("_parts"))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by, F.lit(41)), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    spread = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(spread.hint("merge") if merge else spread, [key, *also, "_salt"], how).drop("_salt")


def whole(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, whatever their names; ``select("x.*")`` of such a struct gives them back."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _has_map(kind.elementType)


def one_of_each(rows: DataFrame, keys: list[str], whole: str) -> DataFrame:
    """One row a key (``keys``, ``whole``): of several the one whose struct ``whole`` has the smallest hash. The choice
    doesn't depend on the order of rows, and repeated rows are combined before the shuffle. Maps, which can't be hashed,
    are taken as JSON."""
    hashed = F.xxhash64(F.to_json(whole) if _has_map(rows.schema[whole].dataType) else whole)
    return rows.groupBy(*keys).agg(F.min_by(whole, hashed).alias(whole))


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; null where the column is null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def bounded_sample(df: DataFrame, key: str, limit: int, seed: int = 17) -> DataFrame:
    """At most ``limit`` rows of ``df``, in the order of a seeded hash of ``key``: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(limit)


def labelled_ids(labels: DataFrame, label: str, modulus: int, held_out: int, limit: int) -> DataFrame:
    """(doc_id, label) of at most ``limit`` training rows: those whose crc32(doc_id) mod ``modulus`` isn't ``held_out``.

    Rows with a null doc_id or label are left out; a doc_id with several labels gets the largest.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (crc_mod("doc_id", modulus) != held_out)
    )
    return bounded_sample(rows.groupBy("doc_id").agg(F.max("label").alias("label")), "doc_id", limit)


def sample_texts(docs: DataFrame, sample: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, label, _text) of each id of a bounded ``sample``: one row per id, however often ``docs`` has it.

    Of several texts the smallest is taken; null is empty. Ids that ``docs`` lacks are left out.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("_text").alias("_text"))


def schema(df: DataFrame, without: str, add: str) -> StructType:
    """The fields of ``df`` but one, and those of the DDL ``add``: what a function over Arrow batches returns."""
    return StructType([f for f in df.schema if f.name != without] + list(StructType.fromDDL(add)))


def release() -> None:
    """Give memory that Arrow and the C library hold but don't use back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over Arrow batches that gives memory back after each batch and at its end."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            release()

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(each(batches))
        finally:
            release()

    return wrapped
