"""Two plans for one result held against each other: sums of hashes by bucket first, rows only where these differ.

A bucket's sums don't depend on the order of rows, so each side is one aggregate with partial sums before the shuffle, and
what meets is one row a bucket. Only rows of buckets that differ are joined by key, and named.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import differs

#: Buckets: what is compared first, and sent to every task at most.
BUCKETS = 16_384


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in keys)), F.lit(buckets)).cast("int")


def _hash(keys: Sequence[str], columns: Sequence[str]) -> Column:
    # a null must not hash as if its column weren't there
    return F.xxhash64(*(x for c in (*keys, *columns) for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())))


def checksums(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, rows, low, high, mixed): the number of rows of each bucket of keys, and sums of their hashes that any order
    of rows gives alike: of both halves, and by exclusive or."""
    h = _hash(keys, columns)
    half = lambda c: c.bitwiseAND(F.lit((1 << 32) - 1))
    return rows.groupBy(_bucket(keys, buckets).alias("bucket")).agg(
        F.count("*").alias("rows"), F.sum(half(h)).alias("low"), F.sum(half(F.shiftrightunsigned(h, 32))).alias("high"), F.bit_xor(h).alias("mixed")
    )


def differing_buckets(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """(bucket, left_rows, right_rows) of the buckets whose rows aren't the same; no row for equal tables."""
    one, two = (checksums(df, keys, columns, buckets) for df in (left, right))
    sums = ("rows", "low", "high", "mixed")
    both = one.select("bucket", F.struct(*sums).alias("l")).join(two.select("bucket", F.struct(*sums).alias("r")), "bucket", "full_outer")
    return both.where(differs("l", "r")).select("bucket", F.coalesce("l.rows", F.lit(0)).alias("left_rows"), F.coalesce("r.rows", F.lit(0)).alias("right_rows"))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The keys of two tables whose rows differ: keys, verdict, left_rows, right_rows and the differing columns.

    The verdict is "only_left", "only_right", "other_values" or, where a key has several rows on a side, "other_rows" if
    their rows aren't the same whatever their order. ``columns`` are compared (all that aren't keys, by default); null is a
    value like any other, in keys too. Equal tables give no row. Both sides are read twice, the second time for the
    buckets that differ; at most ``buckets`` numbers go to the tasks.
    """
    columns = [c for c in left.columns if c not in keys] if columns is None else list(columns)
    named = lambda cs: [F.col(f"`{c}`") for c in cs]
    left, right = (df.select(*named([*keys, *columns])) for df in (left, right))
    found = F.broadcast(differing_buckets(left, right, keys, columns, buckets).select("bucket"))

    def side(df: DataFrame) -> DataFrame:
        open_ = df.withColumn("bucket", _bucket(keys, buckets)).join(found, "bucket", "left_semi")
        # a key's rows in an order of their own, so that repeated ones compare as a whole
        return open_.groupBy(F.struct(*named(keys)).alias("_key")).agg(F.array_sort(F.collect_list(F.struct(_hash([], columns).alias("_hash"), *named(columns)))).alias("_rows"))

    one, two = side(left).select("_key", F.col("_rows").alias("_left")), side(right).select(F.col("_key").alias("_other"), F.col("_rows").alias("_right"))
    both = one.join(two, F.col("_key").eqNullSafe(F.col("_other")), "full_outer").where(differs("_left", "_right"))
    many = (F.size("_left") > 1) | (F.size("_right") > 1)
    verdict = F.when(F.col("_right").isNull(), "only_left").when(F.col("_left").isNull(), "only_right").when(many, "other_rows").otherwise("other_values")
    unequal = F.array(*(F.when(differs(F.col("_left")[0][c], F.col("_right")[0][c]), F.lit(c)) for c in columns)) if columns else F.array().cast("array<string>")
    count = lambda c: F.coalesce(F.size(c), F.lit(0))
    out = both.select(F.coalesce("_key", "_other").alias("_key"), verdict.alias("verdict"), F.when(F.col("_left").isNotNull(), count("_left")).otherwise(0).alias("left_rows"), F.when(F.col("_right").isNotNull(), count("_right")).otherwise(0).alias("right_rows"),
                      F.when(verdict == "other_values", F.array_compact(unequal)).otherwise(F.array().cast("array<string>")).alias("columns"))
    return out.select("_key.*", "verdict", "left_rows", "right_rows", "columns")


def figures(rows: DataFrame, check: str, by: Sequence[Column], value: Column) -> DataFrame:
    """(metric, value): an aggregate of ``rows`` for each group, the metric named by the check and the group."""
    group = [F.coalesce(c.cast("string"), F.lit("")).alias(f"_{i}") for i, c in enumerate(by)]
    found = rows.groupBy(*group).agg(value.cast("double").alias("value"))
    return found.select(F.concat_ws("/", F.lit(check), *(f"_{i}" for i in range(len(by)))).alias("metric"), "value")


def record_figures(records: DataFrame) -> DataFrame:
    """What the independent checks ask of records (snapshot_id, queue_id, name, status, fuel, mw): rows and rows without an id
    or name of each snapshot, statuses, active capacity by fuel, and ids that each pair of snapshots shares."""
    s = F.col("snapshot_id")
    nameless = F.coalesce(F.col("queue_id"), F.lit("")) == ""
    nameless = nameless | (F.coalesce(F.col("name"), F.lit("")) == "")
    ids = records.where("queue_id is not null").select("snapshot_id", "queue_id").distinct()
    shared = ids.alias("a").join(ids.alias("b"), F.expr("a.queue_id = b.queue_id AND a.snapshot_id < b.snapshot_id")).select(F.concat("a.snapshot_id", F.lit(" & "), "b.snapshot_id").alias("pair"))
    return (
        figures(records, "row_count", [s], F.count("*")).unionByName(figures(records, "missing_key_fields", [s], F.count_if(nameless)))
        .unionByName(figures(records, "status_count", [s, F.col("status")], F.count("*")))
        .unionByName(figures(records.where("status = 'Active'"), "active_capacity_by_fuel", [s, F.col("fuel")], F.round(F.sum("mw"), 2)))
        .unionByName(figures(shared, "queue_id_overlap", [F.col("pair")], F.count("*")))
    )
