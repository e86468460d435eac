"""The latest fact before each of any number of requests, by key: an as-of join without a range join.

Facts and requests are put in one order per key; the last fact that is not null is carried along. So that a key with very
many rows isn't one sort, time is cut into stretches: each is ordered by itself, and starts from the last fact of those
before it, which is found from one row a stretch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def latest_before(
    requests: DataFrame, facts: DataFrame, keys: Sequence[str], at: str, time: str, values: Sequence[str], tie: Sequence[str] = (), inclusive: bool = False, stretch: int = DAY
) -> DataFrame:
    """``requests`` (all columns) with ``values`` of the latest row of ``facts`` of the same ``keys`` whose ``time`` is before
    ``at`` (``inclusive``: or equal); null where there is none.

    Of facts of one time the largest by ``tie``, then by values, counts. Times are dates or timestamps; ``stretch`` is in
    seconds and changes no result. Requests with a null key or time find nothing, facts with one are never found. Repeated
    requests come back each. ``values`` may not be columns of the requests, nor of a type that has no order.
    """
    key = F.struct(*(F.col(k) for k in keys)).alias("_key")
    known = lambda c: F.forall(F.array(*(F.col(k).isNotNull() for k in (*keys, c))), lambda x: x)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    part = lambda c: F.floor(micros(c) / (stretch * 1_000_000)).alias("_part")
    fact = F.struct(micros(time).alias("_t"), *(F.col(c).alias(f"_tie{i}") for i, c in enumerate(tie)), *(F.col(c).alias(f"_value{i}") for i, c in enumerate(values)))
    found = facts.where(known(time)).select(key, part(time), micros(time).alias("_at"), F.lit(1 if not inclusive else 0).alias("_turn"), fact.alias("_fact"))
    kind = found.schema["_fact"].dataType
    asked = requests.select(key, part(at), micros(at).alias("_at"), F.lit(0 if not inclusive else 1).alias("_turn"), F.lit(None).cast(kind).alias("_fact"), F.struct(*(F.col(f"`{c}`") for c in requests.columns)).alias("_request"))
    # the last fact of each stretch, carried to the stretches after it that hold anything
    last = found.groupBy("_key", "_part").agg(F.max("_fact").alias("_fact")).unionByName(asked.select("_key", "_part").distinct().withColumn("_fact", F.lit(None).cast(kind))).groupBy("_key", "_part").agg(F.max("_fact").alias("_fact"))
    before = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_key", "_part", F.lit(None).cast("long").alias("_at"), F.lit(-1).alias("_turn"), F.last("_fact", ignorenulls=True).over(before).alias("_fact")).where("_fact is not null")
    rows = asked.unionByName(found, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    upto = Window.partitionBy("_key", "_part").orderBy(F.asc_nulls_first("_at"), "_turn", "_fact").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("_found", F.last("_fact", ignorenulls=True).over(upto)).where("_request is not null")
    return out.select("_request.*", *(F.when(known(at), F.col(f"_found._value{i}")).alias(c) for i, c in enumerate(values)))
