"""Sample-aware metric rollups: one pass of grouping sets answers any number of requests, with fallback and abstention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hashed_id

#: Levels of scope, the narrowest first. National levels have no rows unless given.
LEVELS = ("county_fuel", "county_all_fuels", "market_fuel", "market_all", "lbnl_national_fuel", "lbnl_national_all")
LAST = LEVELS[-1]
#: Sample sizes of high and of medium confidence.
HIGH, MEDIUM, MIN_SAMPLE = 100, 30, 30


def latest_snapshot(records: DataFrame) -> DataFrame:
    """Each market's records of its latest snapshot (by date, then id)."""
    last = records.groupBy("market").agg(F.max(F.struct("snapshot_date", "snapshot_id")).alias("_last")).select("market", F.col("_last.snapshot_id").alias("snapshot_id"))
    # a row a market, sent to all tasks: dealt by market, all records of one would be one task
    return records.join(F.broadcast(last), ["market", "snapshot_id"])


def durations() -> Column:
    """Days from request to the end: of completed and withdrawn records with both dates, else null."""
    end = F.when(F.col("normalized_status") == "Completed", F.col("actual_cod")).when(F.col("normalized_status") == "Withdrawn", F.col("withdrawn_date"))
    return F.datediff(end, F.col("request_date"))


def scopes(records: DataFrame) -> DataFrame:
    """Unrounded measures of every scope of the latest snapshots: (market, county, fuel) at all four levels.

    Rows without a county or fuel count at the levels that don't name it. Percentiles are exact and interpolated.
    """
    rows = latest_snapshot(records).select(
        "market", "snapshot_id", "county", F.col("normalized_fuel_type").alias("fuel_type"), "normalized_status", F.coalesce("capacity_mw", F.lit(0.0)).alias("mw"), durations().alias("days")
    )
    is_ = lambda s: F.col("normalized_status") == s
    sets = [["market", "snapshot_id", *more] for more in (["county", "fuel_type"], ["county"], ["fuel_type"], [])]
    # two exact percentiles make one aggregation buffer: an array of both
    grouped = rows.groupingSets(sets, "market", "snapshot_id", "county", "fuel_type").agg(
        F.grouping("county").alias("_all_counties"), F.grouping("fuel_type").alias("_all_fuels"),
        F.count("*").alias("sample_n"), F.count_if(is_("Active")).alias("active_count"), F.coalesce(F.sum(F.when(is_("Active"), F.col("mw"))), F.lit(0.0)).alias("active_mw"),
        F.count_if(is_("Completed")).alias("completed_count"), F.count_if(is_("Withdrawn")).alias("withdrawn_count"), F.percentile("days", F.array(F.lit(0.5), F.lit(0.75))).alias("_p"),
    )
    level = F.when(F.col("_all_counties") == 0, F.when(F.col("_all_fuels") == 0, LEVELS[0]).otherwise(LEVELS[1])).otherwise(F.when(F.col("_all_fuels") == 0, LEVELS[2]).otherwise(LEVELS[3]))
    return grouped.select(
        "market", F.col("snapshot_id").alias("source_snapshot_id"), level.alias("fallback_level"), "county", "fuel_type", "sample_n", "active_count", "active_mw", "completed_count", "withdrawn_count",
        F.col("_p")[0].alias("median_duration_days"), F.col("_p")[1].alias("p75_duration_days"),
    )


def rollup(records: DataFrame, requests: DataFrame, min_sample_n: int = MIN_SAMPLE) -> DataFrame:
    """One row per request (request_id, market, county, fuel_type; the last two may be null): the narrowest scope with enough records.

    If none has enough, the row abstains: rates and durations are null, confidence is Insufficient, and the level is the
    last one, with no records. A market without any snapshot has scope_type "requested" and level "none".
    """
    wide = scopes(records)
    market_wide = latest_snapshot(records).groupBy("market").agg(F.first("snapshot_id").alias("_snapshot"))
    named = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    tries = requests.withColumn(
        "_try",
        F.explode(
            F.filter(
                F.array(
                    F.when(named("county") & named("fuel_type"), F.struct(F.lit(0).alias("rank"), F.lit(LEVELS[0]).alias("level"), F.col("county").alias("c"), F.col("fuel_type").alias("f"))),
                    F.when(named("county"), F.struct(F.lit(1).alias("rank"), F.lit(LEVELS[1]).alias("level"), F.col("county").alias("c"), F.lit(None).cast("string").alias("f"))),
                    F.when(named("fuel_type"), F.struct(F.lit(2).alias("rank"), F.lit(LEVELS[2]).alias("level"), F.lit(None).cast("string").alias("c"), F.col("fuel_type").alias("f"))),
                    F.struct(F.lit(3).alias("rank"), F.lit(LEVELS[3]).alias("level"), F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("f")),
                ),
                lambda x: x.isNotNull(),
            )
        ),
    ).select("request_id", "market", F.col("_try.rank").alias("_rank"), F.col("_try.level").alias("fallback_level"), F.coalesce("_try.c", F.lit("")).alias("_c"), F.coalesce("_try.f", F.lit("")).alias("_f"))
    keyed = wide.withColumns({"_c": F.coalesce("county", F.lit("")), "_f": F.coalesce("fuel_type", F.lit(""))})
    # a null county is a group of its own in the sets; requests never name it
    keyed = keyed.where(~((F.col("_c") == "") & F.col("fallback_level").startswith("county")) & ~((F.col("_f") == "") & F.col("fallback_level").isin(LEVELS[0], LEVELS[2])))
    # scopes are as many as places and fuels, requests may be any number: they stay where they are
    hits = tries.join(F.broadcast(keyed), ["market", "fallback_level", "_c", "_f"]).where(F.col("sample_n") >= min_sample_n)
    best = hits.withColumn("_turn", F.row_number().over(Window.partitionBy("request_id").orderBy("_rank"))).where("_turn = 1").drop("_turn", "_rank", "_c", "_f", "county", "market")
    asked = requests.select("request_id", "market", F.col("county").alias("_county"), F.col("fuel_type").alias("_fuel"))
    rows = asked.join(best.withColumnRenamed("fuel_type", "_scope_fuel"), "request_id", "left").join(F.broadcast(market_wide), "market", "left")
    met, known = F.col("fallback_level").isNotNull(), F.col("_snapshot").isNotNull()
    rate = lambda c: F.when(met, F.round(F.col(c) / F.col("sample_n"), 4))
    by_county = F.col("fallback_level").isin(*LEVELS[:2])
    return rows.select(
        "request_id", "market",
        F.when(met, F.when(by_county, "county").otherwise("market")).when(known, "lbnl_national").otherwise("requested").alias("scope_type"),
        F.when(met, F.when(by_county, F.col("_county")).otherwise(F.col("market"))).when(known, "US queues").otherwise(F.coalesce("_county", "market")).alias("scope_value"),
        F.when(met, F.col("_scope_fuel")).when(~known, F.col("_fuel")).alias("fuel_type"),
        F.coalesce("sample_n", F.lit(0)).alias("sample_n"), F.coalesce("active_count", F.lit(0)).alias("active_count"), F.coalesce("active_mw", F.lit(0.0)).alias("active_mw"),
        F.coalesce("completed_count", F.lit(0)).alias("completed_count"), F.coalesce("withdrawn_count", F.lit(0)).alias("withdrawn_count"),
        rate("completed_count").alias("completion_rate"), rate("withdrawn_count").alias("withdrawal_rate"), "median_duration_days", "p75_duration_days",
        F.when(~met, "Insufficient").when(F.col("sample_n") >= HIGH, "High").when(F.col("sample_n") >= MEDIUM, "Medium").otherwise("Low").alias("confidence"),
        F.when(met, F.col("fallback_level")).when(known, LAST).otherwise("none").alias("fallback_level"),
        F.coalesce("source_snapshot_id", "_snapshot").alias("source_snapshot_id"),
        F.when(~met, F.format_string("sample_n=0 is below min_sample_n=%d", F.lit(min_sample_n))).when(F.col("fallback_level") == LEVELS[0], "County and fuel reached the sample threshold.").otherwise(F.format_string("Rolled up to %s for the sample threshold.", "fallback_level")).alias("explanation"),
    ).withColumn("metric_id", hashed_id("met", "request_id", "source_snapshot_id", F.lit(min_sample_n)))


def all_requests(records: DataFrame) -> DataFrame:
    """A request for each distinct county and fuel of each market's latest snapshot."""
    pairs = latest_snapshot(records).select("market", "county", F.col("normalized_fuel_type").alias("fuel_type")).distinct()
    return pairs.withColumn("request_id", F.concat_ws("|", "market", F.coalesce("county", F.lit("")), F.coalesce("fuel_type", F.lit("")))).select("request_id", "market", "county", "fuel_type")


def precompute(records: DataFrame, min_sample_n: int = 2) -> DataFrame:
    """The rollups of all of ``all_requests``."""
    return rollup(records, all_requests(records), min_sample_n)
