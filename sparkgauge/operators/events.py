"""Unified change events: adapter from diffs, materiality, hard alerts, ranking."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hashed_id, spread_key

#: What each type of event weighs; 10 for others.
WEIGHTS = {
    "withdrawn_project": 40, "removed_project": 25, "completed_project": 35, "new_project": 30, "status_changed": 25, "target_cod_delayed": 25, "target_cod_accelerated": 20,
    "capacity_changed": 20, "fuel_type_changed": 15, "poi_changed": 15, "name_changed": 5, "ambiguous_match": 0, "rule_status_changed": 45, "rule_source_changed": 35,
    "rule_needs_review": 30, "source_parse_failed": 25, "source_unchanged": 0, "lead_time_conflict": 30, "lead_time_stale": 20, "lead_time_source_changed": 25, "digest_generated": 0,
}
#: Types that are never hard alerts, types whose repeats all stay, and the least score of a hard alert.
NEVER_HARD = ("ambiguous_match", "name_changed", "source_unchanged")
KEEP_ALL = ("source_parse_failed", "rule_needs_review", "lead_time_conflict", "lead_time_stale")
HARD_FROM = 20.0
#: A record's fields in an event's before and after.
PAYLOAD = ("record_id", "snapshot_id", "market", "queue_id", "project_name", "county", "state", "point_of_interconnection", "normalized_fuel_type", "capacity_mw", "normalized_status", "target_cod")

EMPTY_WATCHLIST: dict[str, list[str]] = {"counties": [], "markets": [], "jurisdictions": []}


def load_watchlist(path: str | Path) -> dict[str, list[str]]:
    """A JSON file with lists of counties, markets and jurisdictions; empty where there is no file."""
    path = Path(path)
    return json.loads(path.read_text()) if path.exists() else dict(EMPTY_WATCHLIST)


def _weight() -> Column:
    table = F.create_map(*(F.lit(x) for k, v in WEIGHTS.items() for x in (k, float(v))))
    return F.coalesce(F.try_element_at(table, F.col("event_type")), F.lit(10.0))


def watched(watchlist: Mapping[str, Sequence[str]]) -> Column:
    """Whether the event's county, market or jurisdiction (the later record's, else the earlier's) is on the list, in any case."""

    def among(names: Sequence[str], *values: Column) -> Column:
        value = F.lower(F.coalesce(*(F.nullif(v, F.lit("")) for v in values)))
        return F.coalesce(value.isin(*(str(n).lower() for n in names)), F.lit(False)) if names else F.lit(False)

    return (
        among(watchlist.get("counties", ()), F.col("after.county"), F.col("before.county"))
        | among(watchlist.get("markets", ()), F.col("market"), F.col("after.market"), F.col("before.market"))
        | among(watchlist.get("jurisdictions", ()), F.col("jurisdiction"))
    )


def score(watchlist: Mapping[str, Sequence[str]] = EMPTY_WATCHLIST) -> Column:
    """Materiality of a row with event_type, before, after, market and jurisdiction: weight, size, moves, watch list."""
    part = lambda x: F.least(F.lit(30.0), F.log10(F.greatest(x, F.lit(1.0))) * 10.0)
    after, before = F.col("after.capacity_mw"), F.col("before.capacity_mw")
    size = F.coalesce(F.nullif(after, F.lit(0.0)), F.nullif(before, F.lit(0.0)))
    days = F.datediff(F.col("after.target_cod"), F.col("before.target_cod"))
    late = F.when(days > 365, 15.0).when(days > 180, 10.0).when(days > 90, 5.0).otherwise(0.0)
    return F.round(
        _weight() + F.coalesce(part(size), F.lit(0.0))
        + F.when((F.col("event_type") == "capacity_changed") & before.isNotNull() & after.isNotNull(), part(F.abs(after - before))).otherwise(0.0)
        + F.when(F.col("event_type") == "target_cod_delayed", late).otherwise(0.0)
        + F.when(watched(watchlist), 10.0).otherwise(0.0),
        4,
    )


def hard_alert(score_column: str = "materiality_score") -> Column:
    return ~F.col("is_ambiguous") & ~F.col("event_type").isin(*NEVER_HARD) & (F.col(score_column) >= HARD_FROM)


def complete(events: DataFrame, watchlist: Mapping[str, Sequence[str]] = EMPTY_WATCHLIST) -> DataFrame:
    """``events`` with materiality_score and is_hard_alert; a given is_hard_alert that isn't null stays."""
    scored = events.withColumn("materiality_score", score(watchlist))
    return scored.withColumn("is_hard_alert", F.coalesce("is_hard_alert", hard_alert()) if "is_hard_alert" in events.columns else hard_alert())


def from_diff(diffs: DataFrame, records: DataFrame, sources: DataFrame | None = None, watchlist: Mapping[str, Sequence[str]] = EMPTY_WATCHLIST) -> DataFrame:
    """Change events of all diffs but unchanged ones; ambiguous ones are never hard. ``sources``: (snapshot_id, source_url)."""
    payload = records.select(F.col("record_id").alias("_key"), F.struct(*PAYLOAD).alias("_payload"))
    rows = (
        diffs.where(F.col("event_type") != "unchanged")
        .withColumns({"_b": spread_key("before_record_id", "after_record_id", "entity_id"), "_a": spread_key("after_record_id", "before_record_id", "entity_id")})
        .join(payload.select(F.col("_key").alias("_b"), F.col("_payload").alias("before")), "_b", "left")
        .join(payload.select(F.col("_key").alias("_a"), F.col("_payload").alias("after")), "_a", "left")
    )
    if sources is not None:
        rows = rows.join(sources.select(F.col("snapshot_id").alias("to_snapshot_id"), "source_url"), "to_snapshot_id", "left")
    else:
        rows = rows.withColumn("source_url", F.lit(None).cast("string"))
    rows = rows.select(
        F.lit("queue").alias("event_domain"), "event_type", "market", F.lit(None).cast("string").alias("jurisdiction"), F.coalesce("after.project_name", "before.project_name", "entity_id").alias("entity_or_provision"),
        "entity_id", F.lit(None).cast("string").alias("rule_id"), "from_snapshot_id", "to_snapshot_id", "source_url", "before", "after", "changed_fields", "confidence",
        (F.col("event_type") == "ambiguous_match").alias("is_ambiguous"), F.when(F.col("event_type") == "ambiguous_match", F.lit(False)).alias("is_hard_alert"), "explanation",
        hashed_id("chg", "event_id").alias("change_event_id"),
    )
    return complete(rows, watchlist)


def dedup(events: DataFrame) -> DataFrame:
    """Of hard events with the same domain, type, subject, rule and later state the highest score; review types all stay.

    The later state is compared by a hash, so the shuffle carries no payloads as keys. Among equal scores the smallest
    change_event_id stays.
    """
    hard = events.where("is_hard_alert")
    passed = F.col("event_type").isin(*KEEP_ALL)
    state = F.sha2(F.coalesce(F.to_json(F.struct("after", "changed_fields"), {"ignoreNullFields": "false"}), F.lit("")), 256)
    subject = F.coalesce("entity_id", "entity_or_provision")
    keyed = hard.withColumn("_key", F.when(passed, F.col("change_event_id")).otherwise(F.sha2(F.concat_ws("\x1f", "event_domain", "event_type", F.coalesce(subject, F.lit("")), F.coalesce("rule_id", F.lit("")), state), 256)))
    order = Window.partitionBy("_key").orderBy(F.desc("materiality_score"), "change_event_id")
    return keyed.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn", "_key")


def top(events: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` highest deduplicated hard events: score, then type, subject and id."""
    return dedup(events).orderBy(F.desc("materiality_score"), F.asc_nulls_first("event_type"), F.asc_nulls_first("entity_or_provision"), "change_event_id").limit(n)


def suppressed(events: DataFrame) -> DataFrame:
    return events.where(~F.col("is_hard_alert")).orderBy(F.desc("materiality_score"), "event_type", "change_event_id")


def listing(events: DataFrame, domain: str | None = None) -> DataFrame:
    """Events by score, newest first; of one domain if one is named."""
    found = events.where(F.col("event_domain") == domain) if domain else events
    newest = [F.desc("created_at")] if "created_at" in events.columns else []
    return found.orderBy(F.desc("materiality_score"), *newest, "change_event_id")
