"""Typed change events between adjacent snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import differs, hashed_id
from .resolve import capacity_close

#: Days by which a target date must move to count.
MOVED = 90
_RECORD = ("record_id", "project_name", "normalized_project_name", "normalized_status", "normalized_fuel_type", "capacity_mw", "target_cod", "point_of_interconnection")
_EVENT = "struct<event_type:string,severity:string,confidence:double,changed_fields:string,explanation:string>"


def adjacent_snapshots(snapshots: DataFrame) -> DataFrame:
    """(market, from_snapshot_id, to_snapshot_id) of each snapshot and the next of its market, by date and id."""
    order = Window.partitionBy("market").orderBy("snapshot_date", "snapshot_id")
    named = snapshots.select("market", "snapshot_id", "snapshot_date").distinct().withColumn("to_snapshot_id", F.lead("snapshot_id").over(order))
    return named.where("to_snapshot_id is not null").select("market", F.col("snapshot_id").alias("from_snapshot_id"), "to_snapshot_id")


def _event(kind: Column | str, severity: Column | str, confidence: Column, changed: Column | None, explanation: Column | str) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(text(kind).alias("event_type"), text(severity).alias("severity"), confidence.alias("confidence"), (changed if changed is not None else F.lit("{}")).alias("changed_fields"), text(explanation).alias("explanation"))


def _change(field: str, before: Column, after: Column, **more: Column) -> Column:
    return F.to_json(F.struct(F.struct(before.alias("before"), after.alias("after"), *(c.alias(k) for k, c in more.items())).alias(field)), {"ignoreNullFields": "false"})


def diff(records: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """The events of all snapshot pairs at once; every pair of records gives at least one event.

    One full outer join by entity and pair decides new, removed, ambiguous and matched; the changes of a match are an
    array of whatever rules hold, exploded. Ambiguous links of the earlier snapshot take part, so their entities are
    always reported removed. The pairs, a few names, are broadcast: dealt by them, a snapshot's records would be one task.
    """
    linked = links.select("record_id", "entity_id", "match_score", "match_method", "is_ambiguous", F.col("match_features").alias("features")).join(records.select("snapshot_id", "market", *_RECORD), "record_id")
    side = lambda key, name: linked.withColumnRenamed("snapshot_id", key).join(F.broadcast(pairs), ["market", key]).select("market", "from_snapshot_id", "to_snapshot_id", "entity_id", F.struct(*linked.drop("market", "snapshot_id", "entity_id").columns).alias(name))
    both = side("from_snapshot_id", "b").join(side("to_snapshot_id", "a"), ["market", "from_snapshot_id", "to_snapshot_id", "entity_id"], "full_outer")
    b, a = (lambda f: F.col(f"b.{f}")), (lambda f: F.col(f"a.{f}"))
    sure = a("match_score")
    days = F.datediff(a("target_cod"), b("target_cod"))
    status = F.when(a("normalized_status") == "Withdrawn", "withdrawn_project").when(a("normalized_status") == "Completed", "completed_project").otherwise("status_changed")
    cod = lambda words: _event(F.when(days > 0, "target_cod_delayed").otherwise("target_cod_accelerated"), F.when(days > 0, "medium").otherwise("info"), sure, _change("target_cod", b("target_cod"), a("target_cod"), delta_days=days), words)
    rules = [
        F.when(differs(b("normalized_status"), a("normalized_status")), _event(status, F.when(a("normalized_status") == "Withdrawn", "high").otherwise("medium"), sure, _change("status", b("normalized_status"), a("normalized_status")), F.concat(F.lit("Status went from "), b("normalized_status"), F.lit(" to "), a("normalized_status"), F.lit(".")))),
        F.when(b("capacity_mw").isNotNull() & a("capacity_mw").isNotNull() & ~capacity_close(b("capacity_mw"), a("capacity_mw")), _event("capacity_changed", "medium", sure, _change("capacity_mw", b("capacity_mw"), a("capacity_mw")), "Capacity moved by more than 5 MW and 2 %.")),
        F.when(F.abs(days) > MOVED, cod(F.format_string("Target date moved by %d days.", days))),
        F.when(differs(b("normalized_fuel_type"), a("normalized_fuel_type")), _event("fuel_type_changed", "medium", sure, _change("fuel_type", b("normalized_fuel_type"), a("normalized_fuel_type")), "The category of fuel changed.")),
        F.when(differs(b("normalized_project_name"), a("normalized_project_name")), _event("name_changed", "info", sure, _change("project_name", b("project_name"), a("project_name")), "The name changed while the evidence links the records.")),
        F.when(differs(b("point_of_interconnection"), a("point_of_interconnection")), _event("poi_changed", "medium", sure, _change("point_of_interconnection", b("point_of_interconnection"), a("point_of_interconnection")), "The point of interconnection changed.")),
    ]
    changes = F.filter(F.array(*(r.cast(_EVENT) for r in rules)), lambda e: e.isNotNull())
    quiet = F.array(_event("unchanged", "info", sure, None, "No watched field changed.").cast(_EVENT))
    name = lambda key, c: F.to_json(F.struct(c.alias(key)), {"ignoreNullFields": "false"})
    ambiguous = _event("ambiguous_match", "warning", sure, F.to_json(F.struct(a("match_method").alias("match_method"), a("features").alias("match_features"))), "The later record resembles several earlier ones; no link was forced.")
    new = _event("new_project", "info", F.when(a("match_method") == "new_entity", F.lit(0.9)).otherwise(sure), name("after_project_name", a("project_name")), "The entity is in the later snapshot only.")
    removed = _event("removed_project", "warning", b("match_score"), name("before_project_name", b("project_name")), "The entity is missing from the later snapshot; that is no evidence of withdrawal.")
    there, gone = F.col("a").isNotNull(), F.col("a").isNull()
    matched = F.when(F.size(changes) > 0, changes).otherwise(quiet)
    events = F.when(there & a("is_ambiguous"), F.array(ambiguous.cast(_EVENT))).when(there & F.col("b").isNull(), F.array(new.cast(_EVENT))).when(gone, F.array(removed.cast(_EVENT))).otherwise(matched)
    out = both.withColumn("e", F.explode(events))
    alone = F.col("e.event_type").isin("ambiguous_match", "new_project")
    out = out.select("market", "from_snapshot_id", "to_snapshot_id", "entity_id", "e.*", F.when(~alone, b("record_id")).alias("before_record_id"), a("record_id").alias("after_record_id"))
    return out.withColumn("event_id", hashed_id("diff", "from_snapshot_id", "to_snapshot_id", "entity_id", "event_type"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("events"))


def read_back(events: DataFrame, market: str, from_snapshot: str, to_snapshot: str) -> DataFrame:
    """One pair's events by type and entity."""
    found = events.where((F.col("market") == market) & (F.col("from_snapshot_id") == from_snapshot) & (F.col("to_snapshot_id") == to_snapshot))
    return found.orderBy("event_type", "entity_id")
