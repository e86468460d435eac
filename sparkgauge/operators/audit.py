"""Audits of resolution, listings, briefs' tables, and independent checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import in_year, spread_key
from .resolve import CONFIDENT

#: An event's label in the audit; others get "system_suggested_" and their type.
EVENT_LABELS = {
    "new_project": "system_suggested_true_new", "ambiguous_match": "ambiguous_needs_review", "removed_project": "system_suggested_true_removed_not_withdrawn", "withdrawn_project": "system_suggested_true_withdrawn",
    "completed_project": "system_suggested_true_completed", "fuel_type_changed": "possible_reclassification", "name_changed": "possible_id_name_drift",
}
EVENTS = (*EVENT_LABELS, "capacity_changed", "target_cod_delayed", "target_cod_accelerated", "status_changed")
NO_REVIEW = ("auto_verified_exact_id", "system_suggested_true_new", "system_suggested_true_removed_not_withdrawn")
COUNTS = {
    "exact_matches": "auto_verified_exact_id", "fuzzy_matches": "system_suggested_same_entity_fuzzy", "ambiguous_matches": "ambiguous_needs_review", "true_additions": "system_suggested_true_new",
    "true_removals_or_missing": "system_suggested_true_removed_not_withdrawn", "true_withdrawals": "system_suggested_true_withdrawn", "true_completed": "system_suggested_true_completed", "reclassifications": "possible_reclassification",
}
#: The fields of both records, in the order of the file; and all its columns.
SIDES = {"project_name": "project_name", "queue_id": "queue_id", "capacity": "capacity_mw", "fuel_type": "normalized_fuel_type", "county": "county", "status": "normalized_status", "target_cod": "target_cod"}
COLUMNS = (
    "from_snapshot_id", "to_snapshot_id", "from_record_id", "to_record_id", "entity_id", *(f"{k}_{s}" for k in SIDES for s in ("before", "after")),
    "match_score", "match_features_json", "ambiguity_reason", "system_label", "manual_label", "manual_reviewer", "manual_review_notes", "evidence_summary", "source_file_hash_before", "source_file_hash_after",
)


def match_label() -> Column:
    same = F.coalesce((F.col("b.queue_id") == F.col("a.queue_id")) & (F.col("b.queue_id") != ""), F.lit(False))
    return (
        F.when(F.col("is_ambiguous"), "ambiguous_needs_review").when(same, "auto_verified_exact_id").when(F.col("match_score") >= CONFIDENT, "system_suggested_same_entity_fuzzy")
        .when(F.col("match_method") == "new_entity", "system_suggested_new_entity").otherwise("system_suggested_possible_match")
    )


def event_label(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in EVENT_LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, kind), F.concat(F.lit("system_suggested_"), kind))


def audit(records: DataFrame, links: DataFrame, events: DataFrame, snapshots: DataFrame, from_snapshot: str, to_snapshot: str) -> DataFrame:
    """One row for each entity linked in both snapshots, and for each event that no such row already stands for; all of ``COLUMNS``."""
    fields = F.struct("record_id", *dict.fromkeys(SIDES.values()))
    payload = records.select(F.col("record_id").alias("_key"), fields.alias("_r"))
    side = lambda snapshot: links.where(F.col("snapshot_id") == snapshot)
    b = side(from_snapshot).select("entity_id", F.col("record_id").alias("before_record_id"))
    a = side(to_snapshot).select("entity_id", F.col("record_id").alias("after_record_id"), "match_score", "match_method", "is_ambiguous", "match_features")

    def with_records(df: DataFrame) -> DataFrame:
        for key, other, name in (("before_record_id", "after_record_id", "b"), ("after_record_id", "before_record_id", "a")):
            df = df.withColumn("_of", spread_key(key, other, "entity_id")).join(payload.select(F.col("_key").alias("_of"), F.col("_r").alias(name)), "_of", "left").drop("_of")
        return df

    pairs = with_records(b.join(a, "entity_id")).withColumn("system_label", match_label())
    reason = F.coalesce(F.get_json_object("match_features", "$.reason"), F.lit("top candidates too close"))
    evidence = F.when(F.col("is_ambiguous"), F.concat(F.lit("ambiguous candidates; method="), "match_method")).when(F.col("system_label") == NO_REVIEW[0], F.concat(F.lit("same queue id "), F.col("b.queue_id"))).otherwise(F.concat(F.lit("matched by "), "match_method"))
    pairs = pairs.withColumns({"ambiguity_reason": F.when(F.col("is_ambiguous"), reason).otherwise(""), "evidence_summary": evidence})
    found = events.where((F.col("from_snapshot_id") == from_snapshot) & (F.col("to_snapshot_id") == to_snapshot) & F.col("event_type").isin(*EVENTS))
    found = found.select("entity_id", "before_record_id", "after_record_id", F.col("confidence").alias("match_score"), F.col("changed_fields").alias("match_features"), event_label(F.col("event_type")).alias("system_label"), (F.col("event_type") == "ambiguous_match").alias("is_ambiguous"), F.col("explanation").alias("evidence_summary"))
    key = [F.coalesce(c, F.lit("")) for c in ("before_record_id", "after_record_id")]
    keyed = lambda df: df.withColumns({"_b": key[0], "_a": key[1]})
    extra = keyed(found).join(keyed(pairs).select("_b", "_a", "system_label"), ["_b", "_a", "system_label"], "left_anti").drop("_b", "_a")
    extra = with_records(extra).withColumn("ambiguity_reason", F.when(F.col("is_ambiguous"), "top candidates too close").otherwise(""))
    common = ["entity_id", "before_record_id", "after_record_id", "a", "b", "match_score", "match_features", "ambiguity_reason", "system_label", "evidence_summary"]
    rows = pairs.select(*common).unionByName(extra.select(*common))
    hashes = {r["snapshot_id"]: r["file_hash"] for r in snapshots.where(F.col("snapshot_id").isin(from_snapshot, to_snapshot)).select("snapshot_id", "file_hash").collect()}
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    values = {f"{k}_{n}": blank(F.col(f"{s}.{f}")) for k, f in SIDES.items() for s, n in (("b", "before"), ("a", "after"))}
    values |= {
        "from_snapshot_id": F.lit(from_snapshot), "to_snapshot_id": F.lit(to_snapshot), "from_record_id": blank(F.col("before_record_id")), "to_record_id": blank(F.col("after_record_id")),
        "match_score": F.round("match_score", 4), "match_features_json": F.coalesce("match_features", F.lit("{}")), "manual_label": F.lit(""), "manual_reviewer": F.lit(""), "manual_review_notes": F.lit(""),
        "source_file_hash_before": F.lit(hashes.get(from_snapshot, "")), "source_file_hash_after": F.lit(hashes.get(to_snapshot, "")),
    }
    return rows.select(*(values.get(c, F.col(c)).alias(c) for c in COLUMNS))


def audit_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*(F.count_if(F.col("system_label") == label).alias(name) for name, label in COUNTS.items()))


def review_candidates(rows: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` rows to review: ambiguous ones, then by score, then by name."""
    named = F.coalesce(F.nullif("project_name_after", F.lit("")), F.col("project_name_before"))
    return rows.where(~F.col("system_label").isin(*NO_REVIEW)).orderBy(F.when(F.col("system_label") == "ambiguous_needs_review", 0).otherwise(1), F.desc("match_score"), named, "entity_id", "system_label").limit(n)


def entity_matches(links: DataFrame, records: DataFrame, entity: str | None = None) -> DataFrame:
    """Links with their records, of one entity or of all, by snapshot."""
    found = links.where(F.col("entity_id") == entity) if entity else links
    return found.join(records.select("record_id", "snapshot_date", "queue_id", "project_name", "county", "normalized_fuel_type", "capacity_mw", "normalized_status"), "record_id").orderBy("entity_id", "snapshot_date", "record_id")


def source_counts(sources: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Every source with the number of its snapshots, 0 for none."""
    return sources.join(snapshots.select("source_id", "snapshot_id"), "source_id", "left").groupBy("source_id", "source_name").agg(F.count("snapshot_id").alias("snapshots"))


def scope_rows(records: DataFrame, county: str | None = None, fuel: str | None = None) -> DataFrame:
    """Records by status, then size, then name; an empty filter counts as none."""
    for column, value in (("county", county), ("normalized_fuel_type", fuel)):
        if value:
            records = records.where(F.col(column) == value)
    return records.orderBy("normalized_status", F.desc_nulls_last("capacity_mw"), F.asc_nulls_last("project_name"), "record_id")


def comparables(records: DataFrame, fuel: str, county: str | None = None, capacity_mw: float | None = None, year: int | None = None, n: int = 5) -> DataFrame:
    """The ``n`` records nearest in capacity (missing counts as 0), those of the target year first among equals."""
    distance = F.abs(F.coalesce("capacity_mw", F.lit(0.0)) - F.lit(float(capacity_mw))) if capacity_mw is not None else F.lit(None).cast("double")
    match = in_year("target_cod", int(year)) if year else F.lit(False)
    rows = records.where(F.col("normalized_fuel_type") == fuel)
    rows = rows.where(F.col("county") == county) if county else rows
    rows = rows.withColumns({"capacity_distance_mw": distance, "target_cod_year_match": match})
    return rows.orderBy(F.coalesce("capacity_distance_mw", F.lit(1e6)), F.desc("target_cod_year_match"), "normalized_status", F.desc_nulls_last("capacity_mw"), F.asc_nulls_last("project_name"), "record_id").limit(n)


def with_citations(rows: DataFrame, citations: DataFrame) -> DataFrame:
    """Rows (a brief's few) with the sorted list of their records' citations."""
    cited = citations.join(F.broadcast(rows.select("record_id").distinct()), "record_id", "left_semi").groupBy("record_id").agg(F.array_sort(F.collect_list("citation_id")).alias("citation_ids"))
    return rows.join(cited, "record_id", "left").withColumn("citation_ids", F.coalesce("citation_ids", F.array().cast("array<string>")))


def id_overlap(before: DataFrame, after: DataFrame) -> DataFrame:
    """Queue ids that both snapshots have."""
    return before.where("queue_id is not null").select("queue_id").intersect(after.where("queue_id is not null").select("queue_id"))


def compared(calculated: DataFrame, official: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """(metric, calculated, official, delta, status) of two tables (metric, value): matched within the tolerance, or documented."""
    both = calculated.select("metric", F.col("value").alias("calculated")).join(official.select("metric", F.col("value").alias("official")), "metric", "full_outer")
    delta = F.col("calculated") - F.col("official")
    status = F.when(delta.isNull(), "skipped_missing_value").when(F.abs(delta) <= tolerance, "matched_within_tolerance").otherwise("mismatch_documented")
    return both.select("metric", "calculated", "official", F.round(delta, 4).alias("delta"), status.alias("status"))


def recomputed(records: DataFrame, expected: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """A second, plainer count of statuses against expected ones by snapshot: (metric, calculated, official, delta, status)."""
    found = records.groupBy("snapshot_id", "normalized_status").agg(F.count("*").cast("double").alias("value")).select(F.concat_ws("/", "snapshot_id", "normalized_status").alias("metric"), "value")
    rows = [(f"{s}/{k}", float(n)) for s, counts in expected.items() for k, n in counts.items()]
    return compared(found, records.sparkSession.createDataFrame(rows, "metric string, value double"))


def last_of_each(rows: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Of each key the row that comes last, nulls in it included."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(key, "_r.*")
