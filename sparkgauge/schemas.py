"""Tables of the engine: name to columns, in Spark's DDL. Identifiers are hashes of natural keys, times are UTC."""

from __future__ import annotations

from pyspark.sql.types import StructType

_EVENT = "event_type string, severity string, confidence double, changed_fields string, explanation string"
_RANGE = "low_days double, high_days double"

TABLES: dict[str, str] = {
    "sources": "source_id string, source_name string, source_type string, market string, source_url string, retrieved_at timestamp_ntz, notes string",
    "snapshots": "snapshot_id string, source_id string, market string, snapshot_date date, file_hash string, file_size_bytes bigint, row_count bigint, ingestion_mode string",
    "raw_records": "raw_record_id string, snapshot_id string, row_number bigint, payload map<string,string>",
    "records": "record_id string, snapshot_id string, market string, snapshot_date date, queue_id string, project_name string, normalized_project_name string, interconnecting_entity string, county string, state string, point_of_interconnection string, transmission_owner string, fuel_type string, normalized_fuel_type string, capacity_mw double, status string, normalized_status string, request_date date, target_cod date, actual_cod date, withdrawn_date date, interconnection_agreement_date date, last_updated_date date, raw_record_id string, data_quality_flags array<string>",
    "entities": "entity_id string, first_seen date, last_seen date, records bigint, project_name string, normalized_project_name string, county string, state string, normalized_fuel_type string, capacity_mw double, normalized_status string",
    "links": "record_id string, snapshot_id string, entity_id string, match_score double, match_method string, is_ambiguous boolean, candidate_record_id string, match_features string",
    "diff_events": f"event_id string, market string, from_snapshot_id string, to_snapshot_id string, entity_id string, {_EVENT}, before_record_id string, after_record_id string",
    "change_events": "change_event_id string, event_domain string, event_type string, market string, jurisdiction string, entity_or_provision string, entity_id string, rule_id string, from_snapshot_id string, to_snapshot_id string, source_url string, changed_fields string, confidence double, is_ambiguous boolean, is_hard_alert boolean, materiality_score double, explanation string",
    "metric_rollups": "metric_id string, request_id string, market string, scope_type string, scope_value string, fuel_type string, sample_n bigint, active_count bigint, active_mw double, completed_count bigint, withdrawn_count bigint, completion_rate double, withdrawal_rate double, median_duration_days double, p75_duration_days double, confidence string, fallback_level string, source_snapshot_id string, explanation string",
    "watch_sources": "watch_source_id string, source_name string, source_type string, jurisdiction string, source_url string, parser_type string, watch_frequency string, is_active boolean, notes string",
    "source_captures": "watch_source_id string, captured_at timestamp_ntz, content_text string, content_hash string, previous_content_hash string, parse_status string",
    "flexibility_rules": "position int, rule_id string, jurisdiction string, provision_name string, provision_type string, status string, criteria struct<market_or_jurisdiction:string,peak_mw_threshold:double,commitment_depth_pct_min:double,curtailability_required:boolean,dispatchability_required:boolean,metering_or_control_required:boolean,colocation_required:boolean,onsite_generation_required:boolean>, benefit_points array<struct<commitment_depth_pct:double,estimated_timeline_delta_days:double>>, source_id string, source_url string",
    "flexibility_rule_sources": "rule_id string, citation_label string, source_id string, source_url string",
    "compute_cost_assumptions": "assumption_id string, gpu_power_kw double, gpu_hour_value_usd double, deferrable_workload_fraction double, latency_sensitive_fraction double, migratable_fraction double, deferral_penalty_per_gpu_hour_usd double, migration_penalty_per_gpu_hour_usd double, dropped_work_penalty_per_gpu_hour_usd double, default_event_duration_hours double, default_events_per_year int",
    "scenarios": "scenario_id string, market string, jurisdiction string, county string, project_type string, peak_mw double, commitment_depth_pct double, event_duration_hours double, events_per_year int, dispatchable_or_curtailable boolean, metering_or_control_capability boolean, colocated_generation boolean, interconnection_voltage_kv double, procurement_strategy string, value_per_day_usd double",
    "equipment_lead_times": "lead_time_id string, equipment_class string, voltage_or_rating_band string, lead_time_low_months double, lead_time_high_months double, as_of_date date, confidence string, source_url string, stale_threshold_months int",
    "time_to_power_components": f"scenario_id string, position int, component_type string, {_RANGE}, source_type string",
    "national_records": "record_id string, workbook_id string, row_number int, q_id string, q_status string, ia_phase_raw string, ia_phase_clean string, county string, state string, region string, project_name string, utility string, entity string, developer string, service string, project_type string, type_1 string, type_2 string, type_3 string, type_clean string, q_date date, prop_date date, on_date date, wd_date date, ia_date date, mw_1 double, mw_2 double, mw_3 double, q_year int, prop_year int, raw_payload string",
    "citations": "citation_id string, record_id string, source_id string, citation_text string, source_url string",
    "digests": "digest_id string, period_label string, created_at timestamp_ntz, document string, markdown string",
    "briefs": "brief_id string, kind string, created_at timestamp_ntz, document string, markdown string",
}

#: Child table, its column, and the parent table it refers to.
REFERENCES = (("records", "snapshot_id", "snapshots"), ("links", "record_id", "records"), ("links", "entity_id", "entities"), ("citations", "record_id", "records"), ("flexibility_rule_sources", "rule_id", "flexibility_rules"))


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])
