"""Small dimension tables: rules, assumptions, lead times, watched sources. Values are fixed; texts are our own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CRITERIA = "struct<market_or_jurisdiction:string,peak_mw_threshold:double,commitment_depth_pct_min:double,curtailability_required:boolean,dispatchability_required:boolean,metering_or_control_required:boolean,colocation_required:boolean,onsite_generation_required:boolean>"
POINTS = "array<struct<commitment_depth_pct:double,estimated_timeline_delta_days:double>>"
RULE_SCHEMA = f"position int, rule_id string, jurisdiction string, provision_name string, provision_type string, status string, criteria {CRITERIA}, benefit_points {POINTS}, source_id string, source_url string"

#: Rule, jurisdiction, provision, kind, status, criteria, benefit points (depth in per cent, days), source and its address.
RULES = (
    ("rule_ferc_rm26_4_anopr", "FERC", "Large Load Interconnection ANOPR", "federal_rulemaking", "pending", {"market_or_jurisdiction": "FERC", "peak_mw_threshold": 20.0, "curtailability_required": True, "metering_or_control_required": True}, None, "src_ferc_rm26_4", "https://www.ferc.gov/rm26-4"),
    ("rule_spp_hill_chill", "SPP", "High Impact Large Load / Conditional HILL Service", "ISO_large_load_process", "approved", {"market_or_jurisdiction": "SPP", "peak_mw_threshold": 100.0, "curtailability_required": True, "metering_or_control_required": True}, None, "src_spp_hill_integration", "https://www.spp.org/markets-operations/high-impact-large-load-hill-integration/"),
    ("rule_pjm_colocated_load_reform", "PJM", "Co-located Load Transmission Service Reform", "co_located_load", "directed", {"market_or_jurisdiction": "PJM", "colocation_required": True, "metering_or_control_required": True}, None, "src_ferc_pjm_colocated_load", "https://www.ferc.gov/news-events/news/fact-sheet-ferc-directs-nations-largest-grid-operator-create-new-rules-embrace"),
    ("rule_ercot_large_load_context", "ERCOT", "Large Load Interconnection Context", "large_load_context", "context_only", {"market_or_jurisdiction": "ERCOT"}, None, "src_ercot_large_load_2026_04_09", "https://www.ercot.com/files/docs/2026/04/09/ERCOTLargeLoadUpdate-April9HouseStateAffairsHearing.pdf"),
    ("rule_flex_demonstration_evidence", "EVIDENCE", "Data center flexibility field demonstration", "compute_flexibility_evidence", "technical_evidence", {}, None, "src_flex_demonstration", "https://arxiv.org/html/2507.00909v1"),
    ("rule_demo_quantified_final", "DEMO", "Synthetic quantified flexibility benefit", "fixture_demo_quantified_benefit", "final", {"market_or_jurisdiction": "DEMO", "peak_mw_threshold": 20.0, "commitment_depth_pct_min": 10.0, "curtailability_required": True, "metering_or_control_required": True}, ((0.0, 0.0), (10.0, 20.0), (20.0, 45.0), (25.0, 55.0), (30.0, 60.0)), "src_demo_quantified", "synthetic://fixtures/flexibility-quantified-benefit"),
)
#: The default compute-cost assumption.
ASSUMPTION = {
    "assumption_id": "assumption_default", "assumption_average_load_factor": 0.85, "deferrable_workload_fraction": 0.55, "latency_sensitive_fraction": 0.25, "migratable_fraction": 0.20, "gpu_power_kw": 0.7, "gpu_hour_value_usd": 3.0,
    "deferral_penalty_per_gpu_hour_usd": 0.25, "migration_penalty_per_gpu_hour_usd": 0.75, "dropped_work_penalty_per_gpu_hour_usd": 4.0, "default_event_duration_hours": 3.0, "default_events_per_year": 20,
}
#: Lead times (id, class, band, low and high months, date, confidence, source).
LEAD_TIMES = (
    ("lead_lpt_36_60", "Large Power Transformer", "Large power transformer", 36.0, 60.0, "2024-07-10", "medium", "https://www.energy.gov/oe/large-power-transformer-resilience-report"),
    ("lead_hv_gis_18_30", "HV Switchgear / GIS", "Transmission-class 230-500 kV", 18.0, 30.0, "2026-05-01", "low", "synthetic://fixtures/lead-times"),
    ("lead_hv_gis_28_42", "HV Switchgear / GIS", "Transmission-class 230-500 kV", 28.0, 42.0, "2024-01-15", "low", "synthetic://fixtures/lead-times"),
    ("lead_mv_8_14", "Medium-Voltage Switchgear", "Campus and collector medium-voltage", 8.0, 14.0, "2026-05-01", "low", "synthetic://fixtures/lead-times"),
    ("lead_gsu_24_40", "GSU Transformer", "Transmission-class step-up transformer", 24.0, 40.0, "2026-05-01", "low", "synthetic://fixtures/lead-times"),
)
#: Watched sources (id, name, kind, jurisdiction, address, parser, frequency).
WATCHED = (
    ("watch_ferc_rm26_4", "FERC RM26-4 docket", "ferc_docket", "FERC", "https://www.ferc.gov/rm26-4", "ferc_large_load_docket", "monthly"),
    ("watch_ferc_large_load_update_2026_04_16", "FERC docket update of April 2026", "ferc_docket", "FERC", "https://www.ferc.gov/news-events/news/ferc-act-large-load-interconnection-docket-june-2026", "ferc_news_page", "monthly"),
    ("watch_spp_hill_chill", "SPP large load page", "iso_rule_page", "SPP", "https://www.spp.org/markets-operations/high-impact-large-load-hill-integration/", "iso_rule_page", "monthly"),
    ("watch_ferc_spp_hill_concurrence", "FERC statement on SPP tariff revisions", "ferc_docket", "SPP", "https://www.ferc.gov/news-events/news/commissioner-rosners-concurrence-order-accepting-tariff-revisions-subject", "ferc_news_page", "monthly"),
    ("watch_manual_regulatory_fixture", "Manual regulatory update", "manual_fixture", "FERC", "synthetic://fixtures/watch/manual-update", "manual_fixture", "manual"),
    ("watch_manual_parse_failure_fixture", "Manual parser failure", "manual_fixture", "FERC", "synthetic://fixtures/watch/parse-failure", "manual_fixture_failure", "manual"),
)


def rules(spark: SparkSession) -> DataFrame:
    names = [f.split(":")[0] for f in CRITERIA[7:-1].split(",")]
    rows = [(i, r[0], r[1], r[2], r[3], r[4], tuple(r[5].get(n) for n in names), [list(p) for p in r[6]] if r[6] else None, r[7], r[8]) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def rule_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r[0], r[2], r[7], r[8]) for r in RULES], "rule_id string, citation_label string, source_id string, source_url string")


def lead_times(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(*r, 18) for r in LEAD_TIMES], "lead_time_id string, equipment_class string, voltage_or_rating_band string, lead_time_low_months double, lead_time_high_months double, as_of_date string, confidence string, source_url string, stale_threshold_months int")
    return rows.withColumn("as_of_date", rows["as_of_date"].cast("date"))


def watched(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, True, "") for r in WATCHED], "watch_source_id string, source_name string, source_type string, jurisdiction string, source_url string, parser_type string, watch_frequency string, is_active boolean, notes string")
