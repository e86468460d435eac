import pytest
from pyspark.sql import functions as F

from sparkgauge import catalog
from sparkgauge.operators import flexibility, procurement, timeline
from sparkgauge.plans import seeds

SCN = "scenario_id string, market string, jurisdiction string, peak_mw double, commitment_depth_pct double, event_duration_hours double, events_per_year int, dispatchable_or_curtailable boolean, metering_or_control_capability boolean, colocated_generation boolean, value_per_day_usd double, project_type string, interconnection_voltage_kv double, procurement_strategy string"


def scenario(spark, sid="s", jurisdiction="DEMO", peak=100.0, depth=20.0, curtail=True, meter=True, coloc=False, value=1e6, kind="Large Load", kv=345.0, strategy="serial_after_approval", hours=3.0, events=20):
    row = spark.createDataFrame([(sid, jurisdiction, jurisdiction, peak, depth, hours, events, curtail, meter, coloc, value, kind, kv, strategy)], SCN)
    return row.withColumns({c: F.lit(seeds.ASSUMPTION[c]) for c in flexibility.ASSUMPTION_COSTS})


def baseline(spark, low=1415.0, high=1415.0, confidence="Low"):
    return spark.createDataFrame([("s", "s", "m", 3, "county_fuel", confidence, low, high, "snap")], "request_id string, scenario_id string, metric_id string, sample_n int, fallback_level string, confidence string, median_duration_days double, p75_duration_days double, source_snapshot_id string")


def test_compute_cost(spark):
    row = scenario(spark, depth=10.0, hours=2.0, events=4).withColumns({"gpu_power_kw": F.lit(0.5), "deferrable_workload_fraction": F.lit(0.5), "migratable_fraction": F.lit(0.25), "deferral_penalty_per_gpu_hour_usd": F.lit(1.0), "migration_penalty_per_gpu_hour_usd": F.lit(2.0), "dropped_work_penalty_per_gpu_hour_usd": F.lit(3.0)})
    got = flexibility.compute_cost(row).first()
    assert [got[c] for c in ("annual_curtailed_mwh", "gpu_hours_impacted", "deferred_gpu_hours", "migrated_gpu_hours", "dropped_or_unserved_gpu_hours", "estimated_compute_cost_usd", "is_extrapolated")] == [80.0, 160000.0, 80000.0, 40000.0, 40000.0, 280000.0, False]


def test_assumptions_are_checked():
    flexibility.check_assumption(seeds.ASSUMPTION)
    for bad in ({"gpu_power_kw": 0}, {"migratable_fraction": 0.3}, {"latency_sensitive_fraction": -0.1}):
        with pytest.raises(ValueError):
            flexibility.check_assumption({**seeds.ASSUMPTION, **bad})


@pytest.mark.parametrize(("given", "rule", "status"), [
    ({"jurisdiction": "FERC"}, "rule_ferc_rm26_4_anopr", "contingent"), ({"jurisdiction": "ERCOT"}, "rule_ercot_large_load_context", "unsupported"), ({"jurisdiction": "EVIDENCE"}, "rule_flex_demonstration_evidence", "unsupported"),
    ({"jurisdiction": "SPP"}, "rule_spp_hill_chill", "eligible"), ({"jurisdiction": "SPP", "meter": None}, "rule_spp_hill_chill", "ambiguous"), ({"jurisdiction": "SPP", "peak": 50.0}, "rule_spp_hill_chill", "not_eligible"),
    ({"jurisdiction": "NOWHERE"}, "rule_ferc_rm26_4_anopr", "not_eligible"), ({"jurisdiction": "PJM", "coloc": None}, "rule_pjm_colocated_load_reform", "ambiguous"), ({"jurisdiction": "PJM", "coloc": True}, "rule_pjm_colocated_load_reform", "contingent"),
])
def test_eligibility(spark, given, rule, status):
    got = flexibility.eligibility(scenario(spark, **given), seeds.rules(spark)).collect()
    assert [(r["rule_id"], r["eligibility_status"]) for r in got] == [(rule, status)]


def test_sweep_and_recommendation(spark):
    points = flexibility.sweep(scenario(spark), seeds.rules(spark), baseline(spark)).orderBy("commitment_depth_pct").collect()
    expected = [
        (0, 0.0, None, None), (5, 551785.71, None, None), (10, 1103571.43, 20.0, 18896428.57), (15, 1655357.14, 20.0, 18344642.86), (20, 2207142.86, 45.0, 42792857.14), (25, 2758928.57, 55.0, 52241071.43), (30, 3310714.29, 60.0, 56689285.71),
        (40, 4414285.71, 60.0, 55585714.29), (50, 5517857.14, 60.0, 54482142.86),
    ]
    assert [(r["commitment_depth_pct"], r["estimated_compute_cost_usd"], r["estimated_timeline_delta_days"], r["net_benefit_score"]) for r in points] == expected
    best = flexibility.recommend(flexibility.sweep(scenario(spark), seeds.rules(spark), baseline(spark))).first()
    assert tuple(best) == ("s", "max_net_benefit_under_assumptions", 30.0, 56689285.71)
    none = flexibility.recommend(flexibility.sweep(scenario(spark, value=None), seeds.rules(spark), baseline(spark))).first()
    assert none["mode"] == "scenario_comparison_only" and none["commitment_depth_pct"] is None


@pytest.mark.parametrize(("given", "base", "status"), [({"jurisdiction": "SPP"}, {}, "qualitative_only"), ({"jurisdiction": "FERC"}, {}, "contingent"), ({"jurisdiction": "SPP", "meter": None}, {}, "contingent"), ({"jurisdiction": "ERCOT"}, {}, "unsupported"), ({}, {"confidence": "Insufficient"}, "insufficient_baseline"), ({}, {"low": 10.0, "high": 10.0}, "quantified")])
def test_benefit(spark, given, base, status):
    best = flexibility.best_rule(flexibility.eligibility(scenario(spark, **given), seeds.rules(spark)), ["scenario_id"])
    got = flexibility.benefit(best.join(baseline(spark, **base).drop("request_id"), "scenario_id")).first()
    assert got["benefit_status"] == status
    if base.get("low"):
        assert got["estimated_timeline_delta_days"] == 10.0  # bounded by the baseline


def test_equipment_scope(spark):
    classes = lambda **k: [r["equipment_class"] for r in procurement.equipment_scope(scenario(spark, **k)).orderBy("position").collect()]
    assert len(classes(peak=300.0)) == 6 and classes(peak=300.0)[1] == "HV Switchgear / GIS"
    assert "HV Switchgear / GIS" not in classes(peak=50.0, kv=138.0)
    assert classes(kind="Hybrid")[0] == "GSU Transformer" and classes(kind="Wind") == [None] and classes(kv=None) == [None]
    manual = scenario(spark).withColumn("manual_equipment", F.array(F.lit("Own Thing")))
    assert [(r["equipment_class"], r["scope_item_id"], r["source"]) for r in procurement.equipment_scope(manual).collect()] == [("Own Thing", "manual_1", "manual_user_selected")]
    whole = F.array(F.struct(F.lit("A").alias("equipment_class"), F.lit("mine").alias("scope_item_id"), F.lit("asked for").alias("explanation")), F.struct(F.lit("B").alias("equipment_class"), F.lit(" ").alias("scope_item_id"), F.lit(None).cast("string").alias("explanation")))
    got = procurement.equipment_scope(scenario(spark).withColumn("manual_equipment", whole)).orderBy("position").collect()
    assert [(r["equipment_class"], r["scope_item_id"], r["explanation"], r["scope_mode"]) for r in got] == [("A", "mine", "asked for", "manual_user_selected"), ("B", "manual_2", "Given by hand.", "manual_user_selected")]


def test_critical_path_and_estimate(spark):
    scope = procurement.equipment_scope(scenario(spark, peak=300.0))
    path = procurement.critical_path(scope, seeds.lead_times(spark), "2026-06-05")
    got = path.first()
    assert (got["binding_equipment_class"], got["procurement_low_days"], got["procurement_high_days"], got["stale_flag"], got["conflict_flag"]) == ("Large Power Transformer", 1095.75, 1826.25, True, True)
    assert len(got["missing_equipment"]) == 3 and procurement.missing_classes(scope, seeds.lead_times(spark)).count() == 3
    base = timeline.baseline(baseline(spark).drop("scenario_id"))

    def estimate(**k):
        scn = scenario(spark, peak=300.0, **k)
        best = flexibility.best_rule(flexibility.eligibility(scn, seeds.rules(spark)), ["scenario_id"])
        return timeline.estimate(timeline.commissioning(timeline.flex_adjusted(flexibility.benefit(best.join(base, "scenario_id"))).join(path, "scenario_id")))

    one = estimate(jurisdiction="ERCOT").first()
    assert [one[f"no_flex_{k}_{s}_days"] for k in ("serial", "overlap") for s in ("low", "high")] == [2547.75, 3315.25, 1452.0, 1900.25]
    assert one["flex_serial_low_days"] is None and one["selected_case"] == "no_flex_serial" and one["binding_constraint"] == "procurement" and one["estimate_status"] == "conflicting_procurement_data" and one["estimate_confidence"] == "low"
    two = estimate(strategy="at_risk_overlap").first()
    assert [two[f"flex_{k}_{s}_days"] for k in ("overlap", "serial") for s in ("low", "high")] == [1407.0, 1900.25, 2502.75, 3270.25] and two["selected_case"] == "flex_overlap"
    parts = timeline.components(estimate()).orderBy("position").collect()
    assert len(parts) == 8 and parts[1]["low_days"] == -45.0 and parts[2]["low_days"] == 1370.0


def test_rows_without_source_dont_count(spark):
    scope = procurement.equipment_scope(scenario(spark))
    none = procurement.critical_path(scope, seeds.lead_times(spark).withColumn("source_url", F.lit("")), "2026-06-05").first()
    assert none["unsupported_flag"] and none["procurement_low_days"] is None and none["procurement_confidence"] == "insufficient"


def test_lead_times_use_their_own_threshold(spark):
    rows = {r["lead_time_id"]: r for r in procurement.lead_times(seeds.lead_times(spark), "2026-06-05").collect()}
    assert rows["lead_lpt_36_60"]["is_stale"] and not rows["lead_mv_8_14"]["is_stale"] and rows["lead_hv_gis_18_30"]["conflict_flag"] and not rows["lead_gsu_24_40"]["conflict_flag"]


def test_rules_with_sources(spark):
    rows = flexibility.rules_with_sources(seeds.rules(spark), seeds.rule_sources(spark), include_context=False).collect()
    assert len(rows) == 5 and all(len(r["citations"]) == 1 for r in rows)


def test_criteria_by_a_callers_function(spark, sf):
    """A table function like the built-in one agrees with it; another one, or a function of columns, decides instead."""
    scn, rules = catalog.scenarios(spark, sf), seeds.rules(spark)
    show = lambda df: sorted(map(str, df.select("scenario_id", "rule_id", "eligibility_status", *(F.sort_array(c) for c in ("matched_criteria", "missing_criteria", "mismatched_criteria"))).collect()))
    assert show(flexibility.eligibility(scn, rules, evaluate=flexibility.checked_criteria())) == show(flexibility.eligibility(scn, rules))
    none = F.array().cast("array<string>")
    lax = flexibility.eligibility(scn, rules, evaluate=lambda criteria, facts: F.struct(none, F.when(facts["peak_mw"] < 50, F.array(F.lit("size"))).otherwise(none), none))
    assert lax.where("eligibility_status = 'ambiguous'").count() == scn.where("peak_mw < 50").count() > 0
    assert lax.where("eligibility_status = 'not_eligible'").count() == 0


def test_scenarios_ask_the_records_rollups(spark, sf):
    scn = catalog.scenarios(spark, sf)
    found = {r["scenario_id"]: r for r in catalog._rollups(spark, sf, scn).collect()}
    assert len(found) == scn.count()
    assert {found[r["scenario_id"]]["confidence"] for r in scn.where("market = 'NOWHERE'").collect()} == {"Insufficient"}
    assert {r["fallback_level"] for r in found.values()} >= {"county_all_fuels", "none"}
