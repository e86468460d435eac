"""Time to power: interconnection baseline, flexibility, procurement and commissioning as ranges of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hashed_id
from .procurement import _named, _rank

#: The kind of project whose queue durations stand in for another's.
PROXIES = {
    "ai data center load": "Battery", "data center load": "Battery", "generic large load": "Battery", "large load": "Battery", "battery storage": "Battery", "storage": "Battery", "battery": "Battery",
    "solar + storage": "Hybrid", "solar storage": "Hybrid", "hybrid": "Hybrid", "solar": "Solar", "wind": "Wind", "gas": "Gas",
}
#: Default commissioning and buffer ranges in days, strategies and scope modes.
COMMISSIONING = {"commissioning_low_days": 30.0, "commissioning_high_days": 60.0, "buffer_low_days": 7.0, "buffer_high_days": 14.0}
STRATEGIES = ("post_ntp_serial", "serial_after_approval", "procurement_started", "at_risk_overlap", "unknown")
SCOPE_MODES = ("generated_planning_model", "manual_user_selected", "fixture_demo", "insufficient_data")
OVERLAP = "at_risk_overlap"


def proxy_fuel(project_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in PROXIES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(project_type))), project_type)


def baseline_requests(scenarios: DataFrame) -> DataFrame:
    """Rollup requests of scenarios: their market and county, and their project type's stand-in fuel."""
    return scenarios.select(F.col("scenario_id").alias("request_id"), "market", "county", proxy_fuel(F.col("project_type")).alias("fuel_type"))


def baseline(rollups: DataFrame) -> DataFrame:
    """(scenario_id, baseline_low_days, baseline_high_days, ...) of rollups: median to the larger of median and 75th percentile."""
    enough = (F.col("confidence") != "Insufficient") & F.col("median_duration_days").isNotNull() & F.col("p75_duration_days").isNotNull()
    return rollups.select(
        F.col("request_id").alias("scenario_id"), F.when(enough, "complete").otherwise("insufficient_interconnection_baseline").alias("baseline_status"),
        F.when(enough, F.col("median_duration_days")).alias("baseline_low_days"), F.when(enough, F.greatest("p75_duration_days", "median_duration_days")).alias("baseline_high_days"),
        F.col("confidence").alias("baseline_confidence"), "metric_id", "sample_n", "fallback_level", "source_snapshot_id", "median_duration_days", "p75_duration_days", F.col("confidence"),
    )


def flex_adjusted(rows: DataFrame) -> DataFrame:
    """Rows with benefit_status, estimated_timeline_delta_days and the baseline: the interconnection range with flexibility."""
    known = (F.col("benefit_status") == "quantified") & F.col("estimated_timeline_delta_days").isNotNull() & F.col("baseline_low_days").isNotNull()
    low = F.when(known, F.greatest(F.lit(0.0), F.col("baseline_low_days") - F.col("estimated_timeline_delta_days")))
    rows = rows.withColumn("flex_low_days", low)
    return rows.withColumns({"flex_high_days": F.when(known, F.greatest("flex_low_days", F.col("baseline_high_days") - F.col("estimated_timeline_delta_days"))), "flex_adjustment_days": F.when(known, -F.col("estimated_timeline_delta_days"))})


def commissioning(scenarios: DataFrame) -> DataFrame:
    """Scenarios with the four commissioning columns: their own where given, else the defaults, and an id of what holds."""
    given = {k: F.coalesce(F.col(k).cast("double"), F.lit(v)) if k in scenarios.columns else F.lit(v) for k, v in COMMISSIONING.items()}
    return scenarios.withColumns(given).withColumn("commissioning_assumption_id", hashed_id("comm", *COMMISSIONING))


def _serial(a: str, b: str, side: str) -> Column:
    return F.round(F.col(a) + F.col(b) + F.col(f"commissioning_{side}_days") + F.col(f"buffer_{side}_days"), 2)


def _overlap(a: str, b: str, side: str) -> Column:
    # greatest() skips nulls, but a total without one of its parts is unknown
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.greatest(a, b))
    return F.round(both + F.col(f"commissioning_{side}_days") + F.col(f"buffer_{side}_days"), 2)


def estimate(rows: DataFrame) -> DataFrame:
    """Rows with baseline, flexibility, procurement and commissioning columns and procurement_strategy: totals and verdicts."""
    sides = ("low", "high")
    totals = {f"no_flex_serial_{s}_days": _serial(f"baseline_{s}_days", f"procurement_{s}_days", s) for s in sides}
    totals |= {f"flex_serial_{s}_days": _serial(f"flex_{s}_days", f"procurement_{s}_days", s) for s in sides}
    totals |= {f"no_flex_overlap_{s}_days": _overlap(f"baseline_{s}_days", f"procurement_{s}_days", s) for s in sides}
    totals |= {f"flex_overlap_{s}_days": _overlap(f"flex_{s}_days", f"procurement_{s}_days", s) for s in sides}
    status = (
        F.when(F.col("baseline_status") != "complete", "insufficient_interconnection_baseline").when(F.col("unsupported_flag"), "insufficient_procurement_data")
        .when(F.col("conflict_flag"), "conflicting_procurement_data").when(F.col("stale_flag"), "stale_procurement_data").otherwise("complete")
    )
    overlap = F.col("procurement_strategy") == OVERLAP
    flex = F.col("benefit_status") == "quantified"
    case = F.concat(F.when(flex, "flex").otherwise("no_flex"), F.when(overlap, "_overlap").otherwise("_serial"))
    base, proc = F.coalesce("baseline_high_days", F.lit(0.0)), F.coalesce("procurement_high_days", F.lit(0.0))
    comm = F.col("commissioning_high_days") + F.col("buffer_high_days")
    binding = F.when(overlap, F.when(proc >= base, "procurement").otherwise("interconnection")).otherwise(
        F.when((base >= proc) & (base >= comm), "interconnection").when(proc >= comm, "procurement").otherwise("commissioning_and_buffer")
    )
    ranks = [F.when(F.col(c).isNotNull(), _rank(F.col(c))) for c in ("baseline_confidence", "procurement_confidence", "commissioning_confidence") if c in rows.columns]
    lowest = F.least(*ranks) if len(ranks) > 1 else ranks[0]
    return rows.withColumns(totals).withColumns({"estimate_status": status, "selected_case": case, "binding_constraint": binding, "estimate_confidence": _named(lowest)})


def components(estimates: DataFrame) -> DataFrame:
    """Eight rows per estimate: its parts and its two totals without flexibility."""
    part = lambda kind, low, high, source: F.struct(F.lit(kind).alias("component_type"), F.col(low).alias("low_days"), F.col(high).alias("high_days"), F.lit(source).alias("source_type"))
    parts = F.array(
        part("interconnection_baseline", "baseline_low_days", "baseline_high_days", "metric_rollup"),
        part("flexibility_adjustment", "flex_adjustment_days", "flex_adjustment_days", "flexibility_rule"),
        part("interconnection_with_flex", "flex_low_days", "flex_high_days", "flexibility_rule"),
        part("procurement_critical_path", "procurement_low_days", "procurement_high_days", "equipment_lead_times"),
        part("commissioning", "commissioning_low_days", "commissioning_high_days", "commissioning_assumption"),
        part("energization_buffer", "buffer_low_days", "buffer_high_days", "commissioning_assumption"),
        part("total_serial", "no_flex_serial_low_days", "no_flex_serial_high_days", "calculation"),
        part("total_overlap", "no_flex_overlap_low_days", "no_flex_overlap_high_days", "calculation"),
    )
    return estimates.select("scenario_id", F.posexplode(parts).alias("position", "_c")).select("scenario_id", "position", "_c.*")
