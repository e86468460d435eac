"""Flexibility scenarios: compute cost, rule eligibility, benefit, sweep and recommendation, all as joins of tables.

Scenarios: scenario_id, market, jurisdiction, county, peak_mw, commitment_depth_pct, event_duration_hours,
events_per_year, dispatchable_or_curtailable, metering_or_control_capability, colocated_generation (booleans may be
null: not said). Rules: see ``plans.seeds``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.udtf import UserDefinedTableFunction

#: Rule statuses by what they allow, and the order in which results are preferred.
CONTINGENT = ("proposed", "pending", "directed", "needs_review")
UNSUPPORTED = ("context_only", "technical_evidence", "superseded")
FINAL = ("approved", "final")
PREFERENCE = ("eligible", "contingent", "ambiguous", "unsupported", "not_eligible")
#: Commitment depths of a sweep (per cent), and the demonstrated depth and duration beyond which costs are extrapolated.
LEVELS = (0, 5, 10, 15, 20, 25, 30, 40, 50)
SHOWN_DEPTH, SHOWN_HOURS = 25.0, 3.0
#: Boolean criteria and the scenario's field for each.
BOOLEANS = {
    "curtailability_required": "dispatchable_or_curtailable",
    "dispatchability_required": "dispatchable_or_curtailable",
    "metering_or_control_required": "metering_or_control_capability",
    "colocation_required": "colocated_generation",
    "onsite_generation_required": "colocated_generation",
}
ASSUMPTION_COSTS = ("gpu_power_kw", "deferrable_workload_fraction", "latency_sensitive_fraction", "migratable_fraction", "deferral_penalty_per_gpu_hour_usd", "migration_penalty_per_gpu_hour_usd", "dropped_work_penalty_per_gpu_hour_usd")


def check_assumption(assumption: Mapping[str, float]) -> None:
    """Raises unless power is positive and the workload fractions lie in 0..1 and sum to at most one."""
    fractions = [float(assumption[k]) for k in ("deferrable_workload_fraction", "latency_sensitive_fraction", "migratable_fraction")]
    if float(assumption["gpu_power_kw"]) <= 0:
        raise ValueError("gpu_power_kw must be positive")
    if any(not 0 <= f <= 1 for f in fractions) or sum(fractions) > 1.000001:
        raise ValueError("workload fractions must lie in 0..1 and sum to at most 1")


def compute_cost(rows: DataFrame) -> DataFrame:
    """Rows (a scenario's fields and an assumption's, see ``ASSUMPTION_COSTS``) with the yearly cost of curtailment."""
    mwh = F.col("peak_mw") * F.col("commitment_depth_pct") / 100.0 * F.col("event_duration_hours") * F.col("events_per_year")
    rows = rows.withColumn("_mwh", mwh).withColumn("_hours", F.col("_mwh") * 1000.0 / F.col("gpu_power_kw"))
    rows = rows.withColumns({"_deferred": F.col("_hours") * F.col("deferrable_workload_fraction"), "_migrated": F.col("_hours") * F.col("migratable_fraction")})
    rows = rows.withColumn("_dropped", F.greatest(F.lit(0.0), F.col("_hours") - F.col("_deferred") - F.col("_migrated")))
    cost = F.col("_deferred") * F.col("deferral_penalty_per_gpu_hour_usd") + F.col("_migrated") * F.col("migration_penalty_per_gpu_hour_usd") + F.col("_dropped") * F.col("dropped_work_penalty_per_gpu_hour_usd")
    return rows.withColumns(
        {
            "annual_curtailed_mwh": F.round("_mwh", 4), "gpu_hours_impacted": F.round("_hours", 4), "deferred_gpu_hours": F.round("_deferred", 4), "migrated_gpu_hours": F.round("_migrated", 4),
            "dropped_or_unserved_gpu_hours": F.round("_dropped", 4), "estimated_compute_cost_usd": F.round(cost, 2),
            "is_extrapolated": (F.col("commitment_depth_pct") > SHOWN_DEPTH) | (F.col("event_duration_hours") > SHOWN_HOURS),
        }
    ).drop("_mwh", "_hours", "_deferred", "_migrated", "_dropped")


def applicable_rules(scenarios: DataFrame, rules: DataFrame) -> DataFrame:
    """Each scenario with its jurisdiction's rules, or with FERC's where its jurisdiction has none: an equi-join on a looked-up key."""
    known = rules.select(F.col("jurisdiction").alias("_known")).distinct()
    keyed = scenarios.join(known, F.col("jurisdiction") == F.col("_known"), "left").withColumn("_key", F.coalesce("_known", F.lit("FERC"))).drop("_known")
    renamed = rules.select(F.col("jurisdiction").alias("_key"), F.col("jurisdiction").alias("rule_jurisdiction"), "rule_id", F.col("position"), F.col("status").alias("rule_status"), "criteria", "benefit_points", F.col("source_url").alias("rule_source_url"))
    return keyed.join(renamed, "_key", "left").drop("_key")


def _criteria() -> tuple[list[Column], list[Column], list[Column]]:
    """For matched, missing and mismatched: a name of each criterion, or null."""
    matched, missing, wrong = [], [], []
    c = lambda k: F.col(f"criteria.{k}")
    place = c("market_or_jurisdiction")
    fits = F.coalesce(place == F.col("jurisdiction"), F.lit(False)) | F.coalesce(place == F.col("market"), F.lit(False))
    matched.append(F.when(place.isNotNull() & fits, F.lit("market_or_jurisdiction")))
    wrong.append(F.when(place.isNotNull() & ~fits, F.lit("market_or_jurisdiction")))
    for key, value in (("peak_mw_threshold", "peak_mw"), ("commitment_depth_pct_min", "commitment_depth_pct")):
        matched.append(F.when(F.col(value) >= c(key), F.lit(key)))
        wrong.append(F.when(F.col(value) < c(key), F.lit(key)))
    for key, value in BOOLEANS.items():
        asked = F.coalesce(c(key), F.lit(False))
        matched.append(F.when(asked & F.col(value), F.lit(key)))
        missing.append(F.when(asked & F.col(value).isNull(), F.lit(key)))
        wrong.append(F.when(asked & ~F.col(value), F.lit(key)))
    return matched, missing, wrong


#: The scenario's fields that criteria look at, and what a table function that checks them returns.
FACTS = ("jurisdiction", "market", "peak_mw", "commitment_depth_pct", *dict.fromkeys(BOOLEANS.values()))
CHECKED = "matched_criteria array<string>, missing_criteria array<string>, mismatched_criteria array<string>"


def checked_criteria():
    """The built-in criteria as a table function, for callers to start their own from: a row of names for one rule."""

    @F.udtf(returnType=CHECKED)
    class Checked:
        def eval(self, criteria: Row, facts: Row):
            outcome = {"matched": [], "missing": [], "wrong": []}
            place = criteria["market_or_jurisdiction"] if criteria else None
            if place is not None:
                outcome["matched" if place in (facts["jurisdiction"], facts["market"]) else "wrong"].append("market_or_jurisdiction")
            for key, value in (("peak_mw_threshold", facts["peak_mw"]), ("commitment_depth_pct_min", facts["commitment_depth_pct"])):
                least = criteria[key] if criteria else None
                if least is not None and value is not None:
                    outcome["matched" if value >= least else "wrong"].append(key)
            for key, field in BOOLEANS.items():
                if criteria and criteria[key]:
                    said = facts[field]
                    outcome["missing" if said is None else "matched" if said else "wrong"].append(key)
            yield outcome["matched"], outcome["missing"], outcome["wrong"]

    return Checked


def eligibility(scenarios: DataFrame, rules: DataFrame, evaluate=None) -> DataFrame:
    """A row for each scenario and applicable rule: matched, missing and mismatched criteria, and the status they give.

    Anything missing makes it ambiguous, then anything mismatched not eligible; else the rule's own status decides.
    ``evaluate`` checks the criteria instead: a function of (criteria, facts), two structs, that gives the three arrays
    of ``CHECKED`` - as a struct, if it is a function of columns, or as rows, if it is a table function (then a rule
    that it gives no row doesn't apply, and one with several rows counts once a row).
    """
    present = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    rows = applicable_rules(scenarios, rules)
    if evaluate is None:
        matched, missing, wrong = _criteria()
        rows = rows.withColumns({"matched_criteria": present(matched), "missing_criteria": present(missing), "mismatched_criteria": present(wrong)})
    elif isinstance(evaluate, UserDefinedTableFunction):
        rows = rows.withColumn("_facts", F.struct(*FACTS))
        rows = rows.lateralJoin(evaluate(F.col("criteria").outer(), F.col("_facts").outer())).drop("_facts")
    else:
        rows = rows.withColumn("_checked", evaluate(F.col("criteria"), F.struct(*FACTS)).cast(f"struct<{CHECKED}>")).select("*", "_checked.*").drop("_checked")
    status = (
        F.when(F.col("rule_id").isNull(), F.lit(None))
        .when(F.size("missing_criteria") > 0, "ambiguous").when(F.size("mismatched_criteria") > 0, "not_eligible")
        .when(F.col("rule_status").isin(*CONTINGENT), "contingent").when(F.col("rule_status").isin(*UNSUPPORTED), "unsupported").when(F.col("rule_status").isin(*FINAL), "eligible").otherwise("unsupported")
    )
    rows = rows.withColumn("eligibility_status", status)
    return rows.withColumn("eligibility_confidence", F.when(F.col("eligibility_status").isin("not_eligible", "eligible"), "Medium").when(F.col("rule_id").isNotNull(), "Low"))


def best_rule(evaluated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each scenario's results (``keys`` name it) the most preferred status; of equals the rule listed first."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(p) for p in PREFERENCE)), F.col("eligibility_status")), F.lit(99))
    order = Window.partitionBy(*keys).orderBy(rank, F.asc_nulls_last("position"), "rule_id")
    return evaluated.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn")


def quantified_delta(points: Column, depth: Column) -> Column:
    """The largest number of days among the points whose depth is at most the commitment's; null without any."""
    return F.array_max(F.transform(F.filter(points, lambda p: p["commitment_depth_pct"] <= depth), lambda p: p["estimated_timeline_delta_days"]))


def benefit(rows: DataFrame) -> DataFrame:
    """Rows of ``best_rule`` joined with a rollup (median_duration_days, p75_duration_days, confidence): the benefit, or why there is none."""
    zero = lambda c: F.nullif(F.col(c), F.lit(0.0))
    rows = rows.withColumn("baseline_timeline_days", F.coalesce(zero("p75_duration_days"), zero("median_duration_days")))
    rows = rows.withColumn("_delta", quantified_delta(F.col("benefit_points"), F.col("commitment_depth_pct")))
    status = (
        F.when((F.col("confidence") == "Insufficient") | F.col("baseline_timeline_days").isNull(), "insufficient_baseline")
        .when(F.col("rule_id").isNull(), "unsupported").when(F.col("eligibility_status") == "ambiguous", "contingent").when(F.col("eligibility_status").isin("not_eligible", "unsupported"), "unsupported")
        .when(~F.col("rule_status").isin(*FINAL), "contingent").when(F.col("_delta").isNull(), "qualitative_only").otherwise("quantified")
    )
    rows = rows.withColumn("benefit_status", status)
    known = F.when(F.col("benefit_status") == "quantified", F.least("_delta", "baseline_timeline_days"))
    return rows.withColumns({"estimated_timeline_delta_days": F.round(known, 2), "with_flex_timeline_days": F.round(F.col("baseline_timeline_days") - known, 2)}).drop("_delta")


def sweep(scenarios: DataFrame, rules: DataFrame, rollups: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Every scenario at every commitment depth: cost, eligibility, benefit and, where a day's value is given, net benefit.

    ``scenarios`` also have the assumption's fields and value_per_day_usd (may be null); ``rollups`` has one row per
    scenario_id. The rollup is joined once, the levels are exploded, nothing is computed twice.
    """
    points = scenarios.drop("commitment_depth_pct").withColumn("commitment_depth_pct", F.explode(F.array(*(F.lit(float(v)) for v in levels))))
    chosen = best_rule(eligibility(compute_cost(points), rules), ["scenario_id", "commitment_depth_pct"])
    measures = rollups.select("scenario_id", "metric_id", "sample_n", "fallback_level", "confidence", "median_duration_days", "p75_duration_days", "source_snapshot_id")
    rows = benefit(chosen.join(measures, "scenario_id", "left"))
    net = F.when((F.col("benefit_status") == "quantified") & F.col("value_per_day_usd").isNotNull(), F.round(F.col("estimated_timeline_delta_days") * F.col("value_per_day_usd") - F.col("estimated_compute_cost_usd"), 2))
    return rows.withColumn("net_benefit_score", net)


def recommend(points: DataFrame) -> DataFrame:
    """Each scenario's point of largest net benefit (of equals the smallest depth); comparison only where no point has one."""
    rows = points.groupBy("scenario_id").agg(F.count("*").alias("points"), F.count("net_benefit_score").alias("scored"), F.max(F.when(F.col("net_benefit_score").isNotNull(), F.struct("net_benefit_score", (-F.col("commitment_depth_pct")).alias("d")))).alias("_best"))
    return rows.select(
        "scenario_id", F.when(F.col("scored") > 0, "max_net_benefit_under_assumptions").otherwise("scenario_comparison_only").alias("mode"), (-F.col("_best.d")).alias("commitment_depth_pct"), F.col("_best.net_benefit_score").alias("net_benefit_score")
    )


def nearest_level(points: DataFrame, depth: float) -> DataFrame:
    """Each scenario's swept point nearest to ``depth``; of equals the smaller."""
    order = Window.partitionBy("scenario_id").orderBy(F.abs(F.col("commitment_depth_pct") - depth), "commitment_depth_pct")
    return points.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn")


def rules_with_sources(rules: DataFrame, sources: DataFrame, jurisdiction: str | None = None, include_context: bool = True) -> DataFrame:
    """Rules with the list of their cited sources, by label; optionally of one jurisdiction, or without context-only ones."""
    found = rules
    if jurisdiction:
        found = found.where(F.col("jurisdiction") == jurisdiction)
    if not include_context:
        found = found.where(F.col("status") != "context_only")
    cited = sources.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("citation_label", "source_id", "source_url"))).alias("citations"))
    return found.join(cited, "rule_id", "left").orderBy("jurisdiction", "rule_id")
