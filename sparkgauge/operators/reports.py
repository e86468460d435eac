"""Documents at the driver's edge: small tables are collected and set as structures and Markdown."""

from __future__ import annotations

import datetime
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, events, flexibility

#: Rows of a brief's table, at most.
SHOWN = 12
LARGE_LOAD = ("data center", "large load", "load", "ai campus")


def rows(df: DataFrame, limit: int | None = SHOWN) -> list[dict]:
    """At most ``limit`` rows (None: all, for tables of a fixed size) as dictionaries with plain values."""
    return [json.loads(json.dumps(r.asDict(recursive=True), default=str)) for r in (df if limit is None else df.limit(limit)).collect()]


def shown(df: DataFrame, limit: int = SHOWN) -> tuple[list[dict], int]:
    """(at most ``limit`` rows, how many more there are): counted before the cut."""
    return rows(df, limit), max(0, df.count() - limit)


def more(left_out: int) -> list[str]:
    return [f"{left_out} more rows are left out here."] if left_out else []


def markdown_table(found: Sequence[Mapping[str, object]], columns: Sequence[str]) -> str:
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in found])


def markdown(title: str, sections: Mapping[str, object]) -> str:
    """A document: texts as they are, lists as bullets or, if of rows, as tables."""
    out = [f"# {title}"]
    for name, body in sections.items():
        out += ["", f"## {name}"]
        if isinstance(body, str):
            out.append(body)
        elif body and isinstance(body[0], Mapping):
            out.append(markdown_table(body, list(body[0])))
        else:
            out += [f"- {x}" for x in body] or ["None."]
    return "\n".join(out) + "\n"


def large_load_context(question: str | None) -> str | None:
    """A caveat if a question is about large loads: the records are of generation, not of load."""
    if question and any(t in question.lower() for t in LARGE_LOAD):
        return "Large-load context is cited apart: the records are generation requests, not a public queue of loads."
    return None


def queue_brief(records: DataFrame, diffs: DataFrame, rollup: DataFrame, citations: DataFrame, fuel: str | None = None, county: str | None = None, capacity_mw: float | None = None, year: int | None = None, question: str | None = None) -> dict:
    """Scope, metric, changes and comparables of one market's latest snapshot, with a citation for each comparable."""
    scope = audit.scope_rows(records, county, fuel)
    near = audit.with_citations(audit.comparables(records, fuel, county, capacity_mw, year), citations) if fuel else None
    statuses = rows(records.groupBy("normalized_status").agg(F.count("*").alias("records")).orderBy("normalized_status"), 20)
    document = {
        "title": "Queue brief", "statuses": statuses, "scope": rows(scope.select("queue_id", "project_name", "county", "normalized_fuel_type", "capacity_mw", "normalized_status", "target_cod")),
        "metric": (rows(rollup, 1) or [None])[0], "changes": rows(diffs.where("event_type <> 'unchanged'").orderBy("event_type", "entity_id").select("event_type", "entity_id", "severity", "confidence")),
        "comparables": rows(near.select("queue_id", "project_name", "capacity_mw", "capacity_distance_mw", "target_cod_year_match", "citation_ids"), 5) if near is not None else [],
    }
    caveats = ["A sample-aware historical proxy, not a formal study.", *filter(None, [large_load_context(question)])]
    sections = {"Statuses": statuses, "Records": document["scope"], "Metric": [f"{k}: {v}" for k, v in (document["metric"] or {}).items()], "Changes": document["changes"], "Comparables": document["comparables"], "Caveats": caveats}
    return document | {"caveats": caveats, "markdown": markdown("Queue brief", sections)}


def digest(change_events: DataFrame, period: str, top_n: int = 10, now: datetime.datetime | None = None) -> dict:
    """The monthly digest of all stored events: the highest hard alerts, by domain, and what was suppressed."""
    cached = change_events.select("change_event_id", "event_domain", "event_type", "entity_or_provision", "entity_id", "materiality_score", "is_hard_alert", "explanation")
    hard = events.top(change_events, top_n).select(*cached.columns)
    # one row for each type of event, of which there is a fixed list
    counts = rows(cached.groupBy("event_domain", "event_type").agg(F.count("*").alias("events"), F.count_if("is_hard_alert").alias("hard_alerts")).orderBy("event_domain", "event_type"), None)
    suppressed, hidden = shown(events.suppressed(change_events).select("event_type", "entity_or_provision", "materiality_score", "explanation"), top_n)
    document = {
        "digest_id": f"digest_{period}", "period_label": period, "created_at": str(now) if now else None, "raw_event_count": sum(r["events"] for r in counts), "hard_alert_count": events.dedup(change_events).count(),
        "counts": counts, "top_events": rows(hard, top_n), "suppressed": suppressed, "suppressed_left_out": hidden,
    }
    top = [{k: r[k] for k in ("event_type", "entity_or_provision", "materiality_score", "explanation")} for r in document["top_events"]]
    return document | {"markdown": markdown(f"Change digest {period}", {"Hard alerts": top, "Counts": counts, "Suppressed": suppressed, "Left out": more(hidden)})}


def flexibility_brief(points: DataFrame, sources: DataFrame, scenario_id: str, depth: float) -> dict:
    """One scenario's sweep, the point nearest the asked depth, the recommendation, and the rules behind them."""
    own = points.where(F.col("scenario_id") == scenario_id)
    points_shown, points_hidden = shown(own.orderBy("commitment_depth_pct").select("commitment_depth_pct", "annual_curtailed_mwh", "estimated_compute_cost_usd", "benefit_status", "estimated_timeline_delta_days", "net_benefit_score", "is_extrapolated"), 50)
    nearest = rows(flexibility.nearest_level(own, depth).select("commitment_depth_pct", "benefit_status", "net_benefit_score", "rule_id", "rule_status"), 1)
    choice = rows(flexibility.recommend(own), 1)
    cited, cited_hidden = shown(sources.join(own.select("rule_id").distinct(), "rule_id", "left_semi").orderBy("citation_label"), 20)
    caveats = ["Scenario arithmetic under stated assumptions, not a prediction."]
    if any(r["is_extrapolated"] for r in points_shown):
        caveats.append("Depths beyond the demonstrated one are extrapolated.")
    if any(r["rule_status"] not in flexibility.FINAL for r in nearest):
        caveats.append("The rule isn't final.")
    sections = {"Points": points_shown, "Nearest": nearest, "Recommendation": choice, "Sources": cited, "Caveats": caveats, "Left out": more(points_hidden + cited_hidden)}
    return {"scenario_id": scenario_id, "points": points_shown, "nearest": nearest, "recommendation": choice, "citations": cited, "caveats": caveats, "markdown": markdown("Flexibility brief", sections)}


def time_to_power_brief(estimates: DataFrame, components: DataFrame, scenario_id: str) -> dict:
    """One scenario's ranges by case, its parts and verdicts."""
    one = rows(estimates.where(F.col("scenario_id") == scenario_id), 1)
    if not one:
        raise KeyError(scenario_id)
    est = one[0]
    cases = [{"case": c, "low_days": est[f"{c}_low_days"], "high_days": est[f"{c}_high_days"]} for c in ("no_flex_serial", "flex_serial", "no_flex_overlap", "flex_overlap")]
    parts = rows(components.where(F.col("scenario_id") == scenario_id).orderBy("position").drop("scenario_id"), 20)
    verdict = {k: est[k] for k in ("estimate_status", "selected_case", "binding_constraint", "estimate_confidence")}
    caveats = ["A planning artefact from public data, not a study, quote or guarantee."]
    caveats += ["Overlap assumes procurement before approval."] if est.get("procurement_strategy") == "at_risk_overlap" else []
    caveats += ["Lead-time sources are stale."] if est.get("stale_flag") else []
    caveats += ["Lead-time sources conflict; all are kept."] if est.get("conflict_flag") else []
    sections = {"Cases": cases, "Parts": parts, "Verdict": [f"{k}: {v}" for k, v in verdict.items()], "Caveats": caveats}
    return {"scenario_id": scenario_id, "cases": cases, "components": parts, **verdict, "caveats": caveats, "markdown": markdown("Time to power", sections)}


def stored(spark: SparkSession, document: Mapping[str, object], now: datetime.datetime, **ids: str) -> DataFrame:
    """A document as one row of a table: its ids, created_at, the document as JSON, and its Markdown."""
    body = {k: v for k, v in document.items() if k != "markdown"}
    row = (*ids.values(), now.replace(tzinfo=None), json.dumps(body, sort_keys=True, default=str), document["markdown"])
    return spark.createDataFrame([row], ", ".join(f"{k} string" for k in ids) + ", created_at timestamp_ntz, document string, markdown string")


def latest(documents: DataFrame, key: str) -> DataFrame:
    """The document made last; of several at one time the one with the largest id."""
    return documents.orderBy(F.desc("created_at"), F.desc(key)).limit(1)


def validation_report(checks: DataFrame, warnings: DataFrame) -> dict:
    """Recomputation checks and data-quality warnings as one document."""
    (found, hidden), (flags, unflagged) = shown(checks.orderBy(F.col("status") == "matched_within_tolerance", "metric"), 200), shown(warnings.orderBy("snapshot_id", "flag"), 200)
    # all checks count, and those that failed come first
    statuses = {r["status"]: r["count"] for r in checks.groupBy("status").count().collect()}
    passed, total = statuses.get("matched_within_tolerance", 0), sum(statuses.values())
    return {"passed": passed, "status_counts": statuses, "left_out": hidden + unflagged, "checks": found, "warnings": flags, "markdown": markdown("Validation", {"Checks": found, "Data quality": flags, "Summary": f"{passed} of {total} checks passed."})}
