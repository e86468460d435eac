"""What the service's endpoints did, as functions over a store: the same groups, defaults and results.

HTTP, downloads and the user interface are outside the engine: callers hand over files and texts.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators import audit, diff, events, flexibility, procurement, reports, rollup, timeline, watch
from .plans import pipelines, seeds
from .sources.store import Store


def slug_of(text: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in text.lower())


class Engine:
    """One store and the functions on it; each returns a DataFrame or a document."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    # core
    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version, "tables": sorted(t for t in schemas.TABLES if self.store.has(t))}

    def reset(self) -> None:
        self.store.reset()

    def counts(self) -> dict[str, int]:
        return self.store.counts(list(schemas.TABLES))

    def snapshots(self) -> DataFrame:
        return self.store.read("snapshots").orderBy("snapshot_date", "snapshot_id")

    def snapshot_before(self, market: str, date: str) -> DataFrame:
        """The market's latest snapshot before a date; null without one."""
        asked = self.spark.createDataFrame([(market, date)], "market string, as_of string").withColumn("as_of", F.col("as_of").cast("date"))
        return watch.snapshots_before(asked, self.store.read("snapshots"))

    def latest_pair(self) -> DataFrame:
        """Each market's latest snapshot and the one before it: what a comparison takes by default."""
        return watch.latest_pair(self.store.read("snapshots"))

    def sources(self) -> DataFrame:
        found = self.store.read("snapshots")
        return audit.source_counts(found.select("source_id", F.col("source_url").alias("source_name")).distinct(), found)

    def ingest_files(self, pattern: str, market: str, mode: str = "blocked") -> dict[str, int]:
        return pipelines.ingest_files(self.spark, self.store, pattern, market, mode)

    def ingest_manual(self, path: str, market: str, today: datetime.date) -> dict[str, int]:
        """One file that someone hands over; records and snapshots of other dates and markets stay."""
        return pipelines.ingest_manual(self.spark, self.store, path, market, today)

    def ingest_monthly(self, workbooks: Mapping[str, str], market: str) -> dict[str, int]:
        return pipelines.ingest_monthly(self.spark, self.store, workbooks, market)

    def ingest_national(self, path: str) -> dict[str, int]:
        return pipelines.ingest_national(self.spark, self.store, path)

    def diff(self, market: str, from_snapshot: str, to_snapshot: str) -> DataFrame:
        return diff.read_back(self.store.read("diff_events"), market, from_snapshot, to_snapshot)

    def entity_matches(self, entity_id: str) -> DataFrame:
        return audit.entity_matches(self.store.read("links"), self.store.read("records"), entity_id)

    def metrics(self, market: str, county: str | None = None, fuel_type: str | None = None, min_sample_n: int = rollup.MIN_SAMPLE, keep: bool = False) -> DataFrame:
        """One request's rollup; ``keep`` also appends it to the stored rollups."""
        asked = self.spark.createDataFrame([("request", market, county, fuel_type)], "request_id string, market string, county string, fuel_type string")
        found = rollup.rollup(self.store.read("records"), asked, min_sample_n)
        if keep:
            self.store.append("metric_rollups", found)
        return found

    def brief(self, market: str, county: str | None = None, fuel_type: str | None = None, capacity_mw: float | None = None, target_year: int | None = None, question: str | None = None, min_sample_n: int = rollup.MIN_SAMPLE) -> dict:
        latest = rollup.latest_snapshot(self.store.read("records").where(F.col("market") == market))
        return reports.queue_brief(latest, self.store.read("diff_events").where(F.col("market") == market), self.metrics(market, county, fuel_type, min_sample_n), self.store.read("citations"), fuel_type, county, capacity_mw, target_year, question)

    def audit(self, from_snapshot: str, to_snapshot: str) -> DataFrame:
        return audit.audit(self.store.read("records"), self.store.read("links"), self.store.read("diff_events"), self.store.read("snapshots"), from_snapshot, to_snapshot)

    # flexibility
    def seed_rules(self) -> None:
        self.store.insert_absent("flexibility_rules", seeds.rules(self.spark), ["rule_id"])
        self.store.insert_absent("flexibility_rule_sources", seeds.rule_sources(self.spark), ["rule_id", "source_id"])

    def rules(self, jurisdiction: str | None = None, include_context: bool = True) -> DataFrame:
        return flexibility.rules_with_sources(self.store.read("flexibility_rules"), self.store.read("flexibility_rule_sources"), jurisdiction, include_context)

    def store_scenarios(self, scenarios: DataFrame) -> None:
        """Scenarios by id; a strategy or mode of scope that isn't known is refused, with the values in question."""
        for column, known in (("procurement_strategy", timeline.STRATEGIES), ("equipment_scope_mode", timeline.SCOPE_MODES)):
            if column in scenarios.columns:
                other = [r[0] for r in scenarios.where(~F.col(column).isin(*known)).select(column).distinct().limit(5).collect()]
                if other:
                    raise ValueError(f"{column} must be one of {known}, not {other}")
        self.store.upsert("scenarios", scenarios, ["scenario_id"])

    def scenario(self, scenario_id: str) -> DataFrame:
        return self.store.read("scenarios").where(F.col("scenario_id") == scenario_id).limit(1)

    def store_assumption(self, assumption: Mapping[str, object]) -> None:
        """An assumption by its id, checked; what it doesn't name is as in the default one."""
        whole = {**seeds.ASSUMPTION, **assumption}
        flexibility.check_assumption(whole)
        kinds = {f.name: f.dataType.simpleString() for f in schemas.schema("compute_cost_assumptions")}
        kinds = {k: kinds.get(k, "string" if isinstance(v, str) else "double") for k, v in whole.items()}
        row = tuple(str(v) if kinds[k] == "string" else int(v) if kinds[k] in ("int", "bigint") else float(v) for k, v in whole.items())
        self.store.upsert("compute_cost_assumptions", self.spark.createDataFrame([row], ", ".join(f"{k} {t}" for k, t in kinds.items())), ["assumption_id"])

    def assumption(self, assumption_id: str = seeds.ASSUMPTION["assumption_id"]) -> dict[str, object]:
        """A stored assumption; the default one is there without being stored."""
        found = self.store.read("compute_cost_assumptions").where(F.col("assumption_id") == assumption_id).first() if self.store.has("compute_cost_assumptions") else None
        if found is not None:
            return found.asDict()
        if assumption_id == seeds.ASSUMPTION["assumption_id"]:
            return dict(seeds.ASSUMPTION)
        raise KeyError(assumption_id)

    def compute_cost(self, scenarios: DataFrame, assumption: Mapping[str, object] | None = None) -> DataFrame:
        assumption = assumption or seeds.ASSUMPTION
        flexibility.check_assumption(assumption)
        return flexibility.compute_cost(scenarios.withColumns({c: F.lit(float(assumption[c])) for c in flexibility.ASSUMPTION_COSTS}))

    def eligibility(self, scenarios: DataFrame) -> DataFrame:
        return flexibility.eligibility(scenarios, self.store.read("flexibility_rules"))

    def tradeoff(self, scenarios: DataFrame, assumption: Mapping[str, object] | None = None, min_sample_n: int = rollup.MIN_SAMPLE) -> DataFrame:
        return pipelines.sweep(self.spark, self.store.read("records"), scenarios, assumption, min_sample_n)

    def flexibility_brief(self, scenarios: DataFrame, scenario_id: str, depth: float, min_sample_n: int = rollup.MIN_SAMPLE) -> dict:
        return reports.flexibility_brief(self.tradeoff(scenarios, None, min_sample_n), seeds.rule_sources(self.spark), scenario_id, depth)

    # watcher
    def watch(self, content: DataFrame, captured_at: datetime.datetime, watchlist: Mapping[str, Sequence[str]] = events.EMPTY_WATCHLIST) -> dict:
        return pipelines.watch_run(self.spark, self.store, content, captured_at, watchlist)

    def digests(self) -> DataFrame:
        """The stored digests, the last one first."""
        return self.store.read("digests").orderBy(F.desc("created_at"), F.desc("digest_id"))

    def latest_digest(self) -> DataFrame:
        return reports.latest(self.store.read("digests"), "digest_id")

    def digest(self, digest_id: str) -> DataFrame:
        return self.store.read("digests").where(F.col("digest_id") == digest_id)

    # stored briefs
    def keep_brief(self, kind: str, subject: str, brief: Mapping[str, object], now: datetime.datetime) -> str:
        """Store a brief; the same kind, subject and time replaces it. Returns its id."""
        brief_id = f"{kind}_{slug_of(subject)}_{now:%Y%m%d%H%M%S}"
        self.store.upsert("briefs", reports.stored(self.spark, brief, now, brief_id=brief_id, kind=kind), ["brief_id"])
        return brief_id

    def briefs(self, kind: str | None = None) -> DataFrame:
        found = self.store.read("briefs").orderBy(F.desc("created_at"), F.desc("brief_id"))
        return found.where(F.col("kind") == kind) if kind else found

    def latest_brief(self, kind: str) -> DataFrame:
        return reports.latest(self.briefs(kind), "brief_id")

    def stored_brief(self, brief_id: str) -> DataFrame:
        return self.store.read("briefs").where(F.col("brief_id") == brief_id)

    def change_events(self, domain: str | None = None) -> DataFrame:
        return events.listing(self.store.read("change_events"), domain)

    def watch_sources(self) -> DataFrame:
        return self.store.read("watch_sources").orderBy("watch_source_id")

    def watch_pair(self, categories: dict[str, tuple[str, ...]]) -> DataFrame:
        return watch.pair_sections(self.store.read("change_events"), categories)

    # procurement and time to power
    def seed_lead_times(self) -> None:
        self.store.insert_absent("equipment_lead_times", seeds.lead_times(self.spark), ["lead_time_id"])

    def lead_times(self, as_of: str, equipment_class: str | None = None) -> DataFrame:
        found = procurement.lead_times(self.store.read("equipment_lead_times"), as_of)
        return found.where(F.col("equipment_class") == equipment_class) if equipment_class else found

    def equipment_scope(self, scenarios: DataFrame) -> DataFrame:
        return procurement.equipment_scope(scenarios)

    def critical_path(self, scenarios: DataFrame, as_of: str, stale_months: int = procurement.STALE_MONTHS) -> DataFrame:
        return procurement.critical_path(procurement.equipment_scope(scenarios), self.store.read("equipment_lead_times"), as_of, stale_months)

    def interconnection_baseline(self, scenarios: DataFrame, min_sample_n: int = rollup.MIN_SAMPLE) -> DataFrame:
        return timeline.baseline(rollup.rollup(self.store.read("records"), timeline.baseline_requests(scenarios), min_sample_n))

    def estimate(self, scenarios: DataFrame, as_of: str, min_sample_n: int = rollup.MIN_SAMPLE) -> tuple[DataFrame, DataFrame]:
        return pipelines.estimate(self.spark, self.store.read("records"), scenarios, as_of, self.store.read("equipment_lead_times"), min_sample_n=min_sample_n)

    def time_to_power_brief(self, scenarios: DataFrame, scenario_id: str, as_of: str, min_sample_n: int = rollup.MIN_SAMPLE) -> dict:
        return reports.time_to_power_brief(*self.estimate(scenarios, as_of, min_sample_n), scenario_id)
