"""Whole runs: ingest to rollups, the monthly watch, and the time-to-power estimate; tables go to a store."""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions.text import hashed_id
from ..operators import citations, diff, events, flexibility, procurement, reports, resolve, rollup, timeline, watch
from ..sources import files, monthly, national, workbook
from ..sources.store import Store
from . import seeds


def analyse(store: Store, records: DataFrame, snapshots: DataFrame, mode: str = "blocked", min_sample_n: int = 2) -> dict[str, int]:
    """Records and snapshots to links, entities, diffs and rollups; every table is replaced, so a second run changes nothing."""
    records = scratch.materialize(records, "records")
    links = None
    for market in (r["market"] for r in snapshots.select("market").distinct().orderBy("market").collect()):
        found = resolve.resolve_market(records.where(F.col("market") == market), mode)
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = resolve.seed_links(records)
    store.overwrite("snapshots", snapshots)
    store.overwrite("records", records)
    store.overwrite("links", links)
    links = store.read("links")
    store.overwrite("entities", resolve.entities(records, links))
    store.overwrite("diff_events", diff.diff(records, links, diff.adjacent_snapshots(snapshots)))
    store.overwrite("metric_rollups", rollup.precompute(records, min_sample_n))
    store.overwrite("citations", citations.for_records(records, snapshots))
    return store.counts(["snapshots", "records", "links", "entities", "diff_events", "metric_rollups", "citations"])


def _sourced(snapshots: DataFrame, market: str, mode: str) -> DataFrame:
    return snapshots.withColumns({"source_id": hashed_id("src", F.lit(market), "_file"), "source_url": F.col("_file"), "ingestion_mode": F.lit(mode)})


def ingest_files(spark: SparkSession, store: Store, pattern: str, market: str, mode: str = "blocked", min_sample_n: int = 2) -> dict[str, int]:
    """CSV files of a pattern, each by its own header, one snapshot a date, all the way to rollups."""
    raw, snapshots = files.snapshots(spark, pattern, market)
    return analyse(store, files.normalized(raw, market), _sourced(snapshots, market, "files"), mode, min_sample_n)


def ingest_manual(spark: SparkSession, store: Store, path: str, market: str, today: datetime.date, mode: str = "blocked", min_sample_n: int = 2) -> dict[str, int]:
    """One file given by hand: its snapshot is added to those stored (one of its id is replaced), and all is analysed anew."""
    raw, snapshots = files.manual_snapshot(spark, path, market, today)
    records, snapshots = files.normalized(raw, market), _sourced(snapshots, market, "manual")
    if store.has("snapshots") and store.has("records"):
        ids = snapshots.select("snapshot_id")
        records = store.read("records").join(ids, "snapshot_id", "left_anti").unionByName(records)
        snapshots = store.read("snapshots").join(ids, "snapshot_id", "left_anti").unionByName(snapshots, allowMissingColumns=True)
    return analyse(store, records, scratch.materialize(snapshots, "snapshots"), mode, min_sample_n)


def ingest_monthly(spark: SparkSession, store: Store, workbooks: Mapping[str, str], market: str, mode: str = "blocked") -> dict[str, int]:
    """Monthly workbooks ({snapshot date: path}), merged sheet by sheet, all the way to rollups."""
    rows, named = None, []
    for date, path in sorted(workbooks.items()):
        cells = scratch.materialize(workbook.read_workbook(spark, path), "cells")
        snapshot = f"snap_{market.lower()}_{date.replace('-', '_')}"
        found = monthly.read_monthly(cells, date).withColumns({"snapshot_id": F.lit(snapshot), "snapshot_date": F.lit(date).cast("date"), "_file": F.lit(path)})
        found = files.normalized(found.withColumn("flags", F.array_join("flags", ",")), market)
        rows = found if rows is None else rows.unionByName(found)
        named.append((snapshot, market, date, path, f"src_{market.lower()}", path, "workbook"))
    snapshots = spark.createDataFrame(named, "snapshot_id string, market string, snapshot_date string, _file string, source_id string, source_url string, ingestion_mode string").withColumn("snapshot_date", F.col("snapshot_date").cast("date"))
    return analyse(store, rows, snapshots, mode)


def ingest_national(spark: SparkSession, store: Store, path: str) -> dict[str, int]:
    """A national workbook's projects; the workbook's own slice is replaced."""
    cells = scratch.materialize(workbook.read_workbook(spark, path), "cells")
    file_hash = files.fingerprints(spark, path).first()["file_hash"]
    store.replace_slice("national_records", national.projects(cells, f"national_{file_hash[:8]}"), ["workbook_id"])
    return store.counts(["national_records"])


def watch_run(spark: SparkSession, store: Store, content: DataFrame, captured_at: datetime.datetime, watchlist: Mapping[str, Sequence[str]] = events.EMPTY_WATCHLIST, period: str | None = None) -> dict:
    """One monthly run: queue events of the stored diffs (replaced), events of changed sources (appended), the digest.

    ``content``: (watch_source_id, content_text) as fetched by the caller; sources that lack it count as failed.
    """
    rules = seeds.rules(spark)
    store.insert_absent("watch_sources", watch.registry(seeds.watched(spark), rules), ["watch_source_id"])
    sources = store.read("watch_sources")
    new = watch.with_content(sources, content).withColumn("captured_at", F.lit(captured_at).cast("timestamp_ntz"))
    columns = ["watch_source_id", "captured_at", "content_text", "content_hash"]
    before = store.read("source_captures").select(*columns[:3]) if store.has("source_captures") else new.select(*columns[:3]).limit(0)
    every = watch.captures(before.withColumn("_new", F.lit(False)).unionByName(new.select(*columns[:3]).withColumn("_new", F.lit(True))))
    captured = scratch.materialize(every.where("_new").drop("_new"), "captures")
    found = watch.source_events(captured.join(sources, "watch_source_id"))
    null = F.lit(None).cast("string")
    state = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in store.read("records").select(*events.PAYLOAD).schema) + ">"
    regulatory = events.complete(found.withColumns({"before": F.lit(None).cast(state), "after": F.lit(None).cast(state), "from_snapshot_id": null, "to_snapshot_id": null, "changed_fields": F.to_json(F.struct("content_hash", "previous_content_hash", "status_keywords"))}), watchlist)
    queue = events.from_diff(store.read("diff_events"), store.read("records"), store.read("snapshots").select("snapshot_id", "source_url"), watchlist)
    made = regulatory.select(*queue.columns)
    events_now = queue.unionByName(made)
    if store.has("change_events"):
        kept = store.read("change_events").where("event_domain <> 'queue'").join(made.select("change_event_id"), "change_event_id", "left_anti")
        events_now = events_now.unionByName(kept.select(*queue.columns))
    # captures come last: a run that fails before them finds the same changes again, under the same ids
    store.overwrite("change_events", events_now)
    store.append("source_captures", captured.select(*columns))
    found = reports.digest(store.read("change_events"), period or captured_at.strftime("%Y-%m"), now=captured_at)
    # a period has one digest: a later run of it replaces the stored one
    store.upsert("digests", reports.stored(spark, found, captured_at, digest_id=found["digest_id"], period_label=found["period_label"]), ["digest_id"])
    return found


def estimate(spark: SparkSession, records: DataFrame, scenarios: DataFrame, as_of: str, lead: DataFrame | None = None, rules: DataFrame | None = None, min_sample_n: int = rollup.MIN_SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(estimates, components) of any number of scenarios: rollup, rules, equipment and commissioning, joined by scenario."""
    base = timeline.baseline(rollup.rollup(records, timeline.baseline_requests(scenarios), min_sample_n))
    chosen = flexibility.best_rule(flexibility.eligibility(scenarios, rules if rules is not None else seeds.rules(spark)), ["scenario_id"])
    flex = timeline.flex_adjusted(flexibility.benefit(chosen.join(base, "scenario_id")))
    path = procurement.critical_path(procurement.equipment_scope(scenarios), lead if lead is not None else seeds.lead_times(spark), as_of)
    found = scratch.materialize(timeline.estimate(timeline.commissioning(flex.join(path, "scenario_id"))), "estimates")
    return found, timeline.components(found)


def sweep(spark: SparkSession, records: DataFrame, scenarios: DataFrame, assumption: Mapping[str, object] | None = None, min_sample_n: int = rollup.MIN_SAMPLE, fuel: str = "Battery") -> DataFrame:
    """The trade-off points of scenarios under an assumption, with their markets' rollups as baselines."""
    assumption = assumption or seeds.ASSUMPTION
    flexibility.check_assumption(assumption)
    asked = scenarios.select(F.col("scenario_id").alias("request_id"), "market", "county", F.lit(fuel).alias("fuel_type"))
    found = rollup.rollup(records, asked, min_sample_n).withColumnRenamed("request_id", "scenario_id")
    return flexibility.sweep(scenarios.withColumns({c: F.lit(float(assumption[c])) for c in flexibility.ASSUMPTION_COSTS}), seeds.rules(spark), found)
