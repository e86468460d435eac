import datetime
import json

import pytest
from pyspark.sql import functions as F

from sparkgauge import catalog, schemas
from sparkgauge.api import Engine
from sparkgauge.operators import audit, reports, watch
from sparkgauge.plans import seeds
from sparkgauge.streaming import captures
from tests.fixtures import write_csvs


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")))
    e.ingest_files(write_csvs(tmp_path_factory.mktemp("csv")), "TST")
    e.seed_rules()
    e.seed_lead_times()
    return e


def test_ingest_is_repeatable(engine, tmp_path):
    first = engine.counts()
    assert first["records"] == first["links"] == first["citations"] == 16 and first["diff_events"] == 11 and first["snapshots"] == 2
    engine.ingest_files(write_csvs(tmp_path), "TST")
    engine.seed_rules()
    assert engine.counts() == first
    for child, key, parent in schemas.REFERENCES:
        assert engine.store.orphans(child, parent, key).isEmpty(), child


def test_core_functions(engine):
    assert engine.health()["status"] == "ok" and engine.snapshots().count() == 2
    assert [r["snapshots"] for r in engine.sources().collect()] == [1, 1]
    assert engine.diff("TST", "snap_tst_2026_01_31", "snap_tst_2026_02_28").first()["event_type"] == "ambiguous_match"
    assert engine.metrics("TST", "Alder", "Solar", 2).first()["fallback_level"] == "county_fuel"
    entity = engine.store.read("links").first()["entity_id"]
    assert engine.entity_matches(entity).count() >= 1
    brief = engine.brief("TST", fuel_type="Solar", capacity_mw=100.0, target_year=2026, question="a data center?", min_sample_n=2)
    assert brief["comparables"][0]["citation_ids"] and any("Large-load" in c for c in brief["caveats"]) and brief["markdown"].startswith("# Queue brief")
    assert reports.large_load_context("solar?") is None
    assert engine.audit("snap_tst_2026_01_31", "snap_tst_2026_02_28").count() > 0


def test_watch_runs(engine, spark):
    text = spark.createDataFrame([("watch_ferc_rm26_4", "status final"), ("watch_spp_hill_chill", "page")], "watch_source_id string, content_text string")
    one = engine.watch(text, datetime.datetime(2026, 3, 1), {"counties": [], "markets": ["TST"], "jurisdictions": []})
    queue = engine.change_events("queue").count()
    assert queue == 9 and one["raw_event_count"] == 9 + 12 and one["top_events"][0]["event_type"] == "withdrawn_project"
    two = engine.watch(text, datetime.datetime(2026, 4, 1), {"counties": [], "markets": ["TST"], "jurisdictions": []})
    # queue events are replaced, those of sources are added; unchanged pages say so
    assert engine.change_events("queue").count() == queue and two["raw_event_count"] == 9 + 24
    kinds = {(r["event_type"]): r["events"] for r in two["counts"] if r["event_domain"] == "regulatory"}
    assert kinds["source_unchanged"] == 2 and kinds["rule_needs_review"] == 1
    assert engine.watch_pair({"moves": ("withdrawn_project", "new_project")}).count() == 2
    assert [tuple(r) for r in engine.latest_pair().collect()] == [("TST", "snap_tst_2026_02_28", "snap_tst_2026_01_31")]
    assert [engine.snapshot_before("TST", d).first()["snapshot_id"] for d in ("2026-01-31", "2026-02-01", "2030-01-01")] == [None, "snap_tst_2026_01_31", "snap_tst_2026_02_28"]
    assert watch.quality_warnings(engine.store.read("records")).count() == 0
    # digests are stored: the last one, one by its id, and a period's again in its place
    assert [r["digest_id"] for r in engine.digests().collect()] == ["digest_2026-04", "digest_2026-03"] and engine.latest_digest().first()["period_label"] == "2026-04"
    kept = engine.digest("digest_2026-03").first()
    assert json.loads(kept["document"])["raw_event_count"] == one["raw_event_count"] and kept["markdown"] == one["markdown"] and kept["created_at"] == datetime.datetime(2026, 3, 1)
    assert engine.digest("digest_1999-01").isEmpty()
    engine.watch(text, datetime.datetime(2026, 4, 2), {"counties": [], "markets": ["TST"], "jurisdictions": []})
    assert engine.digests().count() == 2 and engine.latest_digest().first()["created_at"] == datetime.datetime(2026, 4, 2)


def test_counts_come_before_cuts(spark):
    found = spark.range(500).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("metric"), F.lit(1.0).alias("calculated"), F.lit(1.0).alias("official"), F.lit(0.0).alias("delta"), F.when(F.col("id") == 499, "mismatch_documented").otherwise("matched_within_tolerance").alias("status"))
    flags = spark.createDataFrame([], "snapshot_id string, flag string, records long")
    report = reports.validation_report(found, flags)
    assert report["passed"] == 499 and report["left_out"] == 300 and len(report["checks"]) == 200 and report["checks"][0]["metric"] == "m499" and "499 of 500" in report["markdown"]


def test_assumptions_and_briefs_are_stored(spark, tmp_path):
    own = Engine(spark, str(tmp_path / "own"))
    assert own.assumption()["gpu_power_kw"] == seeds.ASSUMPTION["gpu_power_kw"]
    with pytest.raises(KeyError):
        own.assumption("mine")
    own.store_assumption({"assumption_id": "mine", "gpu_power_kw": 2.0})
    own.store_assumption({"assumption_id": "mine", "gpu_power_kw": 3.0})
    assert own.assumption("mine")["gpu_power_kw"] == 3.0 and own.assumption("mine")["migratable_fraction"] == seeds.ASSUMPTION["migratable_fraction"] and own.store.read("compute_cost_assumptions").count() == 1
    with pytest.raises(ValueError):
        own.store_assumption({"assumption_id": "bad", "gpu_power_kw": 0.0})
    at = datetime.datetime(2026, 5, 1)
    first = own.keep_brief("queue", "TST Alder", {"title": "one", "markdown": "# one"}, at)
    own.keep_brief("queue", "TST Alder", {"title": "again", "markdown": "# one"}, at)
    last = own.keep_brief("queue", "TST", {"title": "two", "markdown": "# two"}, at + datetime.timedelta(days=1))
    own.keep_brief("flexibility", "s", {"title": "three", "markdown": "# three"}, at)
    assert own.briefs().count() == 3 and own.latest_brief("queue").first()["brief_id"] == last and json.loads(own.stored_brief(first).first()["document"]) == {"title": "again"}
    for column in ("procurement_strategy", "equipment_scope_mode"):
        with pytest.raises(ValueError, match="hope"):
            own.store_scenarios(spark.createDataFrame([("s", "hope")], f"scenario_id string, {column} string"))


def test_scenario_functions(engine, spark):
    row = ("s", "TST", "DEMO", "Alder", "Battery", 100.0, 20.0, 3.0, 20, True, True, False, 345.0, "at_risk_overlap", 1e6)
    scn = spark.createDataFrame([row], "scenario_id string, market string, jurisdiction string, county string, project_type string, peak_mw double, commitment_depth_pct double, event_duration_hours double, events_per_year int, dispatchable_or_curtailable boolean, metering_or_control_capability boolean, colocated_generation boolean, interconnection_voltage_kv double, procurement_strategy string, value_per_day_usd double")
    engine.store_scenarios(scn)
    assert engine.scenario("s").count() == 1
    with pytest.raises(ValueError):
        engine.store_scenarios(scn.withColumn("procurement_strategy", F.lit("hope")))
    assert engine.compute_cost(scn).first()["annual_curtailed_mwh"] == 1200.0
    assert engine.eligibility(scn).first()["eligibility_status"] == "eligible"
    assert engine.tradeoff(scn, min_sample_n=1).count() == 9
    assert engine.flexibility_brief(scn, "s", 22.0, 1)["nearest"][0]["commitment_depth_pct"] == 20.0
    brief = engine.time_to_power_brief(scn, "s", "2026-06-05", 1)
    assert len(brief["components"]) == 8 and "Overlap" in " ".join(brief["caveats"])
    assert engine.interconnection_baseline(scn, 1).count() == 1 and engine.critical_path(scn, "2026-06-05").count() == 1
    assert engine.lead_times("2026-06-05", "GSU Transformer").count() == 1 and engine.rules("DEMO").count() == 1
    assert engine.equipment_scope(scn).count() == 6


def test_checks_by_recomputation(engine):
    rows = engine.store.read("records")
    made = audit.recomputed(rows, {"snap_tst_2026_01_31": {"Active": 8}, "snap_tst_2026_02_28": {"Active": 5, "Withdrawn": 1, "Completed": 1}})
    report = reports.validation_report(made, watch.quality_warnings(rows))
    assert report["passed"] == 3 and len(report["checks"]) == 4


def test_schemas_parse():
    assert all(len(schemas.schema(t)) > 2 for t in schemas.TABLES)


def test_streamed_captures_equal_batch(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, None), ("a", 4, "y"), ("b", 1, None), ("b", 2, "z")]
    every = spark.createDataFrame(rows, "watch_source_id string, n int, content_text string").select("watch_source_id", F.timestamp_seconds("n").alias("captured_at"), "content_text")
    for part in (1, 2):
        every.where((F.unix_timestamp("captured_at") > 2) == (part == 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        captures.run_to_table(captures.changes(captures.read_captures(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    key = lambda df: sorted((r["watch_source_id"], r["captured_at"], r["parse_status"], r["previous_content_hash"]) for r in df.collect())
    streamed, batch = spark.read.parquet(str(tmp_path / "out")), watch.captures(every)
    none = lambda rows: [(a, b, c, d or "") for a, b, c, d in rows]
    assert sorted(none([(r["watch_source_id"], r["captured_at"], r["parse_status"], r["previous_content_hash"]) for r in streamed.collect()])) == sorted(none([(r["watch_source_id"], r["captured_at"], r["parse_status"], r["previous_content_hash"]) for r in batch.collect()])) and key is not None


def test_streamed_counts(spark, tmp_path):
    df = spark.createDataFrame([(10, "a"), (20, "a"), (90_000, "b")], "n int, event_type string").select(F.timestamp_seconds("n").alias("ts"), "event_type")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = captures.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["event_type"], r["events"]) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def test_every_query_agrees_with_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = catalog.oracle_sql()
    text = lambda v: "" if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)[:10] if isinstance(v, (datetime.date, datetime.datetime)) else str(v)
    for name, query in catalog.queries().items():
        if name not in sql:
            continue
        got = query(spark, sf)
        found = con.execute(sql[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(got.columns), name
        rows = sorted(tuple(text(v) for v in r) for r in got.select(*sorted(names)).collect())
        at = [names.index(n) for n in sorted(names)]
        assert rows == sorted(tuple(text(r[i]) for i in at) for r in found.fetchall()), name
