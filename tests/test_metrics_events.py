import datetime

import pytest
from pyspark.sql import functions as F

from sparkgauge.operators import events, national, rollup, watch
from sparkgauge.plans import seeds


@pytest.fixture(scope="module")
def records(spark):
    d = datetime.date
    rows = [
        ("M", "s2", d(2026, 2, 1), "A", "Solar", "Completed", 50.0, d(2020, 1, 1), d(2021, 1, 1), None), ("M", "s2", d(2026, 2, 1), "A", "Solar", "Withdrawn", 60.0, d(2020, 1, 1), None, d(2020, 1, 11)),
        ("M", "s2", d(2026, 2, 1), "A", "Wind", "Active", None, d(2020, 1, 1), None, None), ("M", "s2", d(2026, 2, 1), "B", "Wind", "Active", 70.0, None, None, None),
        ("M", "s2", d(2026, 2, 1), None, "Wind", "Completed", 70.0, None, d(2021, 1, 1), None), ("M", "s1", d(2026, 1, 1), "A", "Solar", "Active", 999.0, None, None, None),
    ]
    return spark.createDataFrame(rows, "market string, snapshot_id string, snapshot_date date, county string, normalized_fuel_type string, normalized_status string, capacity_mw double, request_date date, actual_cod date, withdrawn_date date")


def ask(spark, records, n, *rows):
    asked = spark.createDataFrame(rows, "request_id string, market string, county string, fuel_type string")
    return {r["request_id"]: r for r in rollup.rollup(records, asked, n).collect()}


def test_fallback_takes_the_narrowest_scope(spark, records):
    got = ask(spark, records, 2, ("a", "M", "A", "Solar"), ("b", "M", "A", "Wind"), ("c", "M", "B", "Solar"), ("d", "M", None, None), ("e", "M", "", "Wind"))
    assert [got[k]["fallback_level"] for k in "abcde"] == ["county_fuel", "county_all_fuels", "market_fuel", "market_all", "market_fuel"]
    a = got["a"]
    assert (a["sample_n"], a["completion_rate"], a["withdrawal_rate"], a["median_duration_days"], a["p75_duration_days"]) == (2, 0.5, 0.5, 188.0, 277.0)
    assert got["d"]["active_mw"] == 70.0 and got["d"]["confidence"] == "Low" and got["d"]["sample_n"] == 5


def test_abstention(spark, records):
    got = ask(spark, records, 100, ("a", "M", "A", "Solar"), ("x", "ELSEWHERE", "A", "Solar"))
    assert (got["a"]["fallback_level"], got["a"]["sample_n"], got["a"]["confidence"], got["a"]["completion_rate"]) == ("lbnl_national_all", 0, "Insufficient", None)
    assert (got["x"]["scope_type"], got["x"]["fallback_level"], got["x"]["source_snapshot_id"]) == ("requested", "none", None)


def test_precompute_is_repeatable(records):
    once, again = (sorted(map(str, rollup.precompute(records).collect())) for _ in range(2))
    assert once == again and len(once) == 4


STATE = "struct<record_id:string,snapshot_id:string,market:string,queue_id:string,project_name:string,county:string,state:string,point_of_interconnection:string,normalized_fuel_type:string,capacity_mw:double,normalized_status:string,target_cod:date>"


def event(spark, kind, before=None, after=None, days=None, ambiguous=False, county=None, n="1"):
    cod = datetime.date(2026, 1, 1)
    state = lambda mw, d: (None, None, None, None, None, county, None, None, None, mw, None, d)
    row = ("queue", kind, "M", None, "P", "E" + n, None, "c" + n, state(before, cod), state(after, cod + datetime.timedelta(days or 0)), "{}", ambiguous, "", 1.0)
    return spark.createDataFrame([row], f"event_domain string, event_type string, market string, jurisdiction string, entity_or_provision string, entity_id string, rule_id string, change_event_id string, before {STATE}, after {STATE}, changed_fields string, is_ambiguous boolean, explanation string, confidence double")


def test_materiality(spark):
    score = lambda *a, watch=None, **k: events.complete(event(spark, *a, **k), watch or events.EMPTY_WATCHLIST).first()["materiality_score"]
    on = {"counties": ["alder"], "markets": [], "jurisdictions": []}
    assert score("name_changed", after=10.0, county="Alder", watch=on) == 25.0
    assert score("withdrawn_project", after=200.0, county="Alder", watch=on) == 73.0103
    assert score("ambiguous_match", after=500.0, county="Alder", watch=on) == 36.9897
    assert score("withdrawn_project", before=100.0, after=0.0) == 60.0  # zero falls back to what was before
    assert score("capacity_changed", before=80.0, after=90.0) == pytest.approx(20 + 19.5424 + 10.0)
    assert [score("target_cod_delayed", after=1.0, days=d) for d in (90, 91, 181, 366)] == [25.0, 30.0, 35.0, 40.0]
    assert score("something_else") == 10.0


def test_hard_alerts_dedup_and_order(spark):
    rows = [event(spark, "withdrawn_project", after=100.0, n="1"), event(spark, "withdrawn_project", after=100.0, n="1").withColumn("change_event_id", F.lit("c0")), event(spark, "name_changed", after=1000.0, n="2"), event(spark, "ambiguous_match", after=1000.0, ambiguous=True, n="3"), event(spark, "source_parse_failed", n="4"), event(spark, "source_parse_failed", n="4").withColumn("change_event_id", F.lit("c5"))]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    scored = events.complete(every)
    assert {r["event_type"] for r in events.suppressed(scored).collect()} == {"name_changed", "ambiguous_match"}
    assert [(r["event_type"], r["change_event_id"]) for r in events.top(scored, 5).collect()] == [("withdrawn_project", "c0"), ("source_parse_failed", "c4"), ("source_parse_failed", "c5")]


def test_captures_and_reviews(spark):
    rules = seeds.rules(spark)
    sources = watch.registry(seeds.watched(spark), rules)
    assert sources.count() == 12
    text = spark.createDataFrame([("watch_ferc_rm26_4", "status final"), ("watch_spp_hill_chill", "an order"), ("watch_ferc_large_load_update_2026_04_16", "an order"), *((f"watch_flex_{r[0]}", f"final {r[0]}") for r in seeds.RULES)], "watch_source_id string, content_text string")
    first = watch.with_content(sources, text).withColumn("captured_at", F.lit(1))
    both = first.unionByName(first.withColumn("captured_at", F.lit(2)))
    found = watch.source_events(watch.captures(both))
    count = lambda at: {r["event_type"]: r["count"] for r in found.where(F.col("captured_at") == at).groupBy("event_type").count().collect()}
    assert count(1) == {"rule_needs_review": 2, "rule_source_changed": 7, "source_parse_failed": 3}
    assert count(2) == {"source_unchanged": 9, "source_parse_failed": 3}
    row = found.where("watch_source_id like 'watch_flex%'").first()
    assert row["event_domain"] == "flexibility_rule" and row["rule_id"].startswith("rule_")


def test_national_metrics(spark):
    d = datetime.date
    rows = [("active", "R", "Solar", 100.0, 50.0, None, None, None, None), ("active", "S", "Wind", None, None, None, None, None, None), ("withdrawn", "R", "Wind", 10.0, None, None, d(2020, 1, 1), None, d(2020, 1, 11)), ("operational", "R", "Wind", 10.0, None, None, d(2020, 1, 1), d(2020, 1, 21), None)]
    df = spark.createDataFrame(rows, "q_status string, region string, type_clean string, mw_1 double, mw_2 double, mw_3 double, q_date date, on_date date, wd_date date")
    assert tuple(national.metrics(df, "R").first()) == (4, 2, 0.1, 0.15, 1, 0.1, 15.0)
    assert [r["type_clean"] for r in national.active_by_type(df).collect()] == ["Solar", "Wind"]


def test_no_key_gathers_all_rows(spark, sf):
    """Snapshots, markets and missing ids deal no rows: at any size such joins are broadcast or spread."""
    from pyspark.sql import functions as F

    from sparkgauge.functions.text import spread_key
    from sparkgauge.operators import diff, rollup
    from sparkgauge.plans import adapter

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = adapter.records(spark, sf)
        for frame in (diff.diff(rows, adapter.exact_links(rows), diff.adjacent_snapshots(rows)), rollup.latest_snapshot(rows), rollup.rollup(rows, rollup.all_requests(rows))):
            plan = frame._jdf.queryExecution().sparkPlan().toString()
            joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
            assert not [line for line in joins if line.split("[", 1)[1].startswith(("market#", "snapshot_id#")) and "entity_id#" not in line], joins
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = spark.range(50).select(spread_key(F.lit(None).cast("string"), F.col("id").cast("string")).alias("k"))
    assert keys.distinct().count() == 50
