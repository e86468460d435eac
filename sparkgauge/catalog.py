"""The registered queries of the engine itself, each over its whole tables, and their SQL twins for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .functions import dates, normalize, text
from .operators import audit, diff, events, flexibility, national, procurement, reconcile, resolve, rollup, timeline, watch
from .plans import adapter, exchange, seeds
from .plans.adapter import ADAPTER_SQL

WATCHLIST = {"counties": ["nation d", "Nation bc"], "markets": [], "jurisdictions": []}
AS_OF = "2026-06-05"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both snapshots' records, written once for queries that read them several times."""
    return scratch.materialize(adapter.records(spark, sf_dir), "records")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- normalization, listings, counts -------------------------------------------------------------------------------

def normalize_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.records(spark, sf_dir).select(*adapter.FIELDS)


def quality_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.quality_warnings(adapter.records(spark, sf_dir))


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.records(spark, sf_dir)
    return rows.groupBy("snapshot_id", "normalized_status", "normalized_fuel_type").agg(F.count("*").alias("records"), F.round(F.sum("capacity_mw"), 2).alias("mw"))


def source_snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources and their orders as snapshots: every source is there, those without any with 0."""
    sources = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("source_name"))
    return audit.source_counts(sources, _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("snapshot_id")))


def keyword_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status words in every document's text."""
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(text.keywords_in("text", watch.STATUS_WORDS), ",").alias("keywords"), text.has_any("text", ("data center", "large load", "load", "ai campus")).alias("large_load"))


def voted_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of orders as five files write them, each with an order of its own for day and month, read by a vote."""
    day = F.to_date("o_orderdate")
    written = F.when(F.col("o_orderpriority").startswith("1"), F.date_format(day, "d/M/yyyy")).when(F.col("o_orderpriority").startswith("2"), F.date_format(day, "M/d/yyyy")).when(F.col("o_orderpriority").startswith("3"), F.date_format(day, "dd.MM.yyyy HH:mm"))
    written = written.when(F.col("o_orderpriority").startswith("4"), F.date_format(day, "MM-dd-yy")).otherwise(F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "d MMMM yyyy")).otherwise(F.date_format(day, "yyyyMMdd")))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("file"), written.alias("asked"), F.date_format(F.date_add(day, 30), "M/d/yy").alias("due"))
    return dates.voted(rows, ["asked", "due"], ["file"]).select("o_orderkey", "asked", "due")


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions over parts and customers."""
    parts = _t(spark, sf_dir, "part")
    return parts.select(
        "p_partkey", text.slug(F.concat("p_name", F.lit(" / X-"), "p_brand")).alias("slug"), text.clean_text(F.concat(F.lit("  "), "p_name", F.lit("   x "))).alias("compact"),
        normalize.capacity(F.concat(F.lit("about 1,"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" MW"))).alias("mw"), normalize.state(F.when(F.col("p_size") % 2 == 0, "Texas").otherwise(F.lower("p_type"))).alias("state"),
        normalize.fuel(F.concat("p_type", F.lit(" project"))).alias("fuel"), normalize.status(F.when(F.col("p_size") % 3 == 0, "Inactive").when(F.col("p_size") % 3 == 1, "INCOMPLETE").otherwise("n/a")).alias("status"),
        text.without_prefix("p_brand", "Brand#").alias("brand"),
    )


# --- metrics -------------------------------------------------------------------------------------------------------

METRICS = ("market", "scope_type", "scope_value", "fuel_type", "sample_n", "active_count", "active_mw", "completed_count", "withdrawn_count", "completion_rate", "withdrawal_rate", "median_duration_days", "p75_duration_days", "confidence", "fallback_level", "source_snapshot_id")


def rollup_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.scopes(adapter.records(spark, sf_dir))


def rollup_precompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.precompute(_records(spark, sf_dir)).select("request_id", *METRICS)


def rollup_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every county and fuel, with a threshold that some scopes miss; a request of another market abstains."""
    rows = _records(spark, sf_dir)
    asked = rollup.all_requests(rows).unionByName(spark.createDataFrame([("none", "NOWHERE", "Elsewhere", "Solar")], "request_id string, market string, county string, fuel_type string"))
    return rollup.rollup(rows, asked, 100).select("request_id", *METRICS)


flagship = rollup_precompute


def _national(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as national records."""
    places = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ends = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.to_date("l_shipdate")).alias("last"), F.count("*").alias("lines"))
    rows = _t(spark, sf_dir, "orders").join(places.select(F.col("c_custkey").alias("o_custkey"), "r_name"), "o_custkey").join(ends, "o_orderkey", "left")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "operational").otherwise("withdrawn")
    return rows.select(
        status.alias("q_status"), F.col("r_name").alias("region"), F.col("o_orderpriority").alias("type_clean"), F.floor("o_totalprice").cast("double").alias("mw_1"), F.when(F.col("lines") > 3, F.lit(10.0)).alias("mw_2"), F.lit(None).cast("double").alias("mw_3"),
        F.to_date("o_orderdate").alias("q_date"), F.when(status == "operational", F.col("last")).alias("on_date"), F.when(status == "withdrawn", F.col("last")).alias("wd_date"),
    )


def national_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return national.metrics(_national(spark, sf_dir), "ASIA")


def national_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return national.active_by_type(_national(spark, sf_dir))


#: The independent checks' own mapping of raw texts; what isn't here stays as it is.
MINIMAL_STATUS = {"On Hold": "Suspended", "mystery": "Unknown"}
MINIMAL_FUEL = {"Solar PV": "Solar", "BESS": "Battery", "Solar + Storage": "Hybrid", "Gas CT": "Gas", "Offshore Wind": "Wind", "": "Unknown"}


def independent_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the engine's records and national metrics against a second, plainer plan over the raw rows, which uses
    no normalizer: rows, missing ids and names, statuses, active capacity, shared ids; projects, active ones, days."""
    rows = _records(spark, sf_dir).select("snapshot_id", "queue_id", F.col("normalized_project_name").alias("name"), F.col("normalized_status").alias("status"), F.col("normalized_fuel_type").alias("fuel"), F.col("capacity_mw").alias("mw"))
    mapped = lambda c, table: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.coalesce(c, F.lit(""))), c)
    raw = scratch.materialize(adapter.raw_snapshots(spark, sf_dir), "raw").select(
        "snapshot_id", F.col("Queue No").alias("queue_id"), F.when(F.trim("Project") != "NaN", F.col("Project")).alias("name"), mapped(F.col("Status"), MINIMAL_STATUS).alias("status"), mapped(F.col("Technology"), MINIMAL_FUEL).alias("fuel"),
        F.col("Capacity (MW)").cast("double").alias("mw"),
    )
    wide = scratch.materialize(_national(spark, sf_dir), "national")
    found = national.metrics(wide, "ASIA").select(F.explode(F.array(*(F.struct(F.lit(f"national/{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in ("projects", "active", "active_gw", "region_active", "median_days")))).alias("f")).select("f.*")
    orders, active = _t(spark, sf_dir, "orders"), F.col("q_status") == "active"
    plain = orders.agg(F.count("*").alias("projects"), F.count_if(F.col("o_orderstatus") == "O").alias("active"), F.round(F.sum(F.when(F.col("o_orderstatus") == "O", F.floor("o_totalprice"))) / 1000, 4).alias("active_gw"))
    days = F.datediff(F.coalesce("on_date", "wd_date"), "q_date")
    more = wide.agg(F.count_if(active & (F.col("region") == "ASIA")).alias("region_active"), F.round(F.percentile(F.when(F.col("q_status") != "active", days), 0.5), 2).alias("median_days"))
    table = lambda df: df.select(F.explode(F.array(*(F.struct(F.lit(f"national/{c}").alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns))).alias("f")).select("f.*")
    return audit.compared(reconcile.record_figures(raw).unionByName(table(plain)).unionByName(table(more)), reconcile.record_figures(rows).unionByName(found), 0.01)


def reconciled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a copy that lacks some, has others' prices or priorities changed, some twice, and some more."""
    k = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    other = rows.where(k % 97 != 0).withColumns({"o_totalprice": F.when(k % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderpriority": F.when(k % 83 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))})
    other = other.unionByName(other.where(k % 79 == 0)).unionByName(rows.where(k % 101 == 0).withColumn("o_orderkey", -k - 1))
    found = reconcile.reconcile(rows, other, ["o_orderkey"])
    return found.withColumn("columns", F.array_join("columns", ","))


# --- diff and events -----------------------------------------------------------------------------------------------


def _diffed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = _records(spark, sf_dir)
    links = adapter.exact_links(rows)
    return rows, links, diff.diff(rows, links, diff.adjacent_snapshots(rows))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _diffed(spark, sf_dir)[2]
    return found.select("market", "from_snapshot_id", "to_snapshot_id", "entity_id", "event_type", "severity", "confidence", F.get_json_object("changed_fields", "$.target_cod.delta_days").cast("int").alias("delta_days"), F.get_json_object("changed_fields", "$.capacity_mw.after").cast("double").alias("capacity_after"))


def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.event_counts(_diffed(spark, sf_dir)[2])


def _change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, found = _diffed(spark, sf_dir)
    return events.from_diff(found, rows, None, WATCHLIST)


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _change_events(spark, sf_dir).select("event_type", "entity_id", "entity_or_provision", "materiality_score", "is_hard_alert", "is_ambiguous", "confidence")


def hard_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All deduplicated hard events; two types come twice, once with another score."""
    every = _change_events(spark, sf_dir)
    again = every.where(F.col("event_type").isin("new_project", "capacity_changed")).withColumns(
        {"materiality_score": F.col("materiality_score") + F.when(F.col("event_type") == "new_project", 1).otherwise(-1), "change_event_id": F.concat("change_event_id", F.lit("-2"))}
    )
    return events.dedup(every.unionByName(again)).select("event_type", "entity_id", "materiality_score")


def top_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's 25 highest; ties are broken by type, name and entity here, as ids are hashes."""
    hard = events.dedup(_change_events(spark, sf_dir))
    return hard.orderBy(F.desc("materiality_score"), "event_type", "entity_or_provision", "entity_id").limit(25).select("event_type", "entity_or_provision", "entity_id", "materiality_score")


def digest_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.digest_sections(_change_events(spark, sf_dir))


def entity_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, links, _ = _diffed(spark, sf_dir)
    return resolve.entities(rows, links).select("entity_id", "first_seen", "last_seen", "records", "project_name", "county", "normalized_fuel_type", "capacity_mw", "normalized_status")


def entity_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, links, found = _diffed(spark, sf_dir)
    snapshots = spark.createDataFrame([(adapter.BEFORE[0], "x"), (adapter.AFTER[0], "y")], "snapshot_id string, file_hash string")
    return audit.audit_counts(audit.audit(rows, links, found, snapshots, adapter.BEFORE[0], adapter.AFTER[0]))


def entity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, links, found = _diffed(spark, sf_dir)
    snapshots = spark.createDataFrame([(adapter.BEFORE[0], "x"), (adapter.AFTER[0], "y")], "snapshot_id string, file_hash string")
    made = audit.audit(rows, links, found, snapshots, adapter.BEFORE[0], adapter.AFTER[0])
    return made.select("entity_id", "queue_id_before", "queue_id_after", "project_name_after", "status_before", "status_after", "system_label", "match_score", "source_file_hash_before")


def id_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.records(spark, sf_dir)
    return audit.id_overlap(rows.where(F.col("snapshot_id") == adapter.BEFORE[0]), rows.where(F.col("snapshot_id") == adapter.AFTER[0]))


def comparables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's ten nearest solar projects of the later snapshot."""
    rows = adapter.records(spark, sf_dir).where(F.col("snapshot_id") == adapter.AFTER[0]).withColumn("record_id", F.col("queue_id"))
    return audit.comparables(rows, "Solar", None, 150.0, 2000, 10).select("queue_id", "project_name", "capacity_mw", "capacity_distance_mw", "target_cod_year_match", "normalized_status")


# --- resolution ----------------------------------------------------------------------------------------------------


def supplier_records(spark: SparkSession, sf_dir: str, contested: bool = False) -> DataFrame:
    """Suppliers as two snapshots: names of their own, the later ones partly renumbered, renamed, moved or gone.

    ``contested``: places of connection too, twins of odd suppliers in the earlier snapshot under ids of their own, and
    copies of every fourth in the later one, which want the same entity.
    """
    k = F.col("s_suppkey")
    name = F.concat(F.substring(F.md5(F.concat(F.lit("a"), k.cast("string"))), 1, 9), F.lit(" "), F.substring(F.md5(F.concat(F.lit("b"), k.cast("string"))), 1, 8))
    rows = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.select(k.alias("k"), name.alias("name"), "n_name", F.abs(F.floor(F.col("s_acctbal") / 50)).cast("double").alias("mw"))
    common = {"market": F.lit("SUP"), "interconnecting_entity": F.concat("name", F.lit(" power")), "county": F.col("n_name"), "state": F.lit("TX"), "normalized_fuel_type": F.element_at(F.array(*(F.lit(x) for x in ("Solar", "Wind", "Gas", "Hybrid"))), (F.col("k") % 4 + 1).cast("int")), "point_of_interconnection": F.concat("name", F.lit(" bus")) if contested else F.lit(None).cast("string"), "target_cod": F.date_add(F.lit("2027-01-01").cast("date"), (F.col("k") % 700).cast("int")), "normalized_status": F.lit("Active")}

    def snapshot(df: DataFrame, sid: str, date: str, queue, project, mw) -> DataFrame:
        named = df.withColumns(common | {"queue_id": queue, "project_name": project, "capacity_mw": mw, "snapshot_id": F.lit(sid), "snapshot_date": F.lit(date).cast("date")})
        return named.withColumns({"normalized_project_name": normalize.project_name("project_name"), "record_id": F.concat_ws("-", "snapshot_id", "k")}).select(*resolve.FIELDS, "market", "snapshot_id", "snapshot_date", "normalized_status")

    queue = F.concat(F.lit("S-"), F.col("k").cast("string"))
    before = snapshot(rows.where("k % 29 <> 0"), "sup_1", "2026-01-31", queue, F.col("name"), F.col("mw"))
    renamed = F.when(F.col("k") % 5 == 0, F.concat("name", F.lit(" ii"))).otherwise(F.col("name"))
    after = snapshot(rows.where("k % 23 <> 0"), "sup_2", "2026-02-28", F.when(F.col("k") % 3 == 0, F.concat(F.lit("N-"), F.col("k").cast("string"))).otherwise(queue), renamed, F.when(F.col("k") % 7 == 0, F.col("mw") * 2).otherwise(F.col("mw")))
    if contested:
        another = lambda df, kind, which: df.where(which).withColumns({"queue_id": F.concat(F.lit(f"{kind}-"), F.split_part("record_id", F.lit("-"), F.lit(2))), "record_id": F.concat("record_id", F.lit(f"-{kind}"))})
        number = F.split_part("record_id", F.lit("-"), F.lit(2)).cast("long")
        before, after = before.unionByName(another(before, "T", number % 2 == 1)), after.unionByName(another(after, "C", number % 4 == 0))
    return before.unionByName(after)


def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all suppliers across two snapshots, by the resolver. Scores and candidates are shown where they decide:
    names of different suppliers aren't alike, so SQL can say what each record's best candidate scores."""
    found = resolve.resolve_market(supplier_records(spark, sf_dir))
    decided = F.col("match_score") >= resolve.POSSIBLE
    return found.select("record_id", "snapshot_id", F.when(decided, F.col("match_score")).alias("match_score"), "match_method", "is_ambiguous", F.when(decided, F.col("candidate_record_id")).alias("candidate_record_id"))


def _contested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = scratch.materialize(supplier_records(spark, sf_dir, contested=True), "suppliers")
    return rows, resolve.resolve_market(rows)


def contested_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links where records are torn between twins (ambiguous), and where two want one entity (the first by queue id gets it)."""
    found = _contested(spark, sf_dir)[1]
    decided = F.col("match_score") >= resolve.POSSIBLE
    return found.select("record_id", "snapshot_id", F.when(decided, F.col("match_score")).alias("match_score"), "match_method", "is_ambiguous", F.when(decided, F.col("candidate_record_id")).alias("candidate_record_id"))


def contested_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of these links, ambiguous matches among them."""
    rows, links = _contested(spark, sf_dir)
    return diff.diff(rows, links, diff.adjacent_snapshots(rows)).select("event_type", "severity", "before_record_id", "after_record_id", "confidence")


def contested_audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's counts of these links: fuzzy and ambiguous ones among them."""
    rows, links = _contested(spark, sf_dir)
    found = scratch.materialize(diff.diff(rows, links, diff.adjacent_snapshots(rows)), "events")
    snapshots = spark.createDataFrame([("sup_1", "x"), ("sup_2", "y")], "snapshot_id string, file_hash string")
    return audit.audit_counts(audit.audit(rows, links, found, snapshots, "sup_1", "sup_2"))


# --- watched sources -----------------------------------------------------------------------------------------------


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captures: users are sources, every event is one."""
    k = F.col("event_id")
    content = F.when(k % 41 == 0, F.lit(None)).when(k % 7 == 0, F.lit("a final notice")).when(k % 5 == 0, F.lit("an order is pending")).otherwise(F.col("event_type"))
    return _t(spark, sf_dir, "events").select(
        F.concat(F.lit("watch_"), F.col("user_id").cast("string")).alias("watch_source_id"), F.col("event_id").alias("captured_at"), content.alias("content_text"), F.concat(F.lit("source "), F.col("user_id").cast("string")).alias("source_name"),
        F.when(F.col("user_id") % 4 == 0, "flexibility_rule").otherwise("docket").alias("source_type"), F.when(F.col("user_id") % 3 == 0, "FERC").otherwise("SPP").alias("jurisdiction"), F.lit("u").alias("source_url"),
        F.when(F.col("user_id") % 4 == 0, watch.OWN_RULES).otherwise("page").alias("parser_type"),
    )


def source_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = watch.source_events(watch.captures(_captures(spark, sf_dir)))
    return found.select("watch_source_id", "captured_at", "event_domain", "event_type", "parse_status", "content_hash", "previous_content_hash", F.array_join("status_keywords", ",").alias("keywords"), "confidence", "is_ambiguous", "is_hard_alert")


def latest_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.latest_hashes(watch.captures(_captures(spark, sf_dir)))


def monthly_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch twin of the streaming count by type and day."""
    return _t(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("value"))


# --- scenarios -----------------------------------------------------------------------------------------------------


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as scenarios, in the county of their nation, with the default assumption; some ask a market without records."""
    k = F.col("c_custkey")
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (k % len(xs) + 1).cast("int"))
    place = pick("FERC", "SPP", "PJM", "ERCOT", "DEMO", "OTHER")
    county = normalize.county(F.concat(F.translate("n_name", "_0123456789", " abcdefghij"), F.lit(" County")))
    rows = _t(spark, sf_dir, "customer").join(_t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        k.alias("k"), F.concat(F.lit("scn-"), k.cast("string")).alias("scenario_id"), place.alias("jurisdiction"), F.when(k % 10 == 0, "NOWHERE").otherwise(adapter.MARKET).alias("market"), county.alias("county"), (k % 300 + 10).cast("double").alias("peak_mw"), (k % 11 * 5).cast("double").alias("commitment_depth_pct"),
        (k % 4 + 1).cast("double").alias("event_duration_hours"), F.lit(20).alias("events_per_year"), F.when(k % 7 != 0, k % 5 != 0).alias("dispatchable_or_curtailable"), F.when(k % 13 != 0, F.lit(True)).alias("metering_or_control_capability"), (k % 2 == 0).alias("colocated_generation"),
        F.when(k % 3 != 0, (k % 50 * 1000).cast("double")).alias("value_per_day_usd"), pick("AI Data Center Load", "Battery", "Solar + Storage", "Wind").alias("project_type"), F.when(k % 19 != 0, (k % 5 * 100).cast("double")).alias("interconnection_voltage_kv"),
        pick("serial_after_approval", "procurement_started", "at_risk_overlap").alias("procurement_strategy"),
    )
    return rows.withColumns({c: F.lit(seeds.ASSUMPTION[c]) for c in flexibility.ASSUMPTION_COSTS})


def _rollups(spark: SparkSession, sf_dir: str, scn: DataFrame) -> DataFrame:
    """Each scenario's rollup of the records: its county and stand-in fuel, or the next wider scope with enough of them."""
    return rollup.rollup(_records(spark, sf_dir), timeline.baseline_requests(scn)).withColumn("scenario_id", F.col("request_id"))


def compute_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flexibility.compute_cost(scenarios(spark, sf_dir))
    return found.select("scenario_id", F.round("annual_curtailed_mwh", 2).alias("annual_curtailed_mwh"), F.round("gpu_hours_impacted", 1).alias("gpu_hours_impacted"), F.round("estimated_compute_cost_usd", 1).alias("estimated_compute_cost_usd"), "is_extrapolated")


def eligibility_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flexibility.eligibility(scenarios(spark, sf_dir), seeds.rules(spark))
    return found.select("scenario_id", "rule_id", "rule_status", "eligibility_status", "eligibility_confidence", F.size("missing_criteria").alias("missing"), F.size("mismatched_criteria").alias("mismatched"))


def eligibility_by_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix again, its criteria checked by a caller's table function."""
    found = flexibility.eligibility(scenarios(spark, sf_dir), seeds.rules(spark), evaluate=flexibility.checked_criteria())
    return found.select("scenario_id", "rule_id", "rule_status", "eligibility_status", "eligibility_confidence", F.size("missing_criteria").alias("missing"), F.size("mismatched_criteria").alias("mismatched"))


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    scn = scenarios(spark, sf_dir)
    return flexibility.sweep(scn, seeds.rules(spark), _rollups(spark, sf_dir, scn))


def tradeoff_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sweep(spark, sf_dir).select("scenario_id", "commitment_depth_pct", "eligibility_status", "benefit_status", "baseline_timeline_days", "estimated_timeline_delta_days", "with_flex_timeline_days", F.round("net_benefit_score", 0).alias("net_benefit_score"))


def tradeoff_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flexibility.recommend(_sweep(spark, sf_dir)).select("scenario_id", "mode", "commitment_depth_pct", F.round("net_benefit_score", 0).alias("net_benefit_score"))


def _lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lead-time rows of the scoped classes; some lack a source, and one class has none."""
    k = F.col("p_partkey")
    classes = ("Large Power Transformer", "HV Switchgear / GIS", "Medium-Voltage Switchgear", "GSU Transformer", "Interconnection Facilities")
    return _t(spark, sf_dir, "part").select(
        F.concat(F.lit("lead-"), k.cast("string")).alias("lead_time_id"), F.element_at(F.array(*(F.lit(c) for c in classes)), (k % 5 + 1).cast("int")).alias("equipment_class"), F.col("p_brand").alias("voltage_or_rating_band"),
        (k % 20 + 6).cast("double").alias("lead_time_low_months"), (k % 20 + 6 + F.col("p_size") % 30).cast("double").alias("lead_time_high_months"), F.add_months(F.lit("2026-05-01").cast("date"), -(k % 30).cast("int")).alias("as_of_date"),
        F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (k % 3 + 1).cast("int")).alias("confidence"), F.when(k % 9 != 0, "u").alias("source_url"), F.lit(18).alias("stale_threshold_months"),
    )


def lead_time_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return procurement.lead_times(_lead(spark, sf_dir), AS_OF).select("lead_time_id", "equipment_class", "is_stale", "conflict_flag")


def equipment_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return procurement.equipment_scope(scenarios(spark, sf_dir)).select("scenario_id", "position", "equipment_class", "scope_item_id", "scope_mode")


def critical_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = procurement.critical_path(procurement.equipment_scope(scenarios(spark, sf_dir)), _lead(spark, sf_dir), AS_OF)
    return found.withColumn("missing_equipment", F.array_join("missing_equipment", ","))


def missing_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return procurement.missing_classes(procurement.equipment_scope(scenarios(spark, sf_dir)), _lead(spark, sf_dir))


def _estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scn, rules = scenarios(spark, sf_dir), seeds.rules(spark)
    base = timeline.baseline(_rollups(spark, sf_dir, scn))
    chosen = flexibility.best_rule(flexibility.eligibility(scn, rules), ["scenario_id"])
    flex = timeline.flex_adjusted(flexibility.benefit(chosen.join(base, "scenario_id")))
    path = procurement.critical_path(procurement.equipment_scope(scn), _lead(spark, sf_dir), AS_OF)
    return timeline.estimate(timeline.commissioning(flex.join(path, "scenario_id")))


def time_to_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = [f"{f}_{k}_{s}_days" for k in ("serial", "overlap") for f in ("no_flex", "flex") for s in ("low", "high")]
    return _estimates(spark, sf_dir).select("scenario_id", "benefit_status", *totals, "estimate_status", "selected_case", "binding_constraint", "estimate_confidence")


def time_to_power_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.components(_estimates(spark, sf_dir))


QUERIES = (
    normalize_records, quality_flag_counts, status_counts, source_snapshot_counts, keyword_guard, voted_dates, text_functions, rollup_scopes, rollup_precompute, rollup_fallback, national_metrics, national_by_type, independent_checks, reconciled_orders, snapshot_diff, diff_counts, change_events,
    hard_alerts, top_alerts, digest_sections, entity_dimension, entity_audit, entity_audit_counts, id_overlap, comparables, resolve_links, contested_links, contested_diff, contested_audit_counts, source_change_events, latest_hashes, monthly_event_counts, compute_costs, eligibility_matrix, eligibility_by_udtf, tradeoff_sweep,
    tradeoff_recommendation, lead_time_conflicts, equipment_scopes, critical_paths, missing_classes, time_to_power, time_to_power_components, *exchange.QUERIES,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return oracles.all_sql(ADAPTER_SQL)
