"""The driver's order tables as two monthly snapshots of raw queue records, by arithmetic on the order key.

The later snapshot drops some records, renumbers some, and changes names, places of connection, technologies, sizes,
statuses and dates of others, so that every rule of the diff but the ambiguous match occurs; some dates, names and
statuses are written as messy files have them. A DuckDB view with the same rows is in ``ADAPTER_SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize

MARKET = "SYN"
BEFORE, AFTER = ("snap_syn_2026_01_31", "2026-01-31"), ("snap_syn_2026_02_28", "2026-02-28")
#: Raw technology by the part's type.
TECHNOLOGY = {"ECONOMY": "Solar PV", "STANDARD": "BESS", "MEDIUM": "Wind", "PROMO": "Solar + Storage", "LARGE": "Gas CT"}
RAW = ("Queue No", "Project", "Interconnecting Entity", "County", "State", "POI", "Technology", "Capacity (MW)", "Status", "Request Date", "Target COD", "Actual COD", "Withdrawn Date")
#: What queries show of a normalized record.
FIELDS = ("snapshot_id", "queue_id", "project_name", "normalized_project_name", "county", "state", "point_of_interconnection", "fuel_type", "normalized_fuel_type", "capacity_mw", "normalized_status", "request_date", "target_cod", "actual_cod", "withdrawn_date")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw record per order: joins of orders with customer, nation, region, a part by key arithmetic, and the last shipping date."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = t("part")
    shipped = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max(F.to_date("l_shipdate")).alias("shipped"))
    n_parts = parts.agg(F.count("*").alias("n")).first()["n"]
    orders = t("orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("ordered")).withColumn("p_partkey", F.col("k") % n_parts)
    places = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = orders.join(places.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "n_name", "r_name"), "o_custkey")
    rows = rows.join(parts.select("p_partkey", "p_name", "p_type", "p_brand"), "p_partkey").join(shipped, "k", "left")
    technology = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TECHNOLOGY.items() for x in kv)), F.col("p_type")), F.lit(""))
    return rows.select(
        "k", F.concat(F.lit("Q-"), F.col("k").cast("string")).alias("queue_no"), F.concat("p_name", F.lit(" "), "c_mktsegment", F.lit(" LLC")).alias("project"), F.col("c_name").alias("entity"),
        F.concat(F.translate("n_name", "_0123456789", " abcdefghij"), F.lit(" County")).alias("county"), F.col("r_name").alias("state"), F.col("p_brand").alias("poi"), technology.alias("technology"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("mw"), F.col("o_orderstatus").alias("letter"), "ordered", "shipped",
    )


def raw_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both snapshots' raw rows under the raw headers, as text, with snapshot_id, snapshot_date and raw_id."""
    k = F.col("k")
    status = F.when(k % 59 == 0, "mystery").when(F.col("letter") == "F", "Completed").when(F.col("letter") == "P", "On Hold").otherwise("Active")
    target = F.date_add("ordered", 1000)
    text = lambda c: c.cast("string")

    asked = F.when(k % 3 == 0, F.date_format("ordered", "M/d/yyyy")).when(k % 3 == 1, F.date_format("ordered", "MMM d, yyyy")).otherwise(text(F.col("ordered")))
    named = F.when(k % 61 == 0, " NaN ").otherwise(F.col("project"))

    def row(snapshot: tuple[str, str], queue: Column, mw: Column, state: Column, cod: Column, name: Column = named, poi: Column = F.col("poi"), technology: Column = F.col("technology")) -> Column:
        values = (queue, name, F.col("entity"), F.col("county"), F.col("state"), poi, technology, text(mw), state, asked, text(cod), F.when(state == "Completed", text(F.col("shipped"))), F.when(state == "Withdrawn", text(F.date_add("ordered", 500))))
        return F.struct(*(v.alias(n) for n, v in zip(RAW, values, strict=True)), F.lit(snapshot[0]).alias("snapshot_id"), F.lit(snapshot[1]).cast("date").alias("snapshot_date"), F.concat_ws("-", F.lit(snapshot[0]), text(k)).alias("raw_id"))

    later_status = F.when((k % 11 == 0) & (F.col("letter") != "F"), "Withdrawn").when(k % 23 == 0, "Completed").when(k % 29 == 0, "On Hold").otherwise(status)
    later_name = F.when(k % 43 == 0, F.regexp_replace(named, " LLC$", " Two LLC")).otherwise(named)
    later = (later_name, F.when(k % 47 == 0, F.concat("poi", F.lit(" North"))).otherwise(F.col("poi")), F.when(k % 41 == 0, "Offshore Wind").otherwise(F.col("technology")))
    later_cod = F.when(k % 17 == 0, F.date_add(target, 200)).when(k % 19 == 0, F.date_sub(target, 120)).otherwise(target)
    before = row(BEFORE, F.col("queue_no"), F.col("mw"), status, target)
    after = row(AFTER, F.when(k % 31 == 0, F.concat(F.lit("R-"), text(k))).otherwise(F.col("queue_no")), F.when(k % 13 == 0, F.col("mw") * 1.25).otherwise(F.col("mw")), later_status, later_cod, *later)
    # both months come of one pass over the joins
    months = F.filter(F.array(F.when(k % 37 != 0, before), F.when(k % 10 != 0, after)), lambda r: r.isNotNull())
    return base(spark, sf_dir).select(F.explode(months).alias("r")).select("r.*")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both snapshots, normalized."""
    return normalize.normalize(raw_snapshots(spark, sf_dir), MARKET, F.col("snapshot_id"), F.col("snapshot_date"), "raw_id")


def exact_links(rows: DataFrame) -> DataFrame:
    """Links by equal queue ids only (a mode of its own, for keys that are known to be stable): the id is the entity."""
    return rows.select(
        "record_id", "snapshot_id", F.col("queue_id").alias("entity_id"), F.lit(1.0).alias("match_score"), F.lit("exact_queue_id").alias("match_method"), F.lit(False).alias("is_ambiguous"),
        F.lit(None).cast("string").alias("candidate_record_id"), F.lit("{}").alias("match_features"),
    )


#: DuckDB: ``raw`` (both snapshots) and ``rec`` (normalized) as common table expressions, by means of its own.
ADAPTER_SQL = r"""
    shipped AS (SELECT l_orderkey AS k, max(l_shipdate::DATE) AS shipped FROM lineitem GROUP BY 1),
    base AS (
        SELECT o_orderkey AS k, p_name || ' ' || c_mktsegment || ' LLC' AS project, c_name AS entity, translate(n_name, '_0123456789', ' abcdefghij') AS place, r_name AS state, p_brand AS poi,
               CASE p_type WHEN 'ECONOMY' THEN 'Solar PV' WHEN 'STANDARD' THEN 'BESS' WHEN 'MEDIUM' THEN 'Wind' WHEN 'PROMO' THEN 'Solar + Storage' WHEN 'LARGE' THEN 'Gas CT' END AS technology,
               floor(o_totalprice / 1000)::DOUBLE AS mw, o_orderstatus AS letter, o_orderdate::DATE AS ordered, shipped
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
        JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part) LEFT JOIN shipped ON shipped.k = o_orderkey),
    raw AS (
        SELECT * REPLACE (CASE WHEN k % 61 <> 0 THEN project END AS project), 'snap_syn_2026_01_31' AS snapshot_id, DATE '2026-01-31' AS snapshot_date, 'Q-' || k AS queue_id, mw AS capacity_mw,
               CASE WHEN k % 59 = 0 THEN 'mystery' WHEN letter = 'F' THEN 'Completed' WHEN letter = 'P' THEN 'On Hold' ELSE 'Active' END AS status, ordered + 1000 AS target_cod
        FROM base WHERE k % 37 <> 0
        UNION ALL
        SELECT * REPLACE (CASE WHEN k % 61 = 0 THEN NULL WHEN k % 43 = 0 THEN left(project, length(project) - 3) || 'Two LLC' ELSE project END AS project, CASE WHEN k % 47 = 0 THEN poi || ' North' ELSE poi END AS poi,
                          CASE WHEN k % 41 = 0 THEN 'Offshore Wind' ELSE technology END AS technology),
               'snap_syn_2026_02_28', DATE '2026-02-28', CASE WHEN k % 31 = 0 THEN 'R-' ELSE 'Q-' END || k, CASE WHEN k % 13 = 0 THEN mw * 1.25 ELSE mw END,
               CASE WHEN k % 11 = 0 AND letter <> 'F' THEN 'Withdrawn' WHEN k % 23 = 0 THEN 'Completed' WHEN k % 29 = 0 THEN 'On Hold' WHEN k % 59 = 0 THEN 'mystery' WHEN letter = 'F' THEN 'Completed' WHEN letter = 'P' THEN 'On Hold' ELSE 'Active' END,
               ordered + 1000 + CASE WHEN k % 17 = 0 THEN 200 WHEN k % 19 = 0 THEN -120 ELSE 0 END
        FROM base WHERE k % 10 <> 0),
    rec AS (
        SELECT snapshot_id, snapshot_date, k, queue_id, project AS project_name, lower(regexp_replace(project, ' LLC$', '')) AS normalized_project_name, entity AS interconnecting_entity,
               array_to_string(list_transform(string_split(place, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS county, upper(substr(state, 1, 2)) AS state, poi AS point_of_interconnection, technology AS fuel_type,
               CASE WHEN technology IS NULL THEN 'Unknown' WHEN technology = 'Solar + Storage' THEN 'Hybrid' WHEN technology = 'BESS' THEN 'Battery' WHEN technology = 'Solar PV' THEN 'Solar' WHEN technology LIKE '%Wind' THEN 'Wind' ELSE 'Gas' END AS normalized_fuel_type,
               capacity_mw, CASE status WHEN 'On Hold' THEN 'Suspended' WHEN 'mystery' THEN 'Unknown' ELSE status END AS normalized_status, status AS raw_status, ordered AS request_date, target_cod,
               CASE WHEN status = 'Completed' THEN shipped END AS actual_cod, CASE WHEN status = 'Withdrawn' THEN ordered + 500 END AS withdrawn_date
        FROM raw)
"""
