"""The driver's tables written as files and read by the engine's sources, and changed by the store: whole round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import scratch
from ..operators import asof
from ..sources import files, monthly, store, workbook
from ..streaming import captures
from . import adapter

MONTH = "2026-01-31"
_CELLS = "sheet string, sheet_no int, row_no int, cells array<string>"
#: Labels of the sheets that the monthly workbook is made of.
HEADERS = {
    "Project Details - Large Gen": ("INR", "Project Name", "County", "Projected COD", "Fuel", "Technology", "Capacity (MW)"),
    "Project Details - Small Gen": ("INR", "Project Name", "County", "Projected COD", "Fuel", "Technology", "Capacity (MW)"),
    "Commissioning Update": ("INR", "Project Name", "Commissioning Category", "Approval Date *", "MW **", "Fuel", "County"),
    "Inactive Projects": ("INR", "Project Name", "Inactive Date", "MW **", "Fuel", "County"),
    "Cancellation Update": ("INR", "Project Name", "Cancel Date", "MW **", "Fuel", "County"),
}


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


#: The later month's files name the columns otherwise, and have them in another order.
RENAMED = {"Queue No": "INR", "Project": "Project Name", "Interconnecting Entity": "Developer", "County": "County Name", "State": "ST", "POI": "Substation", "Technology": "Generation Type", "Capacity (MW)": "MW", "Status": "Queue Status", "Request Date": "Queue Date", "Target COD": "Projected COD", "Actual COD": "Online Date", "Withdrawn Date": "Withdrawal Date"}

#: Rows of a CSV file at most, about 50 MB.
FILE_ROWS = 250_000


def _csv_files(spark: SparkSession, sf_dir: str) -> str:
    """Both snapshots as CSV files, a folder each, as many files as Spark's tasks write, more where a task has over
    ``FILE_ROWS`` rows; every row names its date.

    Each month is written by itself: the readers date a file by its rows, so no file may hold two months. The earlier
    one has the adapter's headers, the later one other names of them, in the opposite order, and a column more.
    """
    to = scratch.path(spark, "queue-csv")
    rows = scratch.materialize(adapter.raw_snapshots(spark, sf_dir).withColumn("Snapshot Date", F.col("snapshot_date").cast("string")), "raw")
    store.write_csv(rows.where(F.col("snapshot_id") == adapter.BEFORE[0]), f"{to}/{adapter.BEFORE[0]}", (*adapter.RAW, "Snapshot Date"), file_rows=FILE_ROWS)
    later = rows.where(F.col("snapshot_id") == adapter.AFTER[0]).select("Snapshot Date", F.concat(F.lit('a "note",'), F.lit("\n"), "State").alias("Remark"), *(F.col(c).alias(RENAMED[c]) for c in reversed(adapter.RAW)))
    store.write_csv(later, f"{to}/{adapter.AFTER[0]}", tuple(later.columns), file_rows=FILE_ROWS)
    return f"{to}/*/*.csv"


def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records normalized from the CSV files, whose headers differ and whose snapshots are found in their contents."""
    raw, _ = files.snapshots(spark, _csv_files(spark, sf_dir), adapter.MARKET)
    return files.normalized(raw, adapter.MARKET).select(*adapter.FIELDS)


def csv_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots that these files make: one row a date, however many files it has."""
    _, found = files.snapshots(spark, _csv_files(spark, sf_dir), adapter.MARKET)
    return found.select("market", "snapshot_id", "snapshot_date", "row_count", (F.length("file_hash") == 64).alias("hashed"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a month's workbook: two project sheets, some ids on both, and three sheets of signals, some ids only there."""
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    later = lambda days: text(F.date_add(F.to_date("o_orderdate"), days))
    queue_id = F.concat(F.lit("21INR"), text(k))
    size = F.when(k % 11 != 0, text(F.floor(F.col("o_totalprice") / 1000)))
    fuel = [F.when(k % 9 != 0, F.element_at(F.array(*(F.lit(x) for x in xs)), (k % 4 + 1).cast("int"))) for xs in (("SOL", "WIN", "OTH", "NUC"), ("PV", "WT", "BA", "ST"))]
    place = F.when(k % 8 != 0, F.concat(F.lit("C"), text(k % 50)))

    def project(name: str) -> tuple[Column, ...]:
        return (queue_id, F.concat(F.lit(name), text(k)), place, later(1000), *fuel, size)

    def signal(*values: Column) -> tuple[Column, ...]:
        return (queue_id, F.concat(F.lit("Signal "), text(k)), *values)

    category = F.when(k % 2 == 0, "Approved for Commercial Operation").otherwise("Energization")
    there = {
        "Project Details - Large Gen": ((k % 5 != 0) & ((k % 2 == 0) | (k % 10 == 1)), project("Large ")),
        "Project Details - Small Gen": ((k % 5 != 0) & (k % 2 == 1), project("Small ")),
        "Commissioning Update": ((F.col("o_orderstatus") == "F") & (k % 3 == 0), signal(category, later(1100), F.lit("70"), F.lit("GAS"), F.lit("Birch"))),
        "Inactive Projects": (k % 4 == 0, signal(later(500), F.lit("7"), F.lit("GAS"), F.lit("Cedar"))),
        "Cancellation Update": (k % 7 == 0, signal(later(600), F.lit("9"), F.lit("OIL"), F.lit("Dogwood"))),
    }
    numbers = {sheet: i for i, sheet in enumerate(HEADERS)}
    # a row's number is its key's, so that no order has to be made
    rows = F.array(*(F.when(where, F.struct(F.lit(s).alias("sheet"), F.lit(numbers[s]).alias("sheet_no"), (k % 1_000_000_000 + 2).cast("int").alias("row_no"), F.array(*values).alias("cells"))) for s, (where, values) in there.items()))
    body = _orders(spark, sf_dir).select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")
    heads = [row for s, labels in HEADERS.items() for row in ((s, numbers[s], 0, ["A month's report"]), (s, numbers[s], 1, list(labels)), (s, numbers[s], 2, ["a note", "no row"]))]
    return spark.createDataFrame(heads, _CELLS).unionByName(body)


def monthly_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workbook's project rows with the signals merged in."""
    found = monthly.read_monthly(scratch.materialize(cells(spark, sf_dir), "cells"), MONTH)
    names = {"queue_id": "Queue ID", "project_name": "Project Name", "county": "County", "fuel_type": "Fuel Type", "capacity_mw": "Capacity (MW)", "status": "Status", "target_cod": "Target COD", "actual_cod": "Actual COD", "withdrawn_date": "Withdrawn Date", "last_updated": "Last Updated", "sheet": "sheet", "signal": "signal"}
    return found.select(*(F.col(f"`{label}`").alias(name) for name, label in names.items()), F.array_join(F.array_sort("flags"), ",").alias("flags"))


def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended, upserted, added where absent, updated and deleted: the table as it is then."""
    kept = store.Store(spark, scratch.path(spark, "store"))
    k, key = F.col("o_orderkey"), ["o_orderkey"]
    rows = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    kept.append("orders", rows.where(k % 3 != 0))
    kept.upsert("orders", rows.where(k % 2 == 0).withColumn("o_totalprice", F.col("o_totalprice") * 2), key)
    kept.insert_absent("orders", rows.withColumn("o_orderpriority", F.lit("late")), key)
    kept.update("orders", rows.where(k % 5 == 0).select("o_orderkey", F.lit("X").alias("o_orderstatus")), key)
    kept.delete("orders", rows.where(k % 7 == 0).select("o_orderkey"))
    return kept.read("orders")


def store_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status, of which one status' slice is replaced by fewer rows; the others stay."""
    kept = store.Store(spark, scratch.path(spark, "store"))
    rows = _orders(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderstatus")
    kept.replace_slice("orders", rows, ["o_orderstatus"])
    kept.replace_slice("orders", rows.where("o_orderstatus = 'F' AND o_orderkey % 2 = 0").withColumn("o_totalprice", -F.col("o_totalprice")), ["o_orderstatus"])
    return kept.read("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")


def store_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer isn't in a table of some of the customers: the check of a foreign key."""
    kept = store.Store(spark, scratch.path(spark, "store"))
    kept.append("orders", _orders(spark, sf_dir).select("o_orderkey", "o_custkey"))
    kept.append("customers", spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey").where("c_custkey % 3 <> 0"))
    return kept.orphans("orders", "customers", "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


def _workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as workbooks, one a month, written and read back: a sheet of open and one of closed orders, with a title above
    the header, columns of which two have one label, and notes between."""
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    is_open = F.col("o_orderstatus") == "O"
    sheet, number = F.when(is_open, "Open").otherwise("Closed"), F.when(is_open, 0).otherwise(1)
    book = F.concat(F.lit("orders-"), F.date_format("o_orderdate", "yyyy-MM"), F.lit(".xlsx"))
    place = Window.partitionBy("_file", "sheet").orderBy("k")
    values = F.array(F.concat(F.when(k % 3 == 0, "x").otherwise("21INR"), text(k)), F.concat(F.lit("P <"), text(k % 17), F.lit("> & Co")), text(F.to_date("o_orderdate")), text(F.floor("o_totalprice")), F.when(k % 5 != 0, F.col("o_orderpriority")), F.col("o_orderstatus"))
    body = _orders(spark, sf_dir).select(book.alias("_file"), sheet.alias("sheet"), number.alias("sheet_no"), k.alias("k"), values.alias("cells")).withColumn("row_no", F.row_number().over(place) + 2).drop("k")
    title = lambda n, *cells: body.select("_file", "sheet", "sheet_no").distinct().select("*", F.array(*(F.lit(c) for c in cells)).alias("cells"), F.lit(n).alias("row_no"))
    rows = body.unionByName(title(0, "A month's orders")).unionByName(title(1, "INR", "Project Name", "Queue Date", "MW", "Status", "Status"))
    return scratch.materialize(workbook.rows_of(scratch.materialize(workbook.pack(rows), "workbooks")), "cells")


def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all sheets of all these workbooks, each by its own header."""
    found, at = workbook.tables(_workbooks(spark, sf_dir), ("INR", "Project Name")), lambda label: F.col("values")[label]
    return found.select("_file", "sheet", "_row", at("INR").alias("queue_id"), at("Project Name").alias("project_name"), at("Queue Date").cast("date").alias("queue_date"), at("MW").cast("double").alias("mw"), at("Status").alias("priority"), at("Status.1").alias("status"))


def workbook_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sheet's header row, labels, mapped fields and rows with an id."""
    found = workbook.profile(_workbooks(spark, sf_dir))
    mapped = F.array_join(F.array_sort(F.transform(F.map_entries("mapping"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return found.select("_file", "sheet", "header_row", F.array_join("columns", ",").alias("labels"), "rows_with_id", mapped.alias("mapping"))


def latest_event_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's latest event of a user before a moment: orders are asked about moments of the events' month."""
    users = 150
    k = F.col("o_orderkey")
    asked = _orders(spark, sf_dir).select("o_orderkey", (k % users).alias("user_id"), F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + k * 7919 % (31 * 86400)).alias("asked_at"))
    found = spark.read.parquet(f"{sf_dir}/events.parquet")
    return asof.latest_before(asked, found, ["user_id"], "asked_at", "ts", ("event_id", "event_type", "value"), tie=("event_id",))


def event_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as captures: users are watched sources, an event's type is the content, some can't be read."""
    content = F.when(F.col("event_id") % 41 != 0, F.col("event_type"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat(F.lit("watch_"), F.col("user_id").cast("string")).alias("watch_source_id"), F.col("ts").cast("timestamp").alias("captured_at"), content.alias("content_text"))


def write_arrivals(spark: SparkSession, sf_dir: str, folder: str, days: int = 10) -> None:
    """The captures as files in the order of their arrival, some of them up to half an hour behind later ones."""
    behind = F.pmod(F.xxhash64("watch_source_id", "captured_at"), F.lit(1800))
    rows = event_captures(spark, sf_dir).withColumn("_stretch", F.floor((F.unix_seconds("captured_at") + behind) / (days * 86_400)))
    rows = scratch.materialize(rows, "arrivals")
    for stretch in sorted(r["_stretch"] for r in rows.select("_stretch").distinct().collect()):
        rows.where(F.col("_stretch") == stretch).drop("_stretch").coalesce(1).write.mode("append").parquet(folder)


def streamed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of watched sources as a stream finds them, file after file, in a store's table: captures that the watermark
    has passed, an hour before the last one."""
    arrivals, place = scratch.path(spark, "arrivals"), scratch.path(spark, "stream")
    write_arrivals(spark, sf_dir, arrivals)
    kept = store.Store(spark, f"{place}/store")
    with captures.with_rocksdb(spark):
        captures.run_to_store(captures.ordered_changes(captures.read_captures(spark, arrivals, 1)), kept, "changes", f"{place}/checkpoint")
    return kept.read("changes").select("watch_source_id", "captured_at", "content_hash", "previous_content_hash", "parse_status")


QUERIES = (csv_records, csv_snapshots, monthly_merge, store_changes, store_slices, store_orphans, workbook_rows, workbook_profile, latest_event_before, streamed_changes)

_BOOKS = """books AS (SELECT o_orderkey AS k, strftime(o_orderdate::DATE, 'orders-%Y-%m.xlsx') AS _file, CASE WHEN o_orderstatus = 'O' THEN 'Open' ELSE 'Closed' END AS sheet,
    CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '21INR' END || o_orderkey AS queue_id, 'P <' || (o_orderkey % 17) || '> & Co' AS project_name, o_orderdate::DATE AS queue_date, floor(o_totalprice)::DOUBLE AS mw,
    CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority, o_orderstatus AS status FROM orders)"""

#: DuckDB, by means of its own; ``csv_records`` has the SQL of ``normalize_records``, whose rows it must give.
SQL = {
    "monthly_merge": """WITH o AS (
            SELECT o_orderkey AS k, o_orderdate::DATE AS d, o_orderkey % 5 <> 0 AS p, o_orderstatus = 'F' AND o_orderkey % 6 = 0 AS c, o_orderkey % 4 = 0 AS i, o_orderkey % 7 = 0 AS x, o_orderkey % 2 = 0 OR o_orderkey % 10 = 1 AS large,
                   CASE WHEN o_orderkey % 11 <> 0 THEN floor(o_totalprice / 1000)::DOUBLE END AS mw, CASE WHEN o_orderkey % 9 <> 0 THEN ['Solar', 'Wind', 'Battery Storage', 'NUC ST'][o_orderkey % 4 + 1] END AS fuel FROM orders)
        SELECT '21INR' || k AS queue_id, CASE WHEN NOT p THEN 'Signal ' WHEN large THEN 'Large ' ELSE 'Small ' END || k AS project_name,
               coalesce(CASE WHEN p AND k % 8 <> 0 THEN 'C' || (k % 50) END, CASE WHEN c THEN 'Birch' WHEN i THEN 'Cedar' WHEN x THEN 'Dogwood' END) AS county,
               coalesce(CASE WHEN p THEN fuel END, CASE WHEN c OR i THEN 'Gas' WHEN x THEN 'Fuel Oil' END) AS fuel_type,
               coalesce(CASE WHEN p THEN nullif(mw, 0) END, CASE WHEN c THEN 70.0 WHEN i THEN 7.0 WHEN x THEN 9.0 END, CASE WHEN p THEN mw END)::DOUBLE AS capacity_mw,
               CASE WHEN x THEN 'Withdrawn' WHEN c THEN 'Completed' WHEN i THEN 'Inactive' ELSE 'Active' END AS status, CASE WHEN p THEN d + 1000 END AS target_cod, CASE WHEN c THEN d + 1100 END AS actual_cod,
               CASE WHEN x THEN d + 600 WHEN c THEN NULL WHEN i THEN d + 500 END AS withdrawn_date, DATE '2026-01-31' AS last_updated,
               array_to_string(list_filter([CASE WHEN p AND large THEN 'Project Details - Large Gen' WHEN p THEN 'Project Details - Small Gen' END, CASE WHEN c THEN 'Commissioning Update' END, CASE WHEN i THEN 'Inactive Projects' END, CASE WHEN x THEN 'Cancellation Update' END], lambda s: s IS NOT NULL), ' + ') AS sheet,
               CASE WHEN x THEN 'developer_cancelled' WHEN c THEN 'commercial_operation_approved' WHEN i THEN 'inactive_project' END AS signal,
               array_to_string(list_sort(list_filter([CASE WHEN p AND fuel IS NULL THEN 'missing_fuel_type' END, CASE WHEN p AND mw IS NULL THEN 'missing_capacity_mw' END, CASE WHEN c THEN 'status_signal:commercial_operation_approved' END, CASE WHEN i THEN 'status_signal:inactive_project' END, CASE WHEN x THEN 'status_signal:developer_cancelled' END], lambda s: s IS NOT NULL)), ',') AS flags
        FROM o WHERE p OR c OR i OR x""",
    "workbook_rows": f"""WITH {_BOOKS} SELECT _file, sheet, 2 + row_number() OVER (PARTITION BY _file, sheet ORDER BY k) AS _row, queue_id, project_name, queue_date, mw, priority, status FROM books""",
    "workbook_profile": f"""WITH {_BOOKS} SELECT _file, sheet, 1 AS header_row, 'INR,Project Name,Queue Date,MW,Status,Status.1' AS labels, count(*) FILTER (starts_with(queue_id, '21INR')) AS rows_with_id,
        'capacity_mw=MW,project_name=Project Name,queue_id=INR,request_date=Queue Date,status=Status' AS mapping FROM books GROUP BY ALL""",
    "latest_event_before": """WITH q AS (SELECT o_orderkey, o_orderkey % 150 AS user_id, TIMESTAMP '2024-01-01' + to_seconds(o_orderkey * 7919 % (31 * 86400)) AS asked_at FROM orders)
        SELECT o_orderkey, q.user_id, asked_at, event_id, event_type, value FROM q ASOF LEFT JOIN events e ON q.user_id = e.user_id AND q.asked_at > e.ts""",
    "streamed_changes": """WITH h AS (SELECT 'watch_' || user_id AS watch_source_id, ts AS captured_at, CASE WHEN event_id % 41 <> 0 THEN sha256(event_type) END AS content_hash FROM events),
        p AS (SELECT *, last_value(content_hash IGNORE NULLS) OVER (PARTITION BY watch_source_id ORDER BY captured_at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_content_hash FROM h)
        SELECT *, CASE WHEN content_hash IS NULL THEN 'failed' WHEN content_hash = previous_content_hash THEN 'unchanged' ELSE 'changed' END AS parse_status
        FROM p WHERE date_trunc('milliseconds', captured_at + INTERVAL 999 MICROSECOND) < (SELECT date_trunc('milliseconds', max(ts)) FROM events) - INTERVAL 1 HOUR""",
    "store_changes": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END * o_totalprice AS o_totalprice,
        CASE WHEN o_orderkey % 6 = 3 THEN 'late' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0""",
    "store_slices": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END * o_totalprice AS o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0",
    "store_orphans": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)",
}
