import datetime
import hashlib
import json
import re
import tracemalloc
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkgauge.sources import files, monthly, national, store, workbook
from tests.fixtures import HEADER, write_csvs, write_xlsx


def test_csv_snapshots(spark, tmp_path):
    raw, snapshots = files.snapshots(spark, write_csvs(tmp_path), "TST")
    got = {r["snapshot_id"]: r for r in snapshots.collect()}
    assert sorted(got) == ["snap_tst_2026_01_31", "snap_tst_2026_02_28"] and got["snap_tst_2026_01_31"]["row_count"] == 8 and len(got["snap_tst_2026_01_31"]["file_hash"]) == 64
    rows = files.normalized(raw, "TST")
    assert rows.count() == 16 and rows.select("record_id").distinct().count() == 16
    assert sorted(r["record_id"] for r in rows.collect()) == sorted(r["record_id"] for r in files.normalized(raw, "TST").collect())


def test_date_from_file_name_and_manual_file(spark, tmp_path):
    (tmp_path / "q_2025-11.csv").write_text("INR,Project\nX1,One\n")
    _, snapshots = files.snapshots(spark, f"{tmp_path}/q_*.csv", "T")
    assert snapshots.first()["snapshot_date"] == datetime.date(2025, 11, 1)
    raw, dated = files.manual_snapshot(spark, f"{tmp_path}/q_2025-11.csv", "T", datetime.date(2026, 5, 5))
    assert dated.first()["snapshot_id"] == "snap_t_2026_05_05" and raw.count() == 1


def test_numbered_rows_keep_their_order(spark, tmp_path):
    (tmp_path / "n.csv").write_text('\ufeffINR,Note,INR\n1,"x\ny",one\n\n2,,\n3\n4,a,four,beyond\n', encoding="utf-8")
    got = files.rows(spark, f"{tmp_path}/n.csv").orderBy("_row").collect()
    # of equal headers the last counts; blank lines aren't rows, short rows have nulls
    assert [(r["_row"], r["queue_id"], r["payload"]) for r in got] == [(1, "one", {"INR": "one", "Note": "x\ny"}), (2, None, {"INR": None, "Note": None}), (3, None, {"INR": None, "Note": None}), (4, "four", {"INR": "four", "Note": "a"})]


def test_files_come_in_pieces(spark, tmp_path, monkeypatch):
    """Pieces that end anywhere: inside a character, a quoted value, a line's end, a mark of bytes; files in one task."""
    texts = {"a.csv": '\ufeffINR,Note\r\nü1,"x ""y"",\r\n\r\nz"\r\n\r\nü2,€\r\n'.encode() + b"bad\xe2\x82,\xff\r\n", "b.csv": b"Note,INR\rn,1\r", "c.csv": b"", "d.csv": b"INR\n", "e.csv": b'INR,Note\n1,"open\n'}
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content)
    taken = lambda: sorted((r["_file"].rsplit("/", 1)[-1], r["_row"], r["file_hash"], r["queue_id"], str(r["payload"])) for r in files.rows(spark, f"{tmp_path}/*.csv").collect())
    whole = taken()
    assert [r[:2] for r in whole] == [("a.csv", 1), ("a.csv", 2), ("a.csv", 3), ("b.csv", 1), ("e.csv", 1)]
    assert [r[3] for r in whole] == ["ü1", "ü2", "bad\ufffd", "1", "1"] and whole[0][4] == str({"INR": "ü1", "Note": 'x "y",\r\n\r\nz'}) and whole[4][4] == str({"INR": "1", "Note": "open\n"})
    assert {r[0]: r[2] for r in whole} == {n: hashlib.sha256(texts[n]).hexdigest() for n in ("a.csv", "b.csv", "e.csv")}
    for size in (1, 2, 7):
        monkeypatch.setattr(files, "PIECE", size)
        assert taken() == whole


def test_a_file_is_a_stream():
    """A file of four times the rows takes no more of a task's Python."""
    line = b"q,name,some place\n"

    def batches(n):
        yield pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array(["h"]), pa.array([0]), pa.array([b"INR,Project,Note\n"])], names=["path", "file_hash", "no", "piece"])
        for i in range(1, n + 1):
            yield pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array(["h"]), pa.array([i]), pa.array([line * 1_000])], names=["path", "file_hash", "no", "piece"])

    def peak(n):
        tracemalloc.start()
        try:
            return sum(b.num_rows for b in files._parsed(batches(n))), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    (small, few), (large, many) = peak(20), peak(80)
    assert (small, large) == (20_000, 80_000) and many < few + 100_000


def test_each_file_by_its_own_header(spark, tmp_path):
    """Columns in another order, by other names, or missing: read as one pattern."""
    (tmp_path / "q_2026_01.csv").write_text("Queue ID,Project Name,Capacity (MW),Status\nQ1,Alpha,10,Active\n")
    (tmp_path / "q_2026_02.csv").write_text("Project Name,Status,Queue ID\nAlpha,Withdrawn,Q1\n")
    (tmp_path / "q_2026_03.csv").write_text("Facility Name,GINR ID,MW\nAlpha,Q1,12.5\n")
    raw, snapshots = files.snapshots(spark, f"{tmp_path}/q_*.csv", "T")
    got = {r["snapshot_id"]: (r["queue_id"], r["project_name"], r["capacity_mw"], r["normalized_status"]) for r in files.normalized(raw, "T").collect()}
    assert got == {"snap_t_2026_01_01": ("Q1", "Alpha", 10.0, "Active"), "snap_t_2026_02_01": ("Q1", "Alpha", None, "Withdrawn"), "snap_t_2026_03_01": ("Q1", "Alpha", 12.5, "Unknown")}
    assert snapshots.count() == 3


def test_equal_names_in_two_folders_and_two_files_of_a_date(spark, tmp_path):
    for folder, date, ids in (("jan", "2026-01-31", "AB"), ("feb", "2026-02-28", "CD")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "q.csv").write_text("INR,Snapshot Date\n" + "".join(f"{i},{date}\n" for i in ids))
    raw, snapshots = files.snapshots(spark, f"{tmp_path}/*/q.csv", "T")
    assert sorted((r["snapshot_id"], r["queue_id"]) for r in files.normalized(raw, "T").collect()) == [("snap_t_2026_01_31", "A"), ("snap_t_2026_01_31", "B"), ("snap_t_2026_02_28", "C"), ("snap_t_2026_02_28", "D")]
    own = {r["snapshot_id"]: r for r in snapshots.collect()}
    assert len(own) == 2 and own["snap_t_2026_01_31"]["_file"].endswith("/jan/q.csv")
    # one more file of January, a copy of it, and files without rows or dates
    (tmp_path / "jan" / "more.csv").write_text("Snapshot Date,INR\n1/31/2026,E\n")
    (tmp_path / "jan" / "again.csv").write_bytes((tmp_path / "jan" / "q.csv").read_bytes())
    (tmp_path / "jan" / "none_2026-01.csv").write_text("INR\n")
    (tmp_path / "jan" / "undated.csv").write_text("INR\nF\n")
    raw, snapshots = files.snapshots(spark, f"{tmp_path}/*/*.csv", "T")
    got = {r["snapshot_id"]: r for r in snapshots.collect()}
    assert {k: (r["row_count"], len(r["files"])) for k, r in got.items()} == {"snap_t_2026_01_31": (5, 3), "snap_t_2026_02_28": (2, 1), "snap_t_2026_01_01": (0, 1), "snap_t_undated": (1, 1)}
    assert got["snap_t_2026_02_28"]["file_hash"] == own["snap_t_2026_02_28"]["file_hash"] != got["snap_t_2026_01_31"]["file_hash"]
    rows = files.normalized(raw, "T")
    assert rows.count() == rows.select("record_id").distinct().count() == 8


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    head = ["INR", "Project Name", "Interconnecting Entity", "POI Location", "County", "Projected COD", "Fuel", "Technology", "Capacity (MW)", "IA Signed"]
    path = write_xlsx(tmp_path_factory.mktemp("x") / "m.xlsx", {
        "Project Details - Large Gen": [["A title"], [], head, ["21INR0001", "One", "E1", "P1", "Alder", ("d", 46000), "SOL", "PV", 100, None], ["21INR0001", "One again", "E1", "P1", "Alder", None, "SOL", "PV", 5, None], ["22INR0002", "Two", "E2", "P2", None, None, "WIN", "WT", None, None], ["note", "not a row"]],
        "Project Details - Small Gen": [head, ["23INR0003", "Three", "E3", "P3", "Cedar", None, "OTH", "BA", 9, None], ["24INR0004", "Four", "E4", "P4", "Cedar", None, "GAS", "CC", 7, None]],
        "Commissioning Update": [["INR", "Project Name", "Commissioning Category", "Approval Date *", "MW **", "Fuel", "County"], ["22INR0002", "Two", "Approved for Commercial Operation", ("d", 46010), 70, "WIN", "Birch"], ["23INR0003", "Three", "Energization", None, 9, "OTH", "Cedar"]],
        "Inactive Projects": [["INR", "Project Name", "Inactive Date", "MW **", "Fuel", "County"], ["24INR0004", "Four", "2026-01-05", 7, "GAS", "Cedar"], ["22INR0002", "Two", "2026-01-05", 7, "WIN", "Birch"]],
        "Cancellation Update": [["INR", "Project Name", "Cancel Date", "MW **", "Fuel", "County"], ["24INR0004", "Four", "2026-01-09", 7, "GAS", "Cedar"], ["29INR0009", "Nine", "2026-01-10", 11, "OIL", "Dogwood"]],
    })
    return workbook.read_workbook(spark, path).cache()


def test_workbook_tables_and_profile(cells):
    assert workbook.header_row(cells, "Project Details - Large Gen", ("INR", "Project Name")) == 2
    first = workbook.table(cells, "Project Details - Large Gen", ("INR",)).orderBy("_row").first()
    assert first["Projected COD"] == "2025-12-09" and first["Capacity (MW)"] == "100"
    found = {p["sheet"]: p for p in workbook.profile(cells).collect()}
    assert found["Project Details - Large Gen"]["rows_with_id"] == 3 and found["Project Details - Large Gen"]["mapping"]["queue_id"] == "INR"
    one = found["Project Details - Large Gen"]
    assert one["header_row"] == 2 and one["mapping"] == workbook.normalize.resolve_headers(one["columns"]) and [found[s]["header_row"] for s in ("Commissioning Update", "Project Details - Small Gen")] == [0, 0]
    assert workbook.unique_labels(["n", "n", None, "n"]) == ["n", "n.1", "Unnamed: 2", "n.2"]


def test_workbooks_come_back_as_written(spark):
    head = ["INR", "a & b", None, "INR", "inr", "Project Name"]
    rows = [("one.xlsx", "First <&\">", 0, n, c) for n, c in ((0, ["title"]), (2, head), (3, ["21INR1", "2026-01-31", None, "-12.50", "x", " y "]), (5, [None, "<tag>", "007", "", "ü", "7"]), (6, ["", "nan"]))]
    rows += [("one.xlsx", "Second", 1, 0, ["no header"]), ("two.xlsx", "First <&\">", 0, 7, ["INR", "Project Name"]), ("two.xlsx", "First <&\">", 0, 8, ["22inr9", "P"])]
    cells = workbook.rows_of(workbook.pack(spark.createDataFrame(rows, workbook._SCHEMA)))
    blank = lambda c: [x for x in c]
    assert sorted((r["_file"], r["sheet"], r["sheet_no"], r["row_no"], str(blank(r["cells"]))) for r in cells.collect()) == sorted((f, s, i, n, str(c)) for f, s, i, n, c in rows)
    got = {(r["_file"], r["sheet_no"]): r for r in workbook.profile(cells).collect()}
    one = got["one.xlsx", 0]
    assert one["columns"] == workbook.unique_labels(head) == ["INR", "a & b", "Unnamed: 2", "INR.1", "inr", "Project Name"] and one["header_row"] == 2 and one["rows_with_id"] == 1
    assert one["mapping"] == workbook.normalize.resolve_headers(one["columns"]) and one["mapping"]["queue_id"] == "inr"
    assert (got["one.xlsx", 1]["header_row"], got["one.xlsx", 1]["columns"], got["one.xlsx", 1]["rows_with_id"], got["one.xlsx", 1]["mapping"]) == (None, [], 0, {}) and got["two.xlsx", 0]["rows_with_id"] == 1
    values = {(r["_file"], r["_row"]): r["values"] for r in workbook.tables(cells, ("INR", "Project Name")).collect()}
    assert sorted(values) == [("one.xlsx", 3), ("one.xlsx", 5), ("two.xlsx", 8)] and values["one.xlsx", 3]["INR.1"] == "-12.50" and values["two.xlsx", 8] == {"INR": "22inr9", "Project Name": "P"}


def test_a_workbook_is_a_stream():
    """Packing and parsing four times the rows takes no more of a task's Python, but for the packed file."""
    def batches(n):
        for at in range(0, n, 500):
            cells = [[f"21INR{i}", f"P <{i % 17}>", "1997-03-04", str(i), None, "O"] for i in range(at, at + 500)]
            yield pa.RecordBatch.from_arrays([pa.array(["a.xlsx"] * 500), pa.array(["S"] * 500), pa.array([0] * 500, pa.int32()), pa.array(range(at, at + 500), pa.int32()), pa.array(cells)], names=["_file", "sheet", "sheet_no", "row_no", "cells"])

    def peak(job):
        tracemalloc.start()
        try:
            return job(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    packed = {n: peak(lambda n=n: [b.column("content")[0].as_py() for b in workbook._packed(batches(n))]) for n in (2_000, 8_000)}
    books = {n: content for n, ((content,), _) in packed.items()}
    parsed = {n: peak(lambda data=data: sum(1 for _ in workbook.parse(data))) for n, data in books.items()}
    assert {n: rows for n, (rows, _) in parsed.items()} == {n: n for n in books}
    assert packed[8_000][1] - packed[2_000][1] < 4 * len(books[8_000])
    assert parsed[8_000][1] - parsed[2_000][1] < 50_000


def test_strings_that_cells_share(tmp_path):
    path = write_xlsx(tmp_path / "s.xlsx", {"S": [["INR", "Note"], ["a", "b"]]})
    with zipfile.ZipFile(path) as old, zipfile.ZipFile(tmp_path / "t.xlsx", "w") as new:
        for name in old.namelist():
            new.writestr(name, re.sub(r't="inlineStr"><is><t>(.)</t></is>', lambda m: f't="s"><v>{"ab".index(m[1])}</v>', old.read(name).decode()))
        new.writestr("xl/sharedStrings.xml", f'<sst xmlns="{workbook._NS["m"]}"><si><r><t>x</t></r><r><t>y</t></r></si><si><t/></si></sst>')
    assert [r[2:] for r in workbook.parse((tmp_path / "t.xlsx").read_bytes())] == [(0, ["INR", "Note"]), (1, ["xy", ""])]


def test_a_sheet_has_no_more_rows_than_the_format_allows():
    rows = [("a.xlsx", "S", 0, workbook.MOST_ROWS - 1, ["x"]), ("a.xlsx", "S", 0, workbook.MOST_ROWS, ["y"])]
    with pytest.raises(ValueError, match="at most"):
        workbook._book(iter(rows))
    assert [r[2] for r in workbook.parse(workbook._book(iter(rows[:1])))] == [workbook.MOST_ROWS - 1]


def test_monthly_merge(cells):
    got = {r["Queue ID"]: r for r in monthly.read_monthly(cells, "2026-01-31").collect()}
    assert sorted(got) == ["21INR0001", "22INR0002", "23INR0003", "24INR0004", "29INR0009"]
    one, two, four, nine = (got[k] for k in ("21INR0001", "22INR0002", "24INR0004", "29INR0009"))
    assert (one["Project Name"], one["Capacity (MW)"], one["Status"], one["Fuel Type"]) == ("One", 100.0, "Active", "Solar")
    # commissioning came first and outranks the inactive signal; size and county are filled in
    assert (two["Status"], two["Actual COD"], two["Capacity (MW)"], two["County"]) == ("Completed", datetime.date(2025, 12, 19), 70.0, "Birch")
    assert two["flags"] == ["missing_capacity_mw", "status_signal:commercial_operation_approved", "status_signal:inactive_project"]
    assert (four["Status"], four["Withdrawn Date"]) == ("Withdrawn", datetime.date(2026, 1, 9))
    assert (nine["Status"], nine["Fuel Type"], nine["signal"]) == ("Withdrawn", "Fuel Oil", "developer_cancelled")
    assert got["23INR0003"]["Status"] == "Active" and got["23INR0003"]["Fuel Type"] == "Battery Storage"


def test_national_workbook(spark, tmp_path):
    path = write_xlsx(tmp_path / "n.xlsx", {
        national.PROJECT_SHEET: [["note"], ["q_id", "q_status", "q_date", "mw_1", "q_year", "region", "type_clean"], ["1", "active", ("d", 44000), 12.5, 2020, "R", "Solar"], ["2", "withdrawn", None, None, None, "R", "nan"]],
        national.SUMMARY_SHEET: [["a"], ["b"], ["c"], ["Region", "n", "Capacity (GW)", "n", "Capacity (GW)", "n", "Capacity (GW)"], ["R", 1, 0.5, 2, 0.6, 3, 0.7], [None, 9]],
    })
    cells = workbook.read_workbook(spark, path)
    rows = national.projects(cells, "w").orderBy("row_number").collect()
    assert [(r["q_id"], r["q_date"], r["mw_1"], r["q_year"], r["type_clean"]) for r in rows] == [("1", datetime.date(2020, 6, 18), 12.5, 2020, "Solar"), ("2", None, None, None, None)]
    assert json.loads(rows[0]["raw_payload"])["q_id"] == "1"
    got = national.summary(cells).collect()
    assert [tuple(r) for r in got] == [("R", 1, 2, 3, 0.5, 0.6, 0.7)]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    rows = lambda *x: spark.createDataFrame(x, "k string, p int, v int")
    got = lambda t="t": sorted(map(tuple, s.read(t).select("k", "p", "v").collect()), key=str)
    s.append("t", rows(("a", 1, 1), (None, 1, 2)))
    s.upsert("t", rows(("a", 1, 5), ("b", 2, 3), (None, 1, 9)), ["k"])
    assert got() == [("a", 1, 5), ("b", 2, 3), (None, 1, 9)]
    for _ in range(2):
        s.insert_absent("t", rows(("b", 2, 99), ("c", 2, 4), (None, 3, 3)), ["k"])
    assert got() == [("a", 1, 5), ("b", 2, 3), ("c", 2, 4), (None, 1, 9)]
    s.update("t", spark.createDataFrame([("c", 40), ("zz", 1)], "k string, v int"), ["k"])
    s.delete("t", spark.createDataFrame([(None,)], "k string"))
    assert got() == [("a", 1, 5), ("b", 2, 3), ("c", 2, 40)]
    s.replace_slice("u", rows(("a", 1, 1), ("b", 2, 2)), ["p"])
    s.replace_slice("u", rows(("z", 2, 7)), ["p"])
    assert got("u") == [("a", 1, 1), ("z", 2, 7)]
    assert s.counts(["t", "none"]) == {"t": 3, "none": 0} and [r["k"] for r in s.orphans("t", "u", "k").orderBy("k").collect()] == ["b", "c"]
    store.write_csv(s.read("t"), str(tmp_path / "c"), ["v", "k"], single=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["v", "k"]
    store.write_csv(spark.range(25).coalesce(1), str(tmp_path / "many"), ["id"], file_rows=10)
    assert sorted(len(p.read_text().split()) for p in (tmp_path / "many").glob("*.csv")) == [6, 11, 11] and files.rows(spark, f"{tmp_path}/many/*.csv").count() == 25
    s.drop("t")
    assert not s.has("t")
    s.reset()
    assert not s.has("u")


def test_a_failed_rewrite_leaves_the_table(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.overwrite("t", spark.range(3))
    before = s.read("t")
    with pytest.raises(Exception, match="no such"):
        s.overwrite("t", s.read("t").select(F.raise_error(F.lit("no such")).cast("long").alias("id")))
    assert s.read("t").count() == 3
    # what a lost job left is no version, and is written over
    (tmp_path / "t" / "v2").mkdir(exist_ok=True)
    (tmp_path / "t" / "v2" / "part-0.parquet").write_bytes(b"half")
    assert s.read("t").count() == 3
    s.overwrite("t", s.read("t").where("id > 0"))
    assert s.read("t").count() == 2 and before.count() == 3
    s.overwrite("t", s.read("t").where("id > 1"))
    assert s.read("t").count() == 1 and sorted(p.name for p in (tmp_path / "t").iterdir()) == ["v2", "v3"]


def test_manifest(tmp_path):
    path = tmp_path / "m.json"
    store.upsert_manifest(path, {"source_name": "b", "n": 1})
    store.upsert_manifest(path, {"source_name": "a", "n": 1})
    rows = store.upsert_manifest(path, {"source_name": "b", "n": 2})
    assert [(r["source_name"], r["n"]) for r in rows] == [("a", 1), ("b", 2)]
    store.write_markdown(tmp_path / "d" / "x.md", "t\n\n")
    assert (tmp_path / "d" / "x.md").read_text() == "t\n"


def test_discovery(spark):
    df = spark.createDataFrame([("GIS Report May", "u1", 1), ("Other", "u2", 9), ("gis report June", "u3", 2)], "name string, url string, published int")
    assert [r["url"] for r in files.discovered(df, "GIS report").collect()] == ["u3", "u1"]
    assert HEADER.count(",") == 16 and F is not None
