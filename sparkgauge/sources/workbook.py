"""XLSX workbooks as tables of cells, by Spark's own file reader and the standard library's zip and XML parsers.

A workbook is parsed in one task, many workbooks in many; bytes come from ``binaryFile``, so any file system works. Rows
are read and written in a stream, so of a workbook a task's Python holds the packed file and the texts its cells share.
"""

from __future__ import annotations

import datetime
import io
import itertools
import re
import shutil
import tempfile
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from typing import IO
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.text import is_missing

#: Rows in which a header is looked for.
SEARCHED = 80
_SCHEMA = "_file string, sheet string, sheet_no int, row_no int, cells array<string>"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
QUOTES = {'"': "&quot;"}
#: Rows that a task hands over at a time, that it takes as Python's objects at a time, and rows of a sheet by the
#: format's definition.
BATCH, TAKEN, MOST_ROWS = 4_096, 256, 1_048_576
#: Number formats that show dates.
_DATE_FORMATS = {14, 15, 16, 17, 22}


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _each(stream: IO[bytes], parent: str, child: str) -> Iterator[ElementTree.Element]:
    """The elements ``child`` of ``parent``, one at a time: what was handed on is taken out of its parent."""
    held = None
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            held = e if e.tag == parent else held
        elif e.tag == child:
            yield e
            (e if held is None else held).clear()


def parse(data: bytes | pa.Buffer) -> Iterator[tuple[str, int, int, list[str | None]]]:
    """(sheet, its number, row number from 0, cells as text) of a workbook's rows that aren't blank, a row at a time."""
    main = f"{{{_NS['m']}}}"
    with zipfile.ZipFile(pa.BufferReader(data)) as z:
        names = set(z.namelist())
        xml = lambda name: ElementTree.fromstring(z.read(name))
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{main}t"))
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            with z.open("xl/sharedStrings.xml") as stream:
                shared = [text(e) for e in _each(stream, f"{main}sst", f"{main}si")]
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            styles = xml("xl/styles.xml")
            custom = {int(e.get("numFmtId")): e.get("formatCode", "") for e in styles.findall("m:numFmts/m:numFmt", _NS)}
            is_date = lambda n: n in _DATE_FORMATS or bool(re.search("[yd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(n, "")).lower()))
            dates = [is_date(int(e.get("numFmtId", 0))) for e in styles.findall("m:cellXfs/m:xf", _NS)]

        def value(c: ElementTree.Element) -> str | None:
            found, kind, style = c.find("m:v", _NS), c.get("t"), int(c.get("s", 0))
            if kind == "inlineStr":
                return text(c)
            if found is None or found.text is None:
                return None
            if kind == "s":
                return shared[int(found.text)]
            if kind == "b":
                return "true" if found.text == "1" else "false"
            if kind in (None, "n") and style < len(dates) and dates[style]:
                return (datetime.date(1899, 12, 30) + datetime.timedelta(days=int(float(found.text)))).isoformat()
            return found.text

        targets = {e.get("Id"): e.get("Target") for e in xml("xl/_rels/workbook.xml.rels")}
        for number, sheet in enumerate(xml("xl/workbook.xml").findall("m:sheets/m:sheet", _NS)):
            target = targets[sheet.get(_REL)]
            with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as stream:
                for row in _each(stream, f"{main}sheetData", f"{main}row"):
                    cells: list[str | None] = []
                    for c in row.findall("m:c", _NS):
                        at = _column(c.get("r")) if c.get("r") else len(cells)
                        cells += [None] * (at + 1 - len(cells))
                        cells[at] = value(c)
                    if any(x not in (None, "") for x in cells):
                        yield sheet.get("name"), number, int(row.get("r", 1)) - 1, cells


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("_file", pa.string()), ("sheet", pa.string()), ("sheet_no", pa.int32()), ("row_no", pa.int32()), ("cells", pa.list_(pa.string()))])
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = ((path.rsplit("/", 1)[-1], *r) for r in parse(content.as_buffer()))
            while part := list(itertools.islice(rows, BATCH)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], schema=kinds)


def rows_of(contents: DataFrame) -> DataFrame:
    """All rows of all sheets of workbooks (path, content), cells as text, dates in ISO form. A workbook is one task."""
    return contents.select("path", "content").mapInArrow(_parsed, _SCHEMA)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """``rows_of`` the workbooks of a path or pattern."""
    return rows_of(spark.read.format("binaryFile").load(path))


def _sheet(rows: Iterable[tuple[int, list[str | None]]]) -> Iterator[str]:
    def cell(at: str, value: str | None) -> str:
        if value is None:
            return ""
        if re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            return f'<c r="{at}" s="1"><v>{(datetime.date.fromisoformat(value) - datetime.date(1899, 12, 30)).days}</v></c>'
        if re.fullmatch(r"-?\d{1,15}(\.\d{1,15})?", value):
            return f'<c r="{at}"><v>{value}</v></c>'
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    yield f'<worksheet xmlns="{_NS["m"]}"><sheetData>'
    for n, cells in rows:
        if n >= MOST_ROWS:
            raise ValueError(f"a sheet has at most {MOST_ROWS} rows")
        yield f'<row r="{n + 1}">{"".join(cell(f"{_letters(i)}{n + 1}", v) for i, v in enumerate(cells))}</row>'
    yield "</sheetData></worksheet>"


def _letters(i: int) -> str:
    out, i = "", i + 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def _book(rows: Iterator[tuple]) -> bytes:
    """A workbook of (_file, sheet, sheet_no, row_no, cells), sorted by sheet and row; a sheet goes through a file of the
    task's own, so that its size is known when it is packed."""
    office = _REL[1:].split("}")[0]
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out, sheets = io.BytesIO(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for (_, name), part in itertools.groupby(rows, lambda r: (r[2], r[1])):
            sheets.append(name)
            with tempfile.TemporaryFile() as body:
                body.writelines(text.encode() for text in _sheet(r[3:] for r in part))
                info = zipfile.ZipInfo(f"xl/worksheets/sheet{len(sheets)}.xml")
                info.compress_type, info.file_size = zipfile.ZIP_DEFLATED, body.tell()
                body.seek(0)
                with z.open(info, "w") as to:
                    shutil.copyfileobj(body, to)
        numbers = range(1, len(sheets) + 1)
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{kind}.worksheet+xml"/>' for n in numbers) + "</Types>")
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS["m"]}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="{escape(name, QUOTES)}" sheetId="{n}" r:id="r{n}"/>' for n, name in zip(numbers, sheets, strict=True)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}">' + "".join(f'<Relationship Id="r{n}" Type="{office}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in numbers) + f'<Relationship Id="r0" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{_NS["m"]}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
    return out.getvalue()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    taken = (b.slice(at, TAKEN) for b in batches for at in range(0, b.num_rows, TAKEN))
    rows = (r for part in taken for r in zip(*(c.to_pylist() for c in part.columns), strict=True))
    for path, book in itertools.groupby(rows, lambda r: r[0]):
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([_book(book)], pa.binary())], names=["path", "content"])


def pack(rows: DataFrame) -> DataFrame:
    """(path, content): a workbook of each ``_file`` of rows as ``rows_of`` gives them; ISO dates become date cells, plain
    numbers number cells. A workbook is made in one task, a row at a time in the order that Spark's sort gives; a sheet
    can't have more than MOST_ROWS rows."""
    ordered = rows.select("_file", "sheet", "sheet_no", "row_no", "cells").repartition("_file").sortWithinPartitions("_file", "sheet_no", "sheet", "row_no")
    return ordered.mapInArrow(_packed, "path string, content binary")


def _keys(c: Column) -> Column:
    return F.transform(c, lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " ")))


def headers(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """(_file, sheet, sheet_no, header_row, labels) of every sheet, by one aggregate: the header is the first of the first
    SEARCHED rows with all ``required`` labels, null without one; labels are numbered and named as ``unique_labels`` does."""
    wanted = F.array(*(F.lit(normalize.clean_key(r)) for r in required))
    is_header = (F.col("row_no") < SEARCHED) & (F.size(F.array_except(wanted, _keys(F.col("cells")))) == 0)
    found = rows.groupBy("_file", "sheet", "sheet_no").agg(F.min(F.when(is_header, F.col("row_no"))).alias("header_row"), F.min_by("cells", F.when(is_header, F.col("row_no"))).alias("_cells"))
    named = F.transform("_cells", lambda c, i: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.concat(F.lit("Unnamed: "), i.cast("string"))))
    again = lambda x, i: F.size(F.filter(F.slice("_named", F.lit(1), i), lambda y: y == x))
    labels = F.transform("_named", lambda x, i: F.when(again(x, i) > 0, F.concat(x, F.lit("."), again(x, i).cast("string"))).otherwise(x))
    return found.withColumn("_named", named).withColumn("labels", labels).drop("_cells", "_named")


def tables(rows: DataFrame, required: Sequence[str]) -> DataFrame:
    """(_file, sheet, sheet_no, _row, values): the rows after the header of every sheet that has one, as a map of label to
    text. Rows with nothing but missing values are dropped. The headers, one row a sheet, are joined."""
    found = rows.join(headers(rows, required).where("header_row is not null"), ["_file", "sheet", "sheet_no"]).where("row_no > header_row")
    found = found.where(F.exists("cells", lambda c: ~is_missing(c)))
    values = F.map_from_arrays("labels", F.transform("labels", lambda _, i: F.try_element_at("cells", i + 1)))
    return found.select("_file", "sheet", "sheet_no", F.col("row_no").alias("_row"), values.alias("values"))


def header_row(rows: DataFrame, sheet: str, required: Sequence[str]) -> int | None:
    """The first of the first ``SEARCHED`` rows that has all required labels; null without one."""
    clean = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))
    wanted = F.array(*(F.lit(normalize.clean_key(r)) for r in required))
    found = rows.where((F.col("sheet") == sheet) & (F.col("row_no") < SEARCHED)).where(F.size(F.array_except(wanted, F.transform("cells", clean))) == 0)
    return found.agg(F.min("row_no").alias("n")).first()["n"]


def unique_labels(labels: Sequence[str | None]) -> list[str]:
    """Labels with repeats numbered (n, n.1, n.2) and blanks named by position."""
    seen: dict[str, int] = {}
    out = []
    for i, label in enumerate(labels):
        name = (label or "").strip() or f"Unnamed: {i}"
        again = seen.get(name, 0)
        seen[name] = again + 1
        out.append(f"{name}.{again}" if again else name)
    return out


def table(rows: DataFrame, sheet: str, required: Sequence[str] = (), header: int | None = None) -> DataFrame:
    """A sheet's rows after its header (found by ``required``, or given), one text column for each label, besides ``_row``.

    Rows with nothing but missing values are dropped. One row, the header, comes to the driver.
    """
    at = header if header is not None else header_row(rows, sheet, required)
    if at is None:
        raise ValueError(f"no header with {list(required)} in sheet {sheet!r}")
    here = rows.where(F.col("sheet") == sheet)
    labels = unique_labels(here.where(F.col("row_no") == at).select("cells").first()["cells"])
    body = here.where(F.col("row_no") > at).where(F.exists("cells", lambda c: ~is_missing(c)))
    return body.select(F.col("row_no").alias("_row"), *(F.try_element_at("cells", F.lit(i + 1)).alias(name) for i, name in enumerate(labels)))


def profile(rows: DataFrame, required: Sequence[str] = ("INR", "Project Name"), id_label: str = "INR", id_pattern: str = r"(?i)\d{2}INR") -> DataFrame:
    """For each sheet of each workbook its header row, labels (columns), the canonical fields they map to (mapping) and the
    number of rows with an id; one pass over the rows for all sheets. Sheets without a header have no columns and 0 rows."""
    found = headers(rows, required)
    counted = tables(rows, required).groupBy("_file", "sheet", "sheet_no").agg(F.count_if(F.coalesce(F.col("values")[id_label].rlike(id_pattern), F.lit(False))).alias("rows_with_id"))
    fields = [F.struct(F.lit(field).alias("k"), F.coalesce(*(F.try_element_at("_keys", F.lit(normalize.clean_key(a))) for a in aliases)).alias("v")) for field, aliases in normalize.ALIASES.items()]
    out = found.join(counted, ["_file", "sheet", "sheet_no"], "left").withColumn("columns", F.coalesce("labels", F.array().cast("array<string>")))
    # of labels with one key the last counts
    last = F.filter("columns", lambda c, i: F.size(F.filter(F.slice("columns", i + 2, F.size("columns")), lambda d: _keys(F.array(d))[0] == _keys(F.array(c))[0])) == 0)
    out = out.withColumn("_keys", F.map_from_arrays(_keys(last), last)).withColumn("mapping", F.map_from_entries(F.filter(F.array(*fields), lambda e: e["v"].isNotNull())))
    return out.select("_file", "sheet", "sheet_no", "header_row", "columns", F.coalesce("rows_with_id", F.lit(0)).alias("rows_with_id"), "mapping")
