"""Small inputs of our own: two months of a queue as CSV, and a writer of XLSX files."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

HEADER = "Queue No,Project,Interconnecting Entity,County,State,POI,Transmission Owner,Technology,Capacity (MW),Status,Request Date,Target COD,Actual COD,Withdrawn Date,IA Date,Last Updated,Snapshot Date"
_FIRST = [
    "A-1,Copper Ridge Solar LLC,Copper Ridge Dev,Alder County,Texas,North 138kV,Grid One,Solar PV,150,Active,2022-01-10,2026-06-01,,,,2026-01-15,2026-01-31",
    "A-2,Salt Flat Storage,Salt Flat Energy,Birch,TX,South 345kV,Grid One,BESS,100,Active,2022-03-01,2026-09-01,,,,2026-01-15,2026-01-31",
    "A-3,Windy Point,Point Wind Co,Birch,TX,East 138kV,Grid Two,Wind,200,Active,2021-05-01,2026-03-01,,,,2026-01-15,2026-01-31",
    "A-4,Granite Peak Gas,Granite,Cedar,TX,West 345kV,Grid Two,Gas CT,300,Active,2020-02-01,2025-12-01,,,,2026-01-15,2026-01-31",
    "A-5,Old Mill Solar,Old Mill Partners,Alder,TX,Mill 69kV,Grid One,Solar,50,Active,2021-01-01,2026-01-01,,,,2026-01-15,2026-01-31",
    "A-6,Twin Forks Solar East,Twin Forks LLC,Cedar,TX,Forks 138kV,Grid One,Solar,80,Active,2023-01-01,2027-01-01,,,,2026-01-15,2026-01-31",
    "A-7,Twin Forks Solar West,Twin Forks LLC,Cedar,TX,Forks 138kV,Grid One,Solar,80,Active,2023-01-01,2027-01-01,,,,2026-01-15,2026-01-31",
    "A-8,Quiet Lake Hybrid,Quiet Lake,Alder,TX,Lake 138kV,Grid One,Solar + Storage,120,Active,2022-06-01,2026-11-01,,,,2026-01-15,2026-01-31",
]
_SECOND = [
    "A-1,Copper Ridge Solar LLC,Copper Ridge Dev,Alder County,Texas,North 138kV,Grid One,Solar PV,180,Active,2022-01-10,2026-12-20,,,,2026-02-15,2026-02-28",
    "B-2,Salt Flat Storage,Salt Flat Energy,Birch,TX,South 345kV,Grid One,BESS,100,Active,2022-03-01,2026-09-01,,,,2026-02-15,2026-02-28",
    "A-3,Windy Point,Point Wind Co,Birch,TX,East 138kV,Grid Two,Wind,200,Withdrawn,2021-05-01,2026-03-01,,2026-02-10,,2026-02-15,2026-02-28",
    "A-4,Granite Peak Gas,Granite,Cedar,TX,West 345kV,Grid Two,Gas CT,300,Completed,2020-02-01,2025-12-01,2026-02-01,,,2026-02-15,2026-02-28",
    "A-5,Old Mill Solar Park,Old Mill Partners,Alder,TX,Mill 69kV,Grid One,Solar,50,Active,2021-01-01,2026-01-01,,,,2026-02-15,2026-02-28",
    "C-6,Twin Forks Solar,Twin Forks LLC,Cedar,TX,Forks 138kV,Grid One,Solar,80,Active,2023-01-01,2027-01-01,,,,2026-02-15,2026-02-28",
    "A-8,Quiet Lake Hybrid,Quiet Lake,Alder,TX,Lake 138kV,Grid One,Solar + Storage,120,Active,2022-06-01,2026-11-01,,,,2026-02-15,2026-02-28",
    "A-9,New Dawn Wind,New Dawn,Dogwood,TX,Dawn 345kV,Grid Two,Wind,400,Active,2026-01-20,2029-01-01,,,,2026-02-15,2026-02-28",
]


def write_csvs(folder) -> str:
    for name, rows in (("queue_2026_01.csv", _FIRST), ("queue_2026_02.csv", _SECOND)):
        (folder / name).write_text("\n".join([HEADER, *rows]) + "\n")
    return f"{folder}/queue_*.csv"


def _letter(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write_xlsx(path, sheets: dict[str, list[list]]) -> str:
    """Text and numbers only, one cell format that shows dates: a value ("date", serial) uses it."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values(), 1):
            body = ""
            for y, row in enumerate(rows, 1):
                cells = ""
                for x, v in enumerate(row):
                    at = f"{_letter(x)}{y}"
                    if v is None:
                        continue
                    if isinstance(v, tuple):
                        cells += f'<c r="{at}" s="1"><v>{v[1]}</v></c>'
                    elif isinstance(v, (int, float)):
                        cells += f'<c r="{at}"><v>{v}</v></c>'
                    else:
                        cells += f'<c r="{at}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
                body += f'<row r="{y}">{cells}</row>'
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return str(path)
