"""Monthly multi-sheet workbooks: project sheets, with later sheets' signals of status merged in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.text import clean_text, first_present, flag_union, flags
from .workbook import header_row, table

#: The sheets in order of precedence, statuses' priorities, and fuels by parts of the label.
PROJECT_SHEETS = ("Project Details - Large Gen", "Project Details - Small Gen")
SIGNAL_SHEETS = ("Commissioning Update", "Inactive Projects", "Cancellation Update")
PRIORITY = {"Completed": 3, "Withdrawn": 3, "Inactive": 2, "Active": 1}
FUEL_LABELS = {"Battery Storage": ("BA", "BESS", "BAT", "STORAGE"), "Solar": ("SOL", "PV", "SOLAR"), "Wind": ("WIN", "WIND", "WT"), "Gas": ("GAS", "CC", "GT"), "Fuel Oil": ("OIL",)}
SIGNALS = {"Commissioning Update": "commercial_operation_approved", "Inactive Projects": "inactive_project", "Cancellation Update": "developer_cancelled"}
_OUT = "`Queue ID` string, `Project Name` string, `Interconnecting Entity` string, `POI Location` string, County string, State string, `Fuel Type` string, `Capacity (MW)` double, Status string, `Target COD` date, `Actual COD` date, `Withdrawn Date` date, `Interconnection Agreement Date` date, `Last Updated` date, sheet string, signal string, source_row int, flags array<string>"


def fuel_label(fuel: Column, technology: Column) -> Column:
    """A label by parts of fuel and technology, else both as they are; null without either."""
    joined = F.trim(F.concat_ws(" ", fuel, technology))
    text, found = F.upper(joined), F.nullif(joined, F.lit(""))
    for label, parts in reversed(FUEL_LABELS.items()):
        found = F.when(reduce(lambda x, y: x | y, (text.contains(p) for p in parts)), label).otherwise(found)
    return found


def _pick(df: DataFrame, *labels: str) -> Column:
    there = [F.col(f"`{x}`") for x in labels if x in df.columns]
    return first_present(*there) if there else F.lit(None).cast("string")


def _rows(cells: DataFrame, sheet: str, snapshot_date: str) -> DataFrame | None:
    at = header_row(cells, sheet, ("INR", "Project Name"))
    if at is None:
        return None
    df = table(cells, sheet, header=at)
    df = df.where(F.col("INR").rlike(r"(?i)\d{2}INR"))
    get = lambda *labels: _pick(df, *labels)
    mw, fuel = normalize.capacity(get("Capacity (MW)", "MW **")), fuel_label(get("Fuel"), get("Technology"))
    none = F.lit(None)
    signal = SIGNALS.get(sheet)
    if signal is None:
        status, actual, withdrawn = F.lit("Active"), none, none
        marks = flags((fuel.isNull(), "missing_fuel_type"), (mw.isNull(), "missing_capacity_mw"))
    else:
        status = F.lit({"Commissioning Update": "Completed", "Inactive Projects": "Inactive", "Cancellation Update": "Withdrawn"}[sheet])
        actual = normalize.date(get("Approval Date *", "Approval Date")) if sheet == "Commissioning Update" else none
        withdrawn = normalize.date(get("Cancel Date" if sheet == "Cancellation Update" else "Inactive Date")) if sheet != "Commissioning Update" else none
        marks = F.array(F.lit(f"status_signal:{signal}"))
        df = df.where(get("Project Name").isNotNull())
        if sheet == "Commissioning Update":
            df = df.where(F.lower(F.coalesce(clean_text(get("Commissioning Category")), F.lit(""))).contains("commercial operation"))
    values = {
        "Queue ID": clean_text("INR"), "Project Name": clean_text(get("Project Name")), "Interconnecting Entity": clean_text(get("Interconnecting Entity")), "POI Location": clean_text(get("POI Location")), "County": clean_text(get("County")),
        "State": F.lit("TX"), "Fuel Type": fuel, "Capacity (MW)": mw, "Status": status, "Target COD": normalize.date(get("Projected COD")) if signal is None else none, "Actual COD": actual, "Withdrawn Date": withdrawn,
        "Interconnection Agreement Date": normalize.date(get("IA Signed")) if signal is None else none, "Last Updated": F.lit(snapshot_date).cast("date"), "sheet": F.lit(sheet), "signal": F.lit(signal), "source_row": F.col("_row") + 1, "flags": marks,
    }
    kinds = dict(f.rsplit(" ", 1) for f in _OUT.split(", "))
    return df.select(*(values[k.strip("`")].cast(t).alias(k.strip("`")) for k, t in kinds.items()))


def merge(project: DataFrame, signals: DataFrame) -> DataFrame:
    """One row per queue id: the first project row, with the sheets' signals applied in their order.

    A signal of at least the standing priority sets status, dates and signal (where it has them); fuel, capacity and
    county are filled where empty. An id that only signals name starts from the first of them. The fold runs over one
    id's few signals, gathered in order.
    """
    sheets = F.array(*(F.lit(s) for s in (*PROJECT_SHEETS, *SIGNAL_SHEETS)))
    rows = project.unionByName(signals).withColumn("_sheet", F.array_position(sheets, F.col("sheet")))
    each = F.struct("_sheet", "source_row", *(f"`{c}`" for c in project.columns if c != "source_row"))
    gathered = rows.groupBy(F.col("Queue ID").alias("_id")).agg(F.array_sort(F.collect_list(each)).alias("_rows"))
    priority = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    is_signal = lambda r: r["signal"].isNotNull()

    def fold(old: Column, new: Column) -> Column:
        wins = F.element_at(priority, new["Status"]) >= F.element_at(priority, old["Status"])
        out = old
        for k in ("Status", "Withdrawn Date", "Actual COD", "signal"):
            out = out.withField(f"`{k}`", F.when(wins, F.coalesce(new[k], old[k])).otherwise(old[k]))
        out = out.withField("`Fuel Type`", F.coalesce(F.nullif(old["Fuel Type"], F.lit("")), new["Fuel Type"]))
        out = out.withField("`Capacity (MW)`", F.coalesce(F.nullif(old["Capacity (MW)"], F.lit(0.0)), new["Capacity (MW)"], old["Capacity (MW)"]))
        out = out.withField("County", F.coalesce(F.nullif(old["County"], F.lit("")), new["County"]))
        out = out.withField("flags", flag_union(old["flags"], new["flags"]))
        return F.when(is_signal(new), out.withField("sheet", F.concat(old["sheet"], F.lit(" + "), new["sheet"]))).otherwise(old)

    # later project rows of the same id don't count: the fold passes them by
    return gathered.select(F.aggregate(F.slice("_rows", 2, F.greatest(F.size("_rows"), F.lit(1))), F.element_at("_rows", 1), fold).alias("_r")).select(*(F.col("_r")[c].alias(c) for c in project.columns))


def read_monthly(cells: DataFrame, snapshot_date: str) -> DataFrame:
    """The merged project rows of a workbook's cells, under headers that the normalizer knows."""
    project = [r for r in (_rows(cells, s, snapshot_date) for s in PROJECT_SHEETS) if r is not None]
    signals = [r for r in (_rows(cells, s, snapshot_date) for s in SIGNAL_SHEETS) if r is not None]
    if not project and not signals:
        raise ValueError("no sheet with a header of INR and Project Name")
    union = lambda xs: reduce(DataFrame.unionByName, xs)
    empty = lambda xs: xs[0].limit(0)
    return merge(union(project) if project else empty(signals), union(signals) if signals else empty(project))
