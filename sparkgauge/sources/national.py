"""National project-level workbooks: the project sheet with types, and the summary by region."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize
from ..functions.text import clean_text, hashed_id
from .workbook import table

#: The sheets, their header rows (from 0), and the project sheet's columns by type.
PROJECT_SHEET, PROJECT_HEADER = "03. Complete Queue Data", 1
SUMMARY_SHEET, SUMMARY_HEADER = "02. Data Sample by Region", 3
TEXTS = ("q_id", "q_status", "IA_phase_raw", "IA_phase_clean", "county", "state", "region", "project_name", "utility", "entity", "developer", "service", "project_type", "type_1", "type_2", "type_3", "type_clean")
DATES = ("q_date", "prop_date", "on_date", "wd_date", "ia_date")
NUMBERS = ("mw_1", "mw_2", "mw_3")
YEARS = ("q_year", "prop_year")


def projects(cells: DataFrame, workbook_id: str, sheet: str = PROJECT_SHEET, header: int = PROJECT_HEADER) -> DataFrame:
    """Typed project records with their raw payload; what can't be parsed, or has no column, is null."""
    rows = table(cells, sheet, header=header)
    get = lambda c: F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string")
    payload = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns) if c != "_row")))
    return rows.select(
        hashed_id("nat", F.lit(workbook_id), "_row").alias("record_id"), F.lit(workbook_id).alias("workbook_id"), (F.col("_row") - header).alias("row_number"),
        *(clean_text(get(c)).alias(c.lower()) for c in TEXTS), *(normalize.date(get(c)).alias(c) for c in DATES), *(normalize.capacity(get(c)).alias(c) for c in NUMBERS),
        *(normalize.capacity(get(c)).cast("int").alias(c) for c in YEARS), payload.alias("raw_payload"),
    )


def summary(cells: DataFrame, sheet: str = SUMMARY_SHEET, header: int = SUMMARY_HEADER) -> DataFrame:
    """Numbers and capacities by region and status, from the repeated column names of the summary."""
    rows = table(cells, sheet, header=header)
    number = lambda c: normalize.capacity(f"`{c}`") if c in rows.columns else F.lit(None).cast("double")
    named = {"active": "", "operational": ".1", "withdrawn": ".2"}
    found = rows.select(
        clean_text("Region").alias("region"), *(number(f"n{s}").cast("int").alias(f"{k}_n") for k, s in named.items()), *(number(f"Capacity (GW){s}").alias(f"{k}_capacity_gw") for k, s in named.items())
    )
    return found.where("region is not null")
