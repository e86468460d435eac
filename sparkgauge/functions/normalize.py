"""Normalization of raw records: header aliases, names, places, categories, numbers and dates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dates
from .text import clean_text, col, compact, flags, hashed_id, is_missing, nonempty, once

#: The headers that each canonical field goes by; of several in a file the first listed one counts.
ALIASES = {
    "queue_id": ("queue id", "queue no", "queue number", "project code", "interconnection request id", "ir number", "inr", "ginr id"),
    "project_name": ("project name", "project", "generation resource", "resource name", "facility name"),
    "interconnecting_entity": ("interconnecting entity", "developer", "company", "applicant", "owner"),
    "county": ("county", "county name"),
    "state": ("state", "st"),
    "point_of_interconnection": ("point of interconnection", "poi", "substation", "interconnection point"),
    "transmission_owner": ("transmission owner", "tsp", "utility", "transmission service provider"),
    "fuel_type": ("fuel type", "technology", "resource type", "fuel", "generation type"),
    "capacity_mw": ("capacity mw", "capacity (mw)", "mw", "nameplate mw", "summer mw"),
    "status": ("status", "project status", "queue status", "q status"),
    "request_date": ("request date", "application date", "queue date"),
    "target_cod": ("target cod", "planned cod", "commercial operation date", "projected cod", "in service date"),
    "actual_cod": ("actual cod", "actual commercial operation date", "online date"),
    "withdrawn_date": ("withdrawn date", "withdrawal date"),
    "interconnection_agreement_date": ("interconnection agreement date", "ia date", "gia date"),
    "last_updated_date": ("last updated", "updated", "last updated date", "update date"),
}
#: Words dropped from names.
SUFFIXES = ("llc", "l l c", "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "lp", "llp", "holdings", "energy", "renewables")
#: Categories by parts of the text, the first that fits.
FUELS = {
    "Hybrid": ("hybrid", "solar plus storage", "solar + storage", "pv+bess", "pv + bess"),
    "Battery": ("battery", "bess", "storage", "ess"),
    "Solar": ("solar", "photovoltaic", "pv"),
    "Wind": ("wind",),
    "Gas": ("gas", "ccgt", "ct", "combined cycle", "combustion turbine"),
}
STATUSES = {
    "Withdrawn": ("withdrawn", "withdraw", "cancelled", "canceled", "terminated"),
    "Completed": ("completed", "complete", "operational", "in service", "online", "energized"),
    "Suspended": ("suspended", "on hold", "inactive"),
    "Active": ("active", "studying", "in progress", "pending", "planned", "under review"),
}
DATES = ("request_date", "target_cod", "actual_cod", "withdrawn_date", "interconnection_agreement_date", "last_updated_date")


def clean_key(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", header.lower()).strip()


def resolve_headers(headers: Iterable[str]) -> dict[str, str]:
    """Canonical field to the file's header. A header counts by being there, whatever its values; of equal ones the last."""
    by_key = {clean_key(h): h for h in headers}
    found = {field: next((by_key[clean_key(a)] for a in aliases if clean_key(a) in by_key), None) for field, aliases in ALIASES.items()}
    return {field: header for field, header in found.items() if header is not None}


def project_name(c: Column | str) -> Column:
    """Lower case, ``&`` spelled out, signs to spaces, business suffixes dropped; null if nothing is left."""
    text = F.regexp_replace(F.replace(F.lower(col(c).cast("string")), F.lit("&"), F.lit(" and ")), r"(?U)[^a-z0-9\s]", " ")
    words = F.filter(F.split(compact(text), " "), lambda w: (w != "") & ~w.isin(*SUFFIXES))
    return F.when(~is_missing(c), nonempty(F.array_join(words, " ")))


def county(c: Column | str) -> Column:
    bare = F.regexp_replace(F.replace(F.replace(col(c).cast("string"), F.lit("County"), F.lit("")), F.lit("county"), F.lit("")), r"(?U)[^A-Za-z\s-]", " ")
    words = F.filter(F.split(compact(bare), " "), lambda w: w != "")
    capital = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))))
    return F.when(~is_missing(c), nonempty(F.array_join(capital, " ")))


def state(c: Column | str) -> Column:
    text = F.upper(F.trim(col(c).cast("string")))
    return F.when(~is_missing(c), F.when(text == "TEXAS", "TX").otherwise(F.substring(text, 1, 2)))


def category(c: Column | str, table: dict[str, tuple[str, ...]], other: str) -> Column:
    """The first category one of whose parts the text contains; ``other`` for other texts, Unknown for missing ones."""

    def first(low: Column) -> Column:
        found = F.lit(other)
        for name, parts in reversed(table.items()):
            hit = F.lit(False)
            for p in parts:
                hit = hit | low.contains(p)
            found = F.when(hit, name).otherwise(found)
        return found

    return F.when(is_missing(c), "Unknown").otherwise(once(F.lower(col(c).cast("string")), first))


def fuel(c: Column | str) -> Column:
    return category(c, FUELS, "Other")


def status(c: Column | str) -> Column:
    return category(c, STATUSES, "Unknown")


def capacity(c: Column | str) -> Column:
    """The first number in the text, thousands separators ignored."""
    found = F.regexp_extract(F.replace(col(c).cast("string"), F.lit(","), F.lit("")), r"-?\d+(\.\d+)?", 0)
    return F.when(~is_missing(c), found.try_cast("double"))


#: A date of any usual format.
date = dates.parse


def quality_flags(queue_id: Column, name: Column, fuel_text: Column, fuel_class: Column, status_text: Column, status_class: Column, mw: Column, place: Column) -> Column:
    return flags(
        (queue_id.isNull(), "missing_queue_id"),
        (name.isNull(), "missing_project_name"),
        (fuel_class.isin("Unknown", "Other"), F.concat(F.lit("unclear_fuel_type:"), F.coalesce(fuel_text, F.lit("missing")))),
        (status_class == "Unknown", F.concat(F.lit("unclear_status:"), F.coalesce(status_text, F.lit("missing")))),
        (F.coalesce(mw <= 0, F.lit(True)), "missing_or_nonpositive_capacity_mw"),
        (place.isNull(), "missing_county"),
    )


def normalize(raw: DataFrame, market: Column | str, snapshot_id: Column | str, snapshot_date: Column | str, row_id: Column | str, map_poi_location: bool = False, vote_by: Sequence[str] = ()) -> DataFrame:
    """One normalized record per raw row; ``raw``'s headers are matched by alias, all its columns are read as text.

    Ids are hashes of snapshot and row, so a second run gives the same ones. ``map_poi_location`` also reads the header
    "POI Location", which by default is no alias. Dates put the month first where both numbers may be one; with
    ``vote_by`` (columns of ``raw`` that name a file or snapshot) each of its columns decides by its other values.
    """
    headers = resolve_headers(raw.columns)
    if map_poi_location and "point_of_interconnection" not in headers:
        headers |= {"point_of_interconnection": h for h in raw.columns if clean_key(h) == "poi location"}
    value = {f: F.col(f"`{headers[f]}`") if f in headers else F.lit(None).cast("string") for f in ALIASES}
    day_first = {}
    if vote_by:
        asked = {f: headers[f] for f in DATES if f in headers}
        raw = dates.with_votes(raw, list(asked.values()), vote_by)
        day_first = {f: F.try_element_at("_day_first", F.lit(h)) for f, h in asked.items()}
    as_col = lambda c: F.lit(c) if isinstance(c, str) else c
    text = {f: clean_text(value[f]) for f in ("queue_id", "project_name", "interconnecting_entity", "point_of_interconnection", "transmission_owner", "fuel_type", "status")}
    rows = raw.select(
        as_col(market).alias("market"), as_col(snapshot_id).alias("snapshot_id"), as_col(snapshot_date).cast("date").alias("snapshot_date"),
        col(row_id).cast("string").alias("raw_record_id"), *(c.alias(f) for f, c in text.items()),
        project_name(value["project_name"]).alias("normalized_project_name"), county(value["county"]).alias("county"), state(value["state"]).alias("state"),
        fuel(value["fuel_type"]).alias("normalized_fuel_type"), capacity(value["capacity_mw"]).alias("capacity_mw"), status(value["status"]).alias("normalized_status"),
        *(dates.parse(value[f], day_first.get(f, False)).alias(f) for f in DATES),
    )
    return rows.withColumns(
        {
            "record_id": hashed_id("rec", "snapshot_id", "raw_record_id"),
            "data_quality_flags": quality_flags(*(F.col(c) for c in ("queue_id", "project_name", "fuel_type", "normalized_fuel_type", "status", "normalized_status", "capacity_mw", "county"))),
        }
    )
