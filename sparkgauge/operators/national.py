"""Aggregates of national project-level tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Statuses that end a request.
ENDED = ("operational", "withdrawn")


def status_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("q_status").agg(F.count("*").alias("projects")).orderBy("q_status")


def metrics(records: DataFrame, region: str = "ERCOT") -> DataFrame:
    """One row, in one pass: numbers and capacities (GW) of active requests, of all and of a region, and the median days to the end."""
    active = F.col("q_status") == "active"
    there = active & (F.col("region") == region)
    mw = lambda *c: sum((F.coalesce(x, F.lit(0.0)) for x in c[1:]), F.coalesce(c[0], F.lit(0.0)))
    gw = lambda cond, value: F.round(F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0)) / 1000, 4)
    end = F.coalesce("on_date", "wd_date")
    days = F.when(F.col("q_status").isin(*ENDED), F.datediff(end, "q_date"))
    return records.agg(
        F.count("*").alias("projects"), F.count_if(active).alias("active"), gw(active, F.col("mw_1")).alias("active_gw"), gw(active, mw("mw_1", "mw_2", "mw_3")).alias("active_gw_all"),
        F.count_if(there).alias("region_active"), gw(there, F.col("mw_1")).alias("region_active_gw"), F.round(F.median(days), 2).alias("median_days"),
    )


def active_by_type(records: DataFrame) -> DataFrame:
    """Active requests and capacity by cleaned type, the largest first."""
    rows = records.where("q_status = 'active'").groupBy("type_clean").agg(F.count("*").alias("active_rows"), F.round(F.coalesce(F.sum("mw_1"), F.lit(0.0)) / 1000, 4).alias("capacity_gw"))
    return rows.orderBy(F.desc("capacity_gw"), "type_clean")
