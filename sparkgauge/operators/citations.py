"""Citations: each record traces to its source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hashed_id


def for_records(records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One citation per record, with its snapshot's source."""
    sources = snapshots.select("snapshot_id", "source_id", "source_url")
    text = F.concat_ws(" ", F.lit("Record"), F.coalesce("queue_id", F.lit("without id")), F.lit("of snapshot"), "snapshot_id")
    rows = records.select("record_id", "snapshot_id", "queue_id").join(sources, "snapshot_id", "left")
    return rows.select(hashed_id("cit", "record_id").alias("citation_id"), "record_id", "source_id", text.alias("citation_text"), "source_url")


def of(citations: DataFrame, record_ids: Sequence[str]) -> DataFrame:
    """The citations of the named records."""
    return citations.where(F.col("record_id").isin(*record_ids)) if record_ids else citations.limit(0)
