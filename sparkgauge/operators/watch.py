"""Watched sources: content hashes, change detection, review signals, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hashed_id, keywords_in, without_prefix
from . import asof

#: Status words that are looked for, and the kind of source that is our own rule table.
STATUS_WORDS = ("anopr", "proposed", "pending", "directed", "approved", "accepted", "final", "order")
OWN_RULES = "internal_flex_rule"
EXCERPT = 320


def with_content(sources: DataFrame, content: DataFrame, default: str | None = None) -> DataFrame:
    """Active sources with content_text: given (watch_source_id, content_text), else ``default`` (null: could not be read)."""
    return sources.where("is_active").join(content.select("watch_source_id", "content_text"), "watch_source_id", "left").withColumn("content_text", F.coalesce("content_text", F.lit(default).cast("string")))


def captures(rows: DataFrame, order: str = "captured_at") -> DataFrame:
    """Captures (watch_source_id, ``order``, content_text; null text: reading failed) with hash, previous hash and parse_status.

    The previous hash is that of the source's last capture that could be read; a source's first one counts as changed.
    """
    hashed = rows.withColumn("content_hash", F.sha2("content_text", 256))
    before = Window.partitionBy("watch_source_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    hashed = hashed.withColumn("previous_content_hash", F.last("content_hash", ignorenulls=True).over(before))
    status = F.when(F.col("content_hash").isNull(), "failed").when(F.col("content_hash") == F.col("previous_content_hash"), "unchanged").otherwise("changed")
    return hashed.withColumn("parse_status", status)


def needs_review(words: Column, jurisdiction: Column, parser: Column) -> Column:
    """The text says "final", or "order" in a FERC matter; our own rule table is exempt."""
    return (parser != OWN_RULES) & (F.array_contains(words, "final") | (F.array_contains(words, "order") & F.coalesce(jurisdiction == "FERC", F.lit(False))))


def source_events(captured: DataFrame) -> DataFrame:
    """A change event for each capture joined with its source's fields; scores are added by ``events.complete``."""
    rows = captured.withColumn("status_keywords", keywords_in("content_text", STATUS_WORDS))
    review = needs_review(F.col("status_keywords"), F.col("jurisdiction"), F.col("parser_type"))
    kind = F.when(F.col("parse_status") == "failed", "source_parse_failed").when(F.col("parse_status") == "unchanged", "source_unchanged").when(review, "rule_needs_review").otherwise("rule_source_changed")
    rows = rows.withColumn("event_type", kind)
    failed = F.col("parse_status") == "failed"
    return rows.select(
        F.when(F.col("source_type") == "flexibility_rule", "flexibility_rule").otherwise("regulatory").alias("event_domain"), "event_type", F.lit(None).cast("string").alias("market"), "jurisdiction",
        F.col("source_name").alias("entity_or_provision"), F.lit(None).cast("string").alias("entity_id"), F.when(F.col("parser_type") == OWN_RULES, without_prefix("watch_source_id", "watch_flex_")).alias("rule_id"),
        "watch_source_id", "captured_at", "source_url", "content_hash", "previous_content_hash", "parse_status", "status_keywords", F.substring("content_text", 1, EXCERPT).alias("diff_excerpt"),
        F.when(failed, 0.4).otherwise(0.9).alias("confidence"), failed.alias("is_ambiguous"), F.col("event_type").isin("rule_needs_review", "rule_source_changed").alias("is_hard_alert"),
        F.concat("source_name", F.when(failed, ": could not be read; manual review.").when(F.col("parse_status") == "unchanged", ": content is the same.").when(review, ": changed, with status words to review.").otherwise(": content changed.")).alias("explanation"),
        hashed_id("chg", "watch_source_id", "captured_at", "event_type").alias("change_event_id"),
    )


def registry(curated: DataFrame, rules: DataFrame) -> DataFrame:
    """The curated sources and one for each rule."""
    of_rules = rules.select(
        F.concat(F.lit("watch_flex_"), "rule_id").alias("watch_source_id"), F.col("provision_name").alias("source_name"), F.lit("flexibility_rule").alias("source_type"), "jurisdiction", "source_url",
        F.lit(OWN_RULES).alias("parser_type"), F.lit("monthly").alias("watch_frequency"), F.lit(True).alias("is_active"), F.col("status").alias("notes"),
    )
    return curated.unionByName(of_rules)


def latest_hashes(captured: DataFrame) -> DataFrame:
    """Each source's last hash that could be read, and when: what the next run compares with."""
    read = captured.where("content_hash is not null")
    return read.groupBy("watch_source_id").agg(F.max_by("content_hash", "captured_at").alias("last_content_hash"), F.max("captured_at").alias("last_captured_at"))


def snapshots_before(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``requests`` (market, as_of, and more) with snapshot_id and snapshot_date of the market's latest snapshot before the
    date: by date, then by id. What a run compares with, for any number of markets and dates."""
    return asof.latest_before(requests, snapshots, ["market"], "as_of", "snapshot_date", ("snapshot_id", "snapshot_date"), tie=("snapshot_id",))


def latest_pair(snapshots: DataFrame) -> DataFrame:
    """(market, to_snapshot_id, from_snapshot_id): each market's latest snapshot and the one of the date before it, if any."""
    latest = snapshots.groupBy("market").agg(F.max(F.struct("snapshot_date", "snapshot_id")).alias("_to"))
    asked = latest.select("market", F.col("_to.snapshot_date").alias("as_of"), F.col("_to.snapshot_id").alias("to_snapshot_id"))
    return snapshots_before(asked, snapshots).select("market", "to_snapshot_id", F.col("snapshot_id").alias("from_snapshot_id"))


def digest_sections(events: DataFrame) -> DataFrame:
    """Numbers of events and of hard ones by domain and type. All events count: a digest's period is a label only."""
    return events.groupBy("event_domain", "event_type").agg(F.count("*").alias("events"), F.count_if(F.col("is_hard_alert")).alias("hard_alerts"))


def pair_sections(events: DataFrame, categories: dict[str, tuple[str, ...]], n: int = 10) -> DataFrame:
    """The ``n`` highest events of each category of types, ranked inside it."""
    table = F.create_map(*(F.lit(x) for name, kinds in categories.items() for kind in kinds for x in (kind, name)))
    found = events.withColumn("category", F.try_element_at(table, F.col("event_type"))).where("category is not null")
    order = Window.partitionBy("category").orderBy(F.desc("materiality_score"), "change_event_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def quality_warnings(records: DataFrame) -> DataFrame:
    """Numbers of each data-quality flag by snapshot."""
    return records.select("snapshot_id", F.explode("data_quality_flags").alias("flag")).groupBy("snapshot_id", "flag").agg(F.count("*").alias("records"))
