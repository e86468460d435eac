"""Streams of source captures and of events: the last hash as state, counts by window with late data.

These extend the batch operators; ``operators.watch.captures`` gives the same statuses for the same captures in order.
``changes`` takes captures in the order in which they come. ``ordered_changes`` waits for those that come out of order.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.store import Store

CAPTURE = "watch_source_id string, captured_at timestamp, content_text string"
OUT = "watch_source_id string, captured_at timestamp, content_hash string, previous_content_hash string, parse_status string"


def read_captures(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of captures from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(CAPTURE).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values("captured_at", kind="stable")
    out = []
    for at, found in zip(rows["captured_at"], rows["content_hash"], strict=True):
        found = found if isinstance(found, str) else None
        out.append((key[0], at, found, last, "failed" if found is None else "unchanged" if found == last else "changed"))
        last = found or last
    if last is not None:
        state.update((last,))
    yield pd.DataFrame(out, columns=["watch_source_id", "captured_at", "content_hash", "previous_content_hash", "parse_status"])


def changes(captures: DataFrame) -> DataFrame:
    """Each capture's status against the last readable one of its source; the state is one hash a source.

    Texts are hashed before the shuffle, so only hashes move. Order holds within a batch and between batches.
    """
    hashed = captures.select("watch_source_id", "captured_at", F.sha2("content_text", 256).alias("content_hash"))
    return hashed.groupBy("watch_source_id").applyInPandasWithState(_step, OUT, "last string", "append", GroupStateTimeout.NoTimeout)


#: The state store that keeps more than one state a key, and timers.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ordered(StatefulProcessor):
    """Captures wait until the watermark has passed their time, then get their status in the order of time.

    A source's state is its last readable hash and what waits: as many captures as the watermark's delay holds. Captures
    that come after the watermark has passed them are given out at once as "late" and change no state. A source has a
    timer for its first waiting capture only, which gives out all that the watermark has passed, so what waits is read
    and written about once a batch, not once a capture.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "hash string")
        # one text of (microseconds, hash), as it is read and written whole
        self.waiting = handle.getValueState("waiting", "rows string")

    @staticmethod
    def _due(at: pd.Timestamp) -> int:
        """The millisecond at which a capture's time is over."""
        return -(-at.value // 1_000_000)

    def _held(self) -> list:
        return json.loads(self.waiting.get()[0]) if self.waiting.exists() else []

    def _out(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["watch_source_id", "captured_at", "content_hash", "previous_content_hash", "parse_status"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed, late, new = timerValues.getCurrentWatermarkInMs(), [], []
        for frame in rows:
            for at, found in zip(frame["captured_at"], frame["content_hash"], strict=True):
                found = found if isinstance(found, str) else None
                if self._due(at) < passed:
                    late.append((at, found, None, "late"))
                else:
                    new.append((at.value // 1000, found))
        if new:
            self.waiting.update((json.dumps([*self._held(), *new]),))
            self.handle.registerTimer(-(-min(at for at, _ in new) // 1000))
        if late:
            yield self._out(key, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # timers are over once the watermark is beyond them
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        waiting = sorted(self._held(), key=lambda r: (r[0], r[1] or ""))
        over = [r for r in waiting if -(-r[0] // 1000) <= now]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for at, found in over:
            out.append((pd.Timestamp(at, unit="us"), found, last, "failed" if found is None else "unchanged" if found == last else "changed"))
            last = found or last
        if over:
            rest = waiting[len(over) :]
            if rest:
                self.waiting.update((json.dumps(rest),))
                self.handle.registerTimer(-(-rest[0][0] // 1000))
            else:
                self.waiting.clear()
            if last is not None:
                self.last.update((last,))
            yield self._out(key, out)

    def close(self) -> None:
        pass


def ordered_changes(captures: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each capture's status as ``operators.watch.captures`` gives it, though captures come up to ``late`` out of order.

    A capture is given out once the watermark has passed its time. What comes later than that has the status "late", where
    Spark hasn't left it out before. The session must use the RocksDB state store (``with_rocksdb``).
    """
    hashed = captures.select("watch_source_id", "captured_at", F.sha2("content_text", 256).alias("content_hash")).withWatermark("captured_at", late)
    return hashed.groupBy("watch_source_id").transformWithStateInPandas(_Ordered(), OUT, "Append", "EventTime")


class with_rocksdb:
    """A session's state store is RocksDB meanwhile: ``with with_rocksdb(spark): ...``."""

    KEY = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, ROCKSDB)

    def __exit__(self, *error) -> None:
        if self.before is None:
            self.spark.conf.unset(self.KEY)
        else:
            self.spark.conf.set(self.KEY, self.before)


def run_to_store(stream: DataFrame, store: Store, table: str, checkpoint: str) -> None:
    """Work off what is there into a store's table, then stop; each micro-batch is a slice ``batch_id`` of it. A batch that
    is run again after a failure replaces its own slice, so no row is there twice."""

    def keep(rows: DataFrame, batch_id: int) -> None:
        store.replace_slice(table, rows.withColumn("batch_id", F.lit(batch_id)), ["batch_id"])

    stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 hours", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts by type in tumbling windows; what is later than the watermark is left out."""
    grouped = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), kind)
    return grouped.agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), kind, "events")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work off what is there into Parquet, then stop: once per call, resumable by the checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
