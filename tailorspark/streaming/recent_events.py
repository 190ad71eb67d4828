"""Per-user ring buffer of the latest click events, as a streaming job.

Each user's state holds at most ``n`` events sorted by (event time, id), so
late rows are placed correctly.  New rows arrive one by one and are merged
chunk by chunk: memory per group stays O(n + chunk), never the user's whole
history.  Most users have few rows a trigger, so what a user costs counts: rows
are plain tuples (no frame is made for a user), and the state is read and
written once each.  Every trigger emits the user's current
request signals; the latest row per user is the final answer and equals the
batch operator ``recent_signals``.

State lives on disk (RocksDB) and ends: a user's buffer has an event-time timer
``ttl`` after its latest event.  When the watermark (the latest event time seen,
less ``delay``) passes it, the buffer is deleted; a user who returns later starts
anew.  Rows older than the watermark of the trigger before are dropped, others are placed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tailorspark import constants as K

#: How late rows may come, and how long an idle buffer is kept after its latest event.
DELAY, TTL_DAYS = "60 days", 30
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: New rows of a user that are held before they are merged into the buffer.
CHUNK = 1000

EVENT_FIELDS = ["ts_us", "event_id", "event_name", "item_name", "category", "display_category"]

STATE_SCHEMA = T.StructType([
    T.StructField("ts_us", T.ArrayType(T.LongType())),
    T.StructField("event_id", T.ArrayType(T.LongType())),
    T.StructField("event_name", T.ArrayType(T.StringType())),
    T.StructField("item_name", T.ArrayType(T.StringType())),
    T.StructField("category", T.ArrayType(T.StringType())),
    T.StructField("display_category", T.ArrayType(T.StringType())),
    T.StructField("n_seen", T.LongType()),
])

OUTPUT_SCHEMA = T.StructType([
    T.StructField("user_pseudo_id", T.StringType()),
    T.StructField("last_us", T.LongType()),
    T.StructField("n_seen", T.LongType()),
    T.StructField("total_events", T.IntegerType()),
    T.StructField("unique_pages", T.IntegerType()),
    T.StructField("recent_sequence", T.ArrayType(T.StringType())),
    T.StructField("recent_items", T.ArrayType(T.StringType())),
    T.StructField("recent_categories", T.ArrayType(T.StringType())),
    T.StructField("recent_display_categories", T.ArrayType(T.StringType())),
])


def _when(event: tuple):
    """Order of a user's events: time, then id (a missing one first, as in the batch operator)."""
    return event[0], event[1] is not None, event[1]


def latest(buffer: list[tuple], rows: Iterator[tuple], n: int) -> tuple[list[tuple], int]:
    """The last ``n`` of ``buffer`` and ``rows`` in their order (equal ones as they came), and the number of rows."""
    seen, held = 0, list(buffer)
    for r in rows:
        seen += 1
        held.append(r)
        if len(held) >= n + CHUNK:
            held.sort(key=_when)
            del held[:-n]
    held.sort(key=_when)
    return held[-n:], seen


class RecentEvents(StatefulProcessor):
    """The latest ``n`` events of a user; deleted ``ttl_ms`` (event time) after the latest of them."""

    def __init__(self, n: int, ttl_ms: int):
        self._n, self._ttl_ms = n, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._buffer = handle.getValueState("buffer", STATE_SCHEMA)

    def _due(self, events: list[tuple]) -> int:
        return events[-1][0] // 1000 + self._ttl_ms

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = self._buffer.get()
        before = list(zip(*state[:-1])) if state else []
        k = len(EVENT_FIELDS)
        events, new = latest(before, (tuple(r)[-k:] for r in rows), self._n)
        seen = new + (state[-1] if state else 0)
        ts, ids, names, items, categories, display = map(list, zip(*events))
        self._buffer.update((ts, ids, names, items, categories, display, seen))
        self._expire_at(self._due(before) if before else None, self._due(events))
        size = max(1, len(events))
        yield Row(user_pseudo_id=key[0], last_us=ts[-1], n_seen=seen, total_events=size, unique_pages=size,
                  recent_sequence=names, recent_items=items, recent_categories=categories,
                  recent_display_categories=display)

    def _expire_at(self, before: int | None, at_ms: int) -> None:
        """One timer a user: the earlier one goes when a later event moves it."""
        if before == at_ms:
            return
        if before is not None:
            self._handle.deleteTimer(before)
        self._handle.registerTimer(at_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self._buffer.clear()
        return iter(())

    def close(self) -> None:
        pass


def buffer_stream(events: DataFrame, n: int = K.RECENT_EVENTS_MAX, delay: str = DELAY,
                  ttl_days: float = TTL_DAYS) -> DataFrame:
    """Streaming DataFrame of per-user signals (append mode, one row per user and trigger).

    ``events``: user_pseudo_id, event_ts, event_id, event_name, item_name,
    category, display_category (display already resolved).  Rows without a user
    or a time are left out.
    """
    ts = F.col("event_ts").cast("timestamp")
    ev = events.where(F.col("user_pseudo_id").isNotNull() & ts.isNotNull()).withColumn("event_ts", ts)
    ev = ev.withWatermark("event_ts", delay).select(
        "user_pseudo_id", "event_ts", F.unix_micros("event_ts").alias("ts_us"),
        F.col("event_id").cast("long"), "event_name", "item_name", "category", "display_category")
    return ev.groupBy("user_pseudo_id").transformWithState(
        RecentEvents(n, int(ttl_days * 86_400_000)), OUTPUT_SCHEMA, "append", "EventTime")


def latest_per_user(out: DataFrame) -> DataFrame:
    """The final buffer per user from the appended trigger outputs."""
    cols = [c for c in OUTPUT_SCHEMA.fieldNames() if c not in ("user_pseudo_id", "last_us", "n_seen")]
    # a late row leaves the latest time as it is; a buffer begun anew is later than the one that expired
    return out.groupBy("user_pseudo_id").agg(F.max_by(F.struct(*cols), F.struct("last_us", "n_seen")).alias("_l")).select(
        "user_pseudo_id", "_l.*")


def run_to_completion(spark: SparkSession, stream: DataFrame, out_path: str, ckpt_path: str,
                      timeout_s: int | None = None) -> DataFrame:
    """Run an append-mode stream with availableNow into parquet; return the output.

    ``timeout_s``: give up after so long (none by default: a backlog may take its time).
    The query takes its state store when it starts; the session's setting is put back.
    """
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STATE_PROVIDER)
    try:
        q = (stream.writeStream.format("parquet").option("path", out_path)
             .option("checkpointLocation", ckpt_path).outputMode("append").trigger(availableNow=True).start())
    finally:
        spark.conf.set(name, before)
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("stream did not finish")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.schema(OUTPUT_SCHEMA).parquet(out_path)
