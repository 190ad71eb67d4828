"""The streaming buffer over several micro-batches equals the batch operator."""

import tempfile

from pyspark.sql import functions as F

from tailorspark.operators.clickstream import recent_signals
from tailorspark.sources.tables import catalog, client_events
from tailorspark.streaming.recent_events import buffer_stream, latest_per_user, run_to_completion
from conftest import SF_SMALL


def test_stream_buffer_equals_batch(spark):
    ev = client_events(spark, SF_SMALL)
    ev = ev.withColumn("display_category", F.when(F.col("display_category") == "", "Unknown")
                       .otherwise(F.col("display_category")))
    base = tempfile.mkdtemp(prefix="ts-t1-")
    # three files, written out of time order, so state must merge late rows
    for i in range(3):
        ev.where(F.col("event_id") % 3 == (2 - i)).write.parquet(f"{base}/in/part{i}")
    schema = spark.read.parquet(f"{base}/in/part0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(f"{base}/in")
    out = latest_per_user(run_to_completion(spark, buffer_stream(stream), f"{base}/out", f"{base}/ckpt"))
    batch = recent_signals(ev, catalog(spark, SF_SMALL))
    cols = ["user_pseudo_id", "total_events", "recent_items", "recent_display_categories"]
    a = sorted(tuple(map(str, r)) for r in out.select(*cols).collect())
    b = sorted(tuple(map(str, r)) for r in batch.select(*cols).collect())
    assert a == b and len(a) > 0
    # more than one trigger really happened
    raw = spark.read.parquet(f"{base}/out")
    assert raw.groupBy("user_pseudo_id").count().agg(F.max("count")).first()[0] > 1


CLICK = "user_pseudo_id string, event_ts timestamp, event_id long, event_name string, item_name string, category string, display_category string"


def run_files(spark, files, **options):
    """One file a trigger, in the order given; the raw output rows."""
    import time
    from datetime import datetime, timedelta

    base = tempfile.mkdtemp(prefix="ts-t1-")
    t0 = datetime(2024, 1, 1)
    for i, rows in enumerate(files):
        spark.createDataFrame([(u, t0 + timedelta(hours=h), e, "view_item", f"i{e}", "c", "c") for u, h, e in rows],
                              CLICK).coalesce(1).write.parquet(f"{base}/in/part{i}")
        time.sleep(1.1)  # files are taken by their time of change
    stream = spark.readStream.schema(CLICK).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(f"{base}/in")
    return run_to_completion(spark, buffer_stream(stream, **options), f"{base}/out", f"{base}/ckpt")


def test_idle_buffers_expire_and_late_rows_are_placed(spark):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    out = run_files(spark, [
        [("a", 0, 1), ("b", 0, 2), ("a", 1, 3)],
        [("b", 30, 4)],                 # watermark 20 h: a (due at 1 + 10 h) has been idle too long, b moved its timer
        [("b", 25, 5)],                 # late by 5 h: placed
        [("a", 31, 7), ("b", 2, 6)],    # a returns and begins anew; older than the watermark: dropped
    ], delay="10 hours", ttl_days=10 / 24)
    got = {r["user_pseudo_id"]: r["recent_items"] for r in latest_per_user(out).collect()}
    assert got == {"a": ["i7"], "b": ["i2", "i5", "i4"]}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider


def test_buffers_within_their_time_are_kept(spark):
    out = run_files(spark, [[("a", 0, 1), ("b", 0, 2)], [("b", 30, 4)], [("a", 31, 7), ("a", 5, 8)]],
                    delay="60 days", ttl_days=10 / 24)
    got = {r["user_pseudo_id"]: r["recent_items"] for r in latest_per_user(out).collect()}
    assert got == {"a": ["i1", "i8", "i7"], "b": ["i2", "i4"]}


def test_a_buffer_holds_the_latest_n(spark):
    out = run_files(spark, [[("a", h, h) for h in range(0, 40, 2)], [("a", h, h) for h in range(1, 40, 2)]], n=5)
    assert latest_per_user(out).first()["recent_items"] == [f"i{e}" for e in range(35, 40)]


def test_rows_merge_as_plain_tuples_in_bounded_memory(monkeypatch):
    from tailorspark.streaming import recent_events as R

    monkeypatch.setattr(R, "CHUNK", 4)
    old = [(1, 1, "old"), (5, 2, "old")]
    new = [(t, t % 3 if t % 4 else None, f"n{t}") for t in (9, 3, 7, 3, 8, 1, 4, 6, 2, 5)] + [(5, 2, "again")]
    got, seen = R.latest(old, iter(new), 6)
    want = sorted(old + new, key=lambda r: (r[0], r[1] is not None, r[1]))[-6:]
    assert got == want and seen == len(new)
    assert R.latest([], iter([(1, None, "a"), (1, 0, "b")]), 20) == ([(1, None, "a"), (1, 0, "b")], 2)
