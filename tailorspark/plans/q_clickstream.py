"""Registered clickstream, sequence and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailorspark.functions.columns import array_text
from tailorspark.operators.clickstream import recent_events, recent_signals, valid_events
from tailorspark.operators.features import event_positions, event_sequences, event_vocab, with_event_ids
from tailorspark.plans.oracle import activity_cte, client_events_ctes, recent_signals_ctes, with_ctes
from tailorspark.plans.registry import register
from tailorspark.session import scratch_dir
from tailorspark.sources.tables import (
    activity, catalog, client_events, client_events_from, client_logs, read_table)
from tailorspark.streaming.recent_events import buffer_stream, latest_per_user, run_to_completion

#: T1's event files: triggers that take them, and rows of a file.
TRIGGERS, ROWS_PER_FILE = 4, 500_000

SIGNAL_COLS = ["user_pseudo_id", "total_events", "unique_pages", "recent_sequence", "recent_items",
               "recent_categories", "recent_display_categories"]


def _signals_out(df):
    return df.select(*[array_text(c).alias(c) if c.startswith("recent_") else c for c in SIGNAL_COLS])


# -- X19 ----------------------------------------------------------------------
VALID_SQL = """
WITH ev AS (SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
last AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM ev),
kept AS (SELECT * FROM last WHERE rn <= 20),
ordered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM kept)
SELECT CAST(user_id AS VARCHAR) AS user_pseudo_id, CAST(seq AS INTEGER) AS seq, CAST(k AS VARCHAR) AS item_name
FROM ordered
WHERE user_id % 9 <> 0 AND event_type NOT IN ('error', 'signup')"""


@register("valid_events", lambda: VALID_SQL)
def q_valid_events(spark, sf_dir):
    return valid_events(client_logs(spark, sf_dir))


# -- W1 -----------------------------------------------------------------------
@register("recent_events", lambda: with_ctes(client_events_ctes(), """
SELECT user_pseudo_id, CAST(position AS INTEGER) AS position, event_id, item_name FROM (
  SELECT *, count(*) OVER (PARTITION BY user_pseudo_id) - rn + 1 AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY user_pseudo_id ORDER BY event_ts DESC, event_id DESC) AS rn FROM ce)
  WHERE rn <= 20)"""))
def q_recent_events(spark, sf_dir):
    return recent_events(client_events(spark, sf_dir)).select("user_pseudo_id", "position", "event_id", "item_name")


# -- X20 ----------------------------------------------------------------------
SIGNALS_SQL = lambda: with_ctes(recent_signals_ctes(), "SELECT * FROM signals")


@register("recent_signals", SIGNALS_SQL)
def q_recent_signals(spark, sf_dir):
    return _signals_out(recent_signals(client_events(spark, sf_dir), catalog(spark, sf_dir)))


# -- T1 -----------------------------------------------------------------------
@register("stream_recent_events", SIGNALS_SQL)
def q_stream_recent_events(spark, sf_dir):
    """T1 over a file stream of raw events, dealt to files out of their order and read a quarter of them a trigger; the
    final buffer equals X20."""
    from tailorspark.operators.catalog import lookup_items

    raw = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    base = scratch_dir(spark, "t1")
    files = max(1, -(-raw.count() // (TRIGGERS * ROWS_PER_FILE)))  # of a trigger: their readers share its work
    raw.repartition(TRIGGERS * files, "event_id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in")
    clicks = client_events_from(stream, spark, sf_dir)
    # resolve empty display categories before buffering (stream-static lookup)
    miss = F.coalesce(F.col("display_category"), F.lit("")) == ""
    clicks = lookup_items(clicks, catalog(spark, sf_dir), "item_name").withColumn(
        "display_category", F.when(miss, F.coalesce("item_display_category", F.lit("Unknown")))
        .otherwise(F.col("display_category")))
    out = run_to_completion(spark, buffer_stream(clicks), f"{base}/out", f"{base}/ckpt")
    return _signals_out(latest_per_user(out))


# -- A10 ----------------------------------------------------------------------
@register("event_vocab", lambda: with_ctes([("activity", activity_cte("visit"))], """
SELECT event_name, CAST(row_number() OVER (ORDER BY event_name) AS INTEGER) AS event_index
FROM (SELECT DISTINCT event_name FROM activity WHERE event_name IS NOT NULL)
UNION ALL SELECT '<PAD>', 0"""))
def q_event_vocab(spark, sf_dir):
    return event_vocab(activity(spark, sf_dir, "visit"))


# -- J6 -----------------------------------------------------------------------
@register("event_ids", lambda: with_ctes([("activity", activity_cte("visit"))], """
SELECT a.event_id, a.user_pseudo_id, coalesce(v.event_index, 0) AS event_index
FROM activity a LEFT JOIN (SELECT event_name, CAST(row_number() OVER (ORDER BY event_name) AS INTEGER) AS event_index
  FROM (SELECT DISTINCT event_name FROM activity WHERE event_name IS NOT NULL)) v ON v.event_name = a.event_name"""))
def q_event_ids(spark, sf_dir):
    act = activity(spark, sf_dir, "visit")
    return with_event_ids(act, event_vocab(act)).select("event_id", "user_pseudo_id", "event_index")


# -- A9 + J7 + X22 ------------------------------------------------------------
def _seq_sql(grain: str, n: int = 25) -> str:
    return with_ctes([("activity", activity_cte(grain)), ("voc", """
SELECT event_name, CAST(row_number() OVER (ORDER BY event_name) AS INTEGER) AS event_index
FROM (SELECT DISTINCT event_name FROM activity WHERE event_name IS NOT NULL)"""), ("ev", """
SELECT a.user_pseudo_id, a.event_ts, a.event_id, a.event_name, v.event_index,
       row_number() OVER (PARTITION BY a.user_pseudo_id ORDER BY a.event_ts, a.event_id) AS r_asc,
       row_number() OVER (PARTITION BY a.user_pseudo_id ORDER BY a.event_ts DESC, a.event_id DESC) AS r_desc
FROM activity a LEFT JOIN voc v ON v.event_name = a.event_name WHERE a.user_pseudo_id IS NOT NULL""")], f"""
SELECT user_pseudo_id, count(*) AS n_events,
       array_to_string(list(CAST(coalesce(event_index, 0) AS VARCHAR) ORDER BY event_ts, event_id) FILTER (WHERE r_asc <= {n}), ',')
         AS fit_ids,
       array_to_string(list(event_name ORDER BY event_ts, event_id) FILTER (WHERE r_asc <= {n}), ',') AS fit_names,
       array_to_string(list(event_name ORDER BY event_ts, event_id) FILTER (WHERE r_desc <= {n}), ',') AS eval_names
FROM ev GROUP BY user_pseudo_id""")


def _seq_query(spark, sf_dir, grain):
    seqs = event_sequences(activity(spark, sf_dir, grain))
    return seqs.select("user_pseudo_id", "n_events",
                       F.array_join(F.transform("first_ids", lambda x: x.cast("string")), ",").alias("fit_ids"),
                       array_text("first_names").alias("fit_names"), array_text("last_names").alias("eval_names"))


@register("event_sequences", lambda: _seq_sql("visit"))
def q_event_sequences(spark, sf_dir):
    return _seq_query(spark, sf_dir, "visit")


@register("sequence_slices", lambda: _seq_sql("user"))
def q_sequence_slices(spark, sf_dir):
    """User grain: users have up to ~100 events, so first-25 and last-25 differ."""
    return _seq_query(spark, sf_dir, "user")


# -- A9, long form ------------------------------------------------------------
@register("event_positions", lambda: with_ctes([("activity", activity_cte("user")), ("voc", """
SELECT event_name, CAST(row_number() OVER (ORDER BY event_name) AS INTEGER) AS event_index
FROM (SELECT DISTINCT event_name FROM activity WHERE event_name IS NOT NULL)""")], """
SELECT user_pseudo_id, row_number() OVER (PARTITION BY user_pseudo_id ORDER BY event_ts, event_id) - 1 AS position,
       count(*) OVER (PARTITION BY user_pseudo_id) AS n_events, event_id, event_name,
       coalesce(event_index, 0) AS event_index
FROM activity LEFT JOIN voc USING (event_name) WHERE user_pseudo_id IS NOT NULL"""))
def q_event_positions(spark, sf_dir):
    return event_positions(activity(spark, sf_dir, "user"))
