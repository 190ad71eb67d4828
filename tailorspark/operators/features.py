"""User rollup, event vocabulary and ordered event sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailorspark import constants as K
from tailorspark.functions.columns import days_since
from tailorspark.operators.partitioning import dense_index

TIME_COLUMNS = ("eventTimestamp", "event_ts", "timestamp")


def time_column(activity: DataFrame) -> str:
    for c in TIME_COLUMNS:
        if c in activity.columns:
            return c
    raise ValueError("activity has no event time column")


def _as_timestamp(df: DataFrame, c: str):
    dtype = df.schema[c].dataType
    if isinstance(dtype, T.StringType):
        return F.try_to_timestamp(F.col(c))
    return F.col(c).cast("timestamp")


def user_rollup(activity: DataFrame, as_of: str, with_top_category: bool = True, extra: tuple = ()) -> DataFrame:
    """A1 + A2 + A3 + X1: one row per user.

    Counts, sums, minima and ``extra`` (further aggregates of a user's events) take
    one hash aggregation.  Modes and distinct pages come from counted values: one
    row for each user, column and value, counted map-side and dealt by all three,
    so a hot user is spread over its values; then the most frequent of a user's
    values, ties the smallest, as ``mode(x, true)`` has it.  (A ``mode`` aggregate
    encodes a hash map for every user and column at every exchange.)
    """
    ts = _as_timestamp(activity, time_column(activity))
    ctx = [c for c in K.CONTEXT_COLS if c in activity.columns]
    tops = ["ItemCategory"] if with_top_category and "ItemCategory" in activity.columns else []
    events = activity.where(F.col("user_pseudo_id").isNotNull())
    base = events.groupBy("user_pseudo_id").agg(
        F.count("event_name").alias("total_events"),
        F.coalesce(F.sum("purchase_revenue").cast("double"), F.lit(0.0)).alias("total_revenue"),
        F.count_if(F.col("event_name") == "purchase").alias("num_purchases"),
        F.count_if(F.col("event_name") == "add_to_cart").alias("num_cart_adds"),
        F.min(ts).alias("_first_visit"), *extra)
    # texts are counted as strings, a category in its own type
    none = F.lit(None).cast(activity.schema[tops[0]].dataType if tops else "string")
    cells = [F.struct(F.lit(i).alias("_slot"), F.col(c).cast("string").alias("_text"), none.alias("_top"))
             for i, c in enumerate(["page_type", *ctx])]
    cells += [F.struct(F.lit(-1).alias("_slot"), F.lit(None).cast("string").alias("_text"), F.col(c).alias("_top"))
              for c in tops]
    seen = events.select("user_pseudo_id", F.inline(F.array(*cells))).where(
        F.col("_text").isNotNull() | F.col("_top").isNotNull()).groupBy("user_pseudo_id", "_slot", "_text", "_top").agg(
        F.count(F.lit(1)).alias("_n"))

    def most(slot: int, col: str):
        return F.min(F.when(F.col("_slot") == slot, F.struct((-F.col("_n")).alias("n"), F.col(col).alias("v"))))["v"]

    modes = seen.groupBy("user_pseudo_id").agg(
        F.count_if(F.col("_slot") == 0).alias("unique_pages"),
        *[F.coalesce(most(i, "_text"), F.lit(K.UNKNOWN)).alias(c) for i, c in enumerate(ctx, 1)],
        *[most(-1, "_top").alias("top_category") for _ in tops])
    more = [c for c in base.columns if c not in ("user_pseudo_id", "total_events", "total_revenue", "num_purchases",
                                                 "num_cart_adds", "_first_visit")]
    return base.join(modes, "user_pseudo_id", "left").select(
        "user_pseudo_id", "total_events", F.coalesce("unique_pages", F.lit(0)).cast("long").alias("unique_pages"),
        "total_revenue", "num_purchases", "num_cart_adds",
        *[F.coalesce(c, F.lit(K.UNKNOWN)).alias(c) for c in ctx], *["top_category" for _ in tops], *more,
        days_since("_first_visit", as_of).alias("days_since_first_visit"))


def top_category(activity: DataFrame) -> DataFrame:
    """A3 on its own: most frequent non-null ItemCategory per user (ties: smallest)."""
    return (activity.where(F.col("ItemCategory").isNotNull() & F.col("user_pseudo_id").isNotNull())
            .groupBy("user_pseudo_id").agg(F.mode("ItemCategory", True).alias("top_category")))


def event_vocab(activity: DataFrame) -> DataFrame:
    """A10: sorted distinct event names numbered from 1, plus <PAD> = 0."""
    names = activity.where(F.col("event_name").isNotNull()).select("event_name").distinct()
    indexed = dense_index(names, ["event_name"], index_col="_i")
    vocab = indexed.select("event_name", (F.col("_i") + 1).cast("int").alias("event_index"))
    pad = activity.sparkSession.createDataFrame([("<PAD>", 0)], "event_name string, event_index int")
    return vocab.unionByName(pad)


def with_event_ids(activity: DataFrame, vocab: DataFrame) -> DataFrame:
    """Event name -> id through the vocabulary; unknown -> 0.

    The vocabulary holds one row per distinct event name; adaptive execution
    broadcasts it when it is small.
    """
    return activity.join(vocab.where("event_index > 0"), "event_name", "left").withColumn(
        "event_index", F.coalesce(F.col("event_index"), F.lit(0)))


def _ordered_slice(events: DataFrame, key: str, ts: str, n: int, newest: bool, payload: list[str]) -> DataFrame:
    """Up to ``n`` events per key at one end of the time order, oldest first.

    ``row_number() <= n`` becomes a WindowGroupLimit: map tasks pre-limit each
    key to n rows, so a hot key ships n rows per map task, not all its events.
    """
    order = [F.col(ts).desc(), F.col("event_id").desc()] if newest else [F.col(ts).asc(), F.col("event_id").asc()]
    w = Window.partitionBy(key).orderBy(*order)
    kept = events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return kept.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(ts, "event_id", *payload))).alias("_evs"))


def event_sequences(activity: DataFrame, vocab: DataFrame | None = None, max_len: int = K.SEQUENCE_MAX_LEN,
                    users: DataFrame | None = None) -> DataFrame:
    """A9 + X22 + J7: per user the first and last ``max_len`` events in time order.

    Ties on time are broken by ``event_id``; an event without a name has id 0.  Consumers only ever read the
    first or the last ``max_len`` entries (fit/predict vs. evaluation), so the
    arrays are bounded; ``n_events`` carries the full length.  With ``users``
    given, only users present there are kept (inner join).
    """
    ts = time_column(activity)
    ev = activity.where(F.col("user_pseudo_id").isNotNull())
    if vocab is None:
        vocab = event_vocab(activity)
    ev = with_event_ids(ev, vocab).select("user_pseudo_id", ts, "event_id", "event_name", "event_index")
    payload = ["event_index", "event_name"]
    first = _ordered_slice(ev, "user_pseudo_id", ts, max_len, False, payload).select(
        "user_pseudo_id",
        F.transform("_evs", lambda e: e["event_index"]).alias("first_ids"),
        F.transform("_evs", lambda e: e["event_name"]).alias("first_names"))
    last = _ordered_slice(ev, "user_pseudo_id", ts, max_len, True, payload).select(
        "user_pseudo_id",
        F.transform("_evs", lambda e: e["event_index"]).alias("last_ids"),
        F.transform("_evs", lambda e: e["event_name"]).alias("last_names"))
    counts = ev.groupBy("user_pseudo_id").agg(F.count(F.lit(1)).alias("n_events"))
    out = first.join(last, "user_pseudo_id").join(counts, "user_pseudo_id")
    if users is not None:
        out = out.join(users.select("user_pseudo_id"), "user_pseudo_id", "inner")
    return out


def event_positions(activity: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """A9 in long form: every event of every user with its position in time order.

    ``(user_pseudo_id, position, n_events, event_id, event_name, event_index)``,
    position from 0, ties by ``event_id``, id 0 for unnamed events.  No arrays
    and no user's history in one task (``dense_index`` spreads a hot user).
    """
    ts = time_column(activity)
    ev = activity.where(F.col("user_pseudo_id").isNotNull())
    ev = with_event_ids(ev, event_vocab(activity) if vocab is None else vocab)
    ev = ev.select("user_pseudo_id", ts, "event_id", "event_name", "event_index")
    return dense_index(ev, [ts, "event_id"], ["user_pseudo_id"], index_col="position", size_col="n_events").drop(ts)
