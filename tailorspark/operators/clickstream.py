"""Browser click log operators.

The browser keeps the latest 20 well-formed product clicks per visitor and
derives the request signals from them.  Here the log is a table: one raw
JSON log per user, or one row per click event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailorspark import constants as K
from tailorspark.functions.columns import display_category
from tailorspark.operators.catalog import lookup_items


def valid_events(logs: DataFrame, log_col: str = "log", key: str = "user_pseudo_id") -> DataFrame:
    """Entries of a raw JSON array log with event_name 'view_item' and a
    string item_name.  A log that is not a JSON array yields nothing.

    Parsing goes through VARIANT so the JSON type of item_name is checked
    (a number is not a string).  Output: key, seq (0-based), item_name.
    """
    v = F.try_parse_json(F.col(log_col))
    arr = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    ex = logs.select(key, F.posexplode(arr).alias("seq", "e"))
    name_t = F.schema_of_variant(F.try_variant_get("e", "$.item_name", "variant"))
    return ex.where(
        (F.try_variant_get("e", "$.event_name", "string") == "view_item") & (name_t == "STRING")
    ).select(key, F.col("seq").cast("int"), F.try_variant_get("e", "$.item_name", "string").alias("item_name"))


def recent_events(events: DataFrame, n: int = K.RECENT_EVENTS_MAX, key: str = "user_pseudo_id",
                  ts: str = "event_ts", tie: str = "event_id") -> DataFrame:
    """Each user's latest ``n`` events with ``position`` 1..n, oldest first.

    ``row_number() <= n`` is planned as a WindowGroupLimit (partial top-n per
    map task), so a user with a third of all events ships n rows per task.
    """
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    last = events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    cnt = F.count(F.lit(1)).over(Window.partitionBy(key))
    return last.withColumn("position", (cnt - F.col("_rn") + 1).cast("int")).drop("_rn")


def recent_signals(events: DataFrame, catalog: DataFrame, n: int = K.RECENT_EVENTS_MAX,
                   key: str = "user_pseudo_id") -> DataFrame:
    """Request signals from each user's latest ``n`` click events.

    Display categories that are empty are looked up by item reference; a
    miss gives 'Unknown'.  Counts are max(1, length) as the client sends them.
    """
    last = recent_events(events, n, key)
    miss = F.coalesce(F.col("display_category"), F.lit("")) == ""
    need = last.where(miss).select(key, "event_id", "item_name")
    looked = lookup_items(need, catalog, "item_name").select(
        key, "event_id", F.coalesce("item_display_category", F.lit(K.UNKNOWN_CATEGORY)).alias("_looked"))
    last = last.join(looked, [key, "event_id"], "left").withColumn(
        "_display", F.when(miss, F.col("_looked")).otherwise(F.col("display_category")))
    g = last.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        "position", "event_name", "item_name", "category", "_display"))).alias("_e"))
    seq = F.transform("_e", lambda e: e["event_name"])
    items = F.transform("_e", lambda e: e["item_name"])
    return g.select(
        key,
        F.greatest(F.lit(1), F.size(seq)).alias("total_events"),
        F.greatest(F.lit(1), F.size(items)).alias("unique_pages"),
        seq.alias("recent_sequence"), items.alias("recent_items"),
        F.transform("_e", lambda e: e["category"]).alias("recent_categories"),
        F.transform("_e", lambda e: e["_display"]).alias("recent_display_categories"),
    )


def click_event(item_ref_col: str, catalog: DataFrame, df: DataFrame) -> DataFrame:
    """trackProductClick as a projection: the recorded event for a reference."""
    out = lookup_items(df, catalog, item_ref_col)
    return out.withColumns({
        "event_name": F.lit("view_item"),
        "item_name": F.col(item_ref_col),
        "category": F.coalesce("item_category", F.lit(K.CLIENT_UNKNOWN_CATEGORY)),
        "display_category": F.coalesce(display_category("item_display_category", "item_category"),
                                       F.lit(K.UNKNOWN_CATEGORY)),
        "page_path": F.concat(F.lit("/products/"), F.col(item_ref_col), F.lit("/")),
    })
