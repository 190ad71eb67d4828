"""Views over the driver's test tables.

The reference consumes an activity table (GA4-style events), a product
catalog, request payloads, and a client-side event log.  These functions
derive each of them from the parquet tables in ``sf_dir`` so that every
query's work grows with the data.  All reads are column-pruned; filters are
written so Catalyst pushes them into the scan.

The same views are written as DuckDB SQL in ``tailorspark.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailorspark.constants import SEED, UNKNOWN

AS_OF = "2024-02-15 00:00:00"

#: The stored visitor table is as of this time: the customers' events before it.
STORED_UNTIL = "2024-01-02 12:00:00"

# FIXED VALUES: user-agent strings of the request fixture, chosen by k % 5.
USER_AGENTS = [
    "Mozilla/5.0 (Linux; Android 13; SM-X700) Tablet",
    "Mozilla/5.0 (iPad; CPU OS 17_0 like Mac OS X)",
    "Mozilla/5.0 (Linux; Android 14; Pixel 8) Mobile",
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X)",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64)",
]


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def _prop_k() -> Column:
    return F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT)")


def customer_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> (user_id, region, country, Age).

    nation and region are fixed-size TPC-H dimensions (25 and 5 rows), so they
    are broadcast; the customer side is left to AQE (it grows with the data).
    """
    region = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    geo = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
    cust = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    return cust.join(F.broadcast(geo), cust.c_nationkey == geo.n_nationkey).select(
        F.col("c_custkey").alias("user_id"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("country"),
        F.when(F.col("c_acctbal") < 2000, "18-24").when(F.col("c_acctbal") < 5000, "25-44")
        .otherwise("45+").alias("Age"),
    )


def _events_with_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    return ev.withColumn("k", _prop_k()).drop("props")


def activity(spark: SparkSession, sf_dir: str, grain: str = "visit") -> DataFrame:
    """Event-level activity table (FIXTURES §2).

    ``grain='visit'``: a visitor is one user on one day; ``grain='user'``: the
    customer id itself.  Events are read once; the part table is broadcast if it is
    small, else events without a part meet no other and a much-used part is split
    (adaptive skew join).
    """
    ev = _events_with_k(spark, sf_dir)
    parts = read_table(spark, sf_dir, "part", "p_partkey", "p_type")
    cust = customer_dim(spark, sf_dir)
    if grain == "visit":
        uid = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.col("ts").cast("date").cast("string"))
    elif grain == "user":
        uid = F.col("user_id").cast("string")
    else:
        raise ValueError(f"unknown grain {grain!r}")
    k = F.col("k")
    item_event = F.col("event_type").isin("view", "click", "purchase")
    return (
        ev.join(cust, "user_id")
        .join(parts, F.col("p_partkey") == k.cast("long"), "left")
        .select(
            F.col("event_id"),
            uid.alias("user_pseudo_id"),
            F.when(F.col("event_type") == "view", "view_item")
            .when(F.col("event_type") == "click", "add_to_cart")
            .when(F.col("event_type") == "purchase", "purchase")
            .otherwise("page_view").alias("event_name"),
            F.concat(F.lit("page_"), (k % 10).cast("string")).alias("page_type"),
            F.when(F.col("event_type") == "purchase", F.col("value")).alias("purchase_revenue"),
            F.col("ts").cast("timestamp").alias("event_ts"),
            F.when(k % 3 == 0, "desktop").when(k % 3 == 1, "mobile").otherwise("tablet").alias("category"),
            F.col("region"),
            F.col("country"),
            F.when(k % 5 == 0, "google").when(k % 5 == 1, "direct").when(k % 5 == 2, "newsletter")
            .when(k % 5 == 3, "bing").alias("source"),
            F.when(k % 4 == 0, "organic").when(k % 4 == 1, "cpc").when(k % 4 == 2, "email").alias("medium"),
            F.col("Age"),
            F.when(item_event, F.col("p_type")).alias("ItemCategory"),
            F.col("p_partkey").alias("item_id"),
            k.alias("k"),
        )
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product catalog derived from ``part``; ``catalog_pos`` is file order."""
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    return part.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("subcategory"),
        F.lit(None).cast("string").alias("display_category"),
        F.col("p_retailprice").alias("price"),
        F.concat(F.lit("Part "), F.col("p_name")).alias("description"),
        F.concat(F.lit("/images/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("image_url"),
        F.col("p_partkey").alias("catalog_pos"),
    )


def _last_n_by_time(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows ranked newest-first per key, keeping ``n``.

    ``row_number() <= n`` is planned as a WindowGroupLimit: each map task keeps
    at most n rows per key before the shuffle, so a hot key sends
    n x partitions rows, not all of its events.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.col("event_ts").desc(), F.col("event_id").desc())
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)


def request_extra() -> tuple[Column, ...]:
    """What requests need of a visit beyond the user rollup."""
    return F.min_by("k", "event_id").alias("first_k"), F.min("event_id").alias("first_event_id")


def requests(spark: SparkSession, sf_dir: str, recent_max: int = 20, act: DataFrame | None = None,
             rollup: DataFrame | None = None) -> DataFrame:
    """One personalisation request per visit (FIXTURES §2, requests).

    Numerics and context come from the whole visit; the recent arrays from its
    latest ``recent_max`` events, oldest first.  Every visit whose first event
    id is divisible by 7 carries no context at all.  ``act``: the visits' activity,
    if it is stored already; ``rollup``: their user rollup with ``request_extra``.
    """
    act = activity(spark, sf_dir, "visit") if act is None else act
    if rollup is None:
        from tailorspark.operators.features import user_rollup

        rollup = user_rollup(act, AS_OF, with_top_category=False, extra=request_extra())
    rollup = rollup.select(
        "user_pseudo_id", F.col("total_events").cast("int"), F.col("unique_pages").cast("int"),
        F.round("total_revenue", 2).alias("total_revenue"), F.col("days_since_first_visit").cast("int"),
        "first_k", "first_event_id",
        *[F.nullif(c, F.lit(UNKNOWN)).alias(c) for c in ("category", "region", "country", "source", "medium", "Age")],
    )
    recent = (
        _last_n_by_time(act, "user_pseudo_id", recent_max)
        .groupBy("user_pseudo_id")
        .agg(F.sort_array(F.collect_list(F.struct(
            "event_ts", "event_id", "event_name",
            F.col("item_id").cast("string").alias("item"),
            F.col("ItemCategory").alias("cat")))).alias("evs"))
        .select(
            "user_pseudo_id",
            F.transform("evs", lambda e: e["event_name"]).alias("recent_sequence"),
            F.transform(F.filter("evs", lambda e: e["cat"].isNotNull()), lambda e: e["item"]).alias("recent_items"),
            F.transform(F.filter("evs", lambda e: e["cat"].isNotNull()), lambda e: e["cat"]).alias("recent_categories"),
        )
    )
    no_ctx = (F.col("first_event_id") % 7) == 0
    ua = F.element_at(F.array(*[F.lit(s) for s in USER_AGENTS]), (F.col("first_k") % 5 + 1).cast("int"))
    return rollup.join(recent, "user_pseudo_id").select(
        F.col("user_pseudo_id").alias("request_id"),
        "user_pseudo_id",
        "total_events",
        "unique_pages",
        "total_revenue",
        "days_since_first_visit",
        "recent_sequence",
        "recent_items",
        "recent_categories",
        F.col("recent_categories").alias("recent_display_categories"),
        *[F.when(~no_ctx, F.col(c)).alias(c) for c in ("region", "country", "source", "medium", "Age", "category")],
        ua.alias("user_agent"),
    )


def stored_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of the customers when the visitor table was stored (user grain)."""
    return activity(spark, sf_dir, "user").where(F.col("event_ts") < F.to_timestamp(F.lit(STORED_UNTIL)))


def customer_requests(requests_: DataFrame) -> DataFrame:
    """Requests that name the customer instead of the visit; those of a single event are anonymous."""
    return requests_.withColumn("user_pseudo_id", F.when(
        F.col("total_events") > 1, F.substring_index("request_id", "-", 1)))


def client_events_from(ev: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events (batch or stream) -> product clicks as the browser records them.

    The product reference is an id for most clicks, a product name when
    ``k % 4 == 0`` and an unknown reference when ``k % 4 == 3``; the catalog
    lookup (J2, stream-static when ``ev`` is a stream) resolves it.  The
    display category is left empty when ``k % 5 == 1`` so that readers must
    look it up again (X20).
    """
    from tailorspark.operators.catalog import lookup_items

    ev = ev.where(F.col("event_type").isin("view", "click", "purchase")).withColumn("k", _prop_k())
    names = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    ev = ev.join(names, names.p_partkey == ev.k.cast("long"), "left")
    ref = (
        F.when(F.col("k") % 4 == 0, F.col("p_name"))
        .when(F.col("k") % 4 == 3, F.concat(F.lit("missing-"), F.col("k").cast("string")))
        .otherwise(F.col("k").cast("string"))
    )
    clicks = ev.select(
        F.col("user_id").cast("string").alias("user_pseudo_id"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        "event_id", "k",
        ref.alias("item_ref"),
    )
    return lookup_items(clicks, catalog(spark, sf_dir), "item_ref").select(
        "user_pseudo_id",
        "event_ts",
        "event_id",
        F.lit("view_item").alias("event_name"),
        F.col("item_ref").alias("item_name"),
        F.coalesce(F.col("item_category"), F.lit("UNKNOWN_CATEGORY")).alias("category"),
        F.when(F.col("k") % 5 == 1, F.lit("")).otherwise(
            F.coalesce(F.col("item_display_category"), F.lit("Unknown"))).alias("display_category"),
        F.concat(F.lit("/products/"), F.col("item_ref"), F.lit("/")).alias("page_path"),
    )


def client_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product clicks as the browser records them (user grain)."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "props")
    return client_events_from(ev, spark, sf_dir)


def client_logs(spark: SparkSession, sf_dir: str, recent_max: int = 20) -> DataFrame:
    """Per-user raw JSON log of the browser ring buffer (user grain).

    Built from the user's latest ``recent_max`` events of any type: 'error'
    events are written with a numeric item_name and 'signup' events with a
    non-view event name (both invalid); users with ``user_id % 9 == 0`` have
    a truncated, unparseable log.
    """
    ev = _events_with_k(spark, sf_dir).select(
        F.col("user_id").cast("string").alias("user_pseudo_id"),
        F.col("ts").cast("timestamp").alias("event_ts"),
        "event_id", "event_type", "k", "user_id",
    )
    last = _last_n_by_time(ev, "user_pseudo_id", recent_max)
    entry = F.when(
        F.col("event_type") == "error",
        F.format_string('{"event_name":"view_item","item_name":%d,"seq":%d}', F.col("k"), F.col("event_id")),
    ).otherwise(F.format_string(
        '{"event_name":"%s","item_name":"%s","seq":%d}',
        F.when(F.col("event_type") == "signup", "page_view").otherwise("view_item"),
        F.col("k").cast("string"), F.col("event_id")))
    logs = last.groupBy("user_pseudo_id", "user_id").agg(
        F.sort_array(F.collect_list(F.struct("event_ts", "event_id", entry.alias("j")))).alias("es"))
    text = F.concat(F.lit("["), F.array_join(F.transform("es", lambda e: e["j"]), ","), F.lit("]"))
    return logs.select(
        "user_pseudo_id",
        F.when(F.col("user_id") % 9 == 0, F.substring(text, 1, 12)).otherwise(text).alias("log"),
    )


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder listing derived from part names (unique paths).

    Each name yields ``<name>.png`` and ``<name>.jpg`` (same slug), a
    ``<name>_<size % 3>.webp`` variant whose slug can clash with a generated
    ``-2`` suffix, and ``.TXT`` files that are not images.
    """
    part = read_table(spark, sf_dir, "part", "p_name", "p_size")
    paths = part.select(F.explode(F.array(
        F.concat("p_name", F.lit(".png")),
        F.concat("p_name", F.lit(".jpg")),
        F.concat("p_name", F.lit("_"), (F.col("p_size") % 3).cast("string"), F.lit(".webp")),
        F.concat("p_name", F.lit(".TXT")),
    )).alias("path"))
    return paths.distinct()


def seed_col(*parts: Column | str, seed: int = SEED) -> Column:
    """md5 over ``seed|part1|part2...``: identical in Spark and DuckDB."""
    cols = [F.lit(str(seed))] + [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *cols))
