"""Cold-start lookup: global defaults (A4), backoff table (A5), resolve.

The table is built with one GROUPING SETS pass over a pre-aggregate:
users are first reduced to (context keys, cluster, top category) with counts
and revenue sums, so the ten-fold expansion runs on distinct combinations,
not on users.  Modes are arg-max of summed counts (ties: smallest value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailorspark import constants as K
from tailorspark.session import stored

# Revenue is summed exactly so that group means do not depend on the order in
# which partitions are merged.
EXACT = "decimal(28,8)"


def level_name(level: tuple[str, ...]) -> str:
    return "+".join(level) if level else "global"


def present_levels(columns: list[str]) -> list[tuple[int, tuple[str, ...]]]:
    """(order, level) for levels whose columns all exist (order is 1-based)."""
    return [(i, lvl) for i, lvl in enumerate(K.BACKOFF_LEVELS, 1) if all(c in columns for c in lvl)]


def global_defaults(activity: DataFrame, users: DataFrame) -> DataFrame:
    """A4: one row (global_top_category, global_cluster).

    The event-level mode of ItemCategory (else 'Featured Products') and the
    mode of the users' target cluster (else 0); both are small aggregates.
    """
    if "ItemCategory" in activity.columns:
        top = (activity.where(F.col("ItemCategory").isNotNull()).groupBy("ItemCategory")
               .agg(F.count(F.lit(1)).alias("n"))
               .agg(F.min_by("ItemCategory", F.struct((-F.col("n")).alias("a"), F.col("ItemCategory").alias("b")))
                    ).scalar())
        top = F.coalesce(top, F.lit(K.GLOBAL_TOP_CATEGORY))
    else:
        top = F.lit(K.GLOBAL_TOP_CATEGORY)
    cl = users.agg(F.coalesce(F.mode("target_cluster", True), F.lit(K.GLOBAL_CLUSTER)).cast("int")).scalar()
    return users.sparkSession.range(1).select(top.alias("global_top_category"), cl.alias("global_cluster"))


def min_support_col(users: DataFrame, override: int | None = None):
    """Override, else max(10, floor(n_users * 0.0005)) as a scalar; 0 counts as unset."""
    if override:
        return F.lit(int(override)).cast("long")
    return users.agg(F.greatest(F.lit(K.MIN_SUPPORT_FLOOR).cast("long"),
                                F.floor(F.count(F.lit(1)) * K.MIN_SUPPORT_FRACTION).cast("long"))).scalar()


def coldstart_table(users: DataFrame, activity: DataFrame, min_support: int | None = None,
                    defaults: DataFrame | None = None) -> DataFrame:
    """A5: one row per supported group of every backoff level.

    ``users`` needs the context keys, ``target_cluster``, ``total_revenue``
    and optionally ``top_category``.  Output: level, level_order, the four
    keys (null when not part of the level), support, top_category, cluster,
    avg_revenue.  The global row is exempt from the support rule.
    """
    keys = [c for c in K.BACKOFF_KEYS if c in users.columns]
    levels = present_levels(keys)
    if "top_category" not in users.columns:
        users = users.withColumn("top_category", F.lit(None).cast("string"))
    pre = users.groupBy(*keys, "target_cluster", "top_category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("total_revenue").cast(EXACT)).alias("rev"))

    sets = [[*lvl, "target_cluster"] for _, lvl in levels] + [[*lvl, "top_category"] for _, lvl in levels]
    g = pre.groupingSets([[F.col(c) for c in s] for s in sets], *keys, "target_cluster", "top_category").agg(
        F.sum("n").alias("n"), F.sum("rev").alias("rev"), F.grouping_id().alias("_gid"))
    # grouping_id bits: keys..., target_cluster (2), top_category (1); set bit = rolled up
    nk = len(keys)
    level_gid = F.shiftright("_gid", 2)
    order = F.lit(None).cast("int")
    for o, lvl in reversed(levels):
        gid = sum(1 << (nk - 1 - i) for i, c in enumerate(keys) if c not in lvl)
        order = F.when(level_gid == gid, F.lit(o)).otherwise(order)
    g = g.withColumn("level_order", order)
    is_c = (F.col("_gid") % 4) == 1
    is_t = ((F.col("_gid") % 4) == 2) & F.col("top_category").isNotNull()
    agg = g.groupBy("level_order", *keys).agg(
        F.sum(F.when(is_c, F.col("n"))).alias("support"),
        F.sum(F.when(is_c, F.col("rev"))).alias("rev"),
        F.min_by(F.when(is_c, F.col("target_cluster")),
                 F.when(is_c, F.struct((-F.col("n")).alias("a"), F.col("target_cluster").alias("b")))).alias("cluster"),
        F.min_by(F.col("top_category"),
                 F.when(is_t, F.struct((-F.col("n")).alias("a"), F.col("top_category").alias("b")))).alias("_top"),
    )
    ms = min_support_col(users, min_support)
    gd = (defaults if defaults is not None else global_defaults(activity, users)).select(
        "global_top_category").scalar()
    agg = agg.withColumns({"min_support": ms, "global_top_category": gd})
    names = F.lit(None).cast("string")
    for o, lvl in reversed(levels):
        names = F.when(F.col("level_order") == o, F.lit(level_name(lvl))).otherwise(names)
    global_order = len(K.BACKOFF_LEVELS)
    out = agg.where((F.col("support") >= F.col("min_support")) | (F.col("level_order") == global_order))
    return out.select(
        names.alias("level"),
        F.col("level_order").cast("int"),
        *[F.col(c) if c in keys else F.lit(None).cast("string").alias(c) for c in K.BACKOFF_KEYS],
        F.col("support").cast("long"),
        F.coalesce("_top", "global_top_category").alias("top_category"),
        F.col("cluster").cast("int"),
        (F.col("rev").cast("double") / F.col("support")).alias("avg_revenue"),
    )


def _payload(order: int, lvl: tuple[str, ...], prefix: str = ""):
    src = K.SOURCE_GLOBAL if not lvl else K.SOURCE_LOOKUP_PREFIX + level_name(lvl)
    return F.struct(
        F.col(prefix + "cluster").alias("cluster"),
        F.col(prefix + "top_category").alias("top_category"),
        F.col(prefix + "avg_revenue").alias("avg_revenue"),
        F.lit(src).alias("source"),
        F.lit(level_name(lvl)).alias("match_level"),
        F.lit(order).alias("level_order"),
    )


def _global_payload(table: DataFrame, defaults: DataFrame):
    """Scalar: the global payload; the defaults' constants when the table has none."""
    g_order = len(K.BACKOFF_LEVELS)
    g = table.where(F.col("level_order") == g_order).select(_payload(g_order, ())).scalar()
    fallback = defaults.select(F.struct(
        F.col("global_cluster").alias("cluster"), F.col("global_top_category").alias("top_category"),
        F.lit(0.0).alias("avg_revenue"), F.lit(K.SOURCE_GLOBAL).alias("source"),
        F.lit("global").alias("match_level"), F.lit(g_order).alias("level_order"))).scalar()
    return F.coalesce(g, fallback)


#: Rows of a backoff level up to which it is sent to every executor (some 100 bytes a row).
BROADCAST_ROWS = 200_000


def lookup_index(table: DataFrame) -> DataFrame:
    """The backoff table as one lookup: (lo, kv, _m), the level, its keys as an array, the payload.  Stored."""
    level = {o: lvl for o, lvl in present_levels(list(K.BACKOFF_KEYS)) if lvl}
    kv, payload = F.lit(None).cast("array<string>"), None
    for o, lvl in level.items():
        here = F.col("level_order") == o
        kv = F.when(here, F.array(*[F.col(c) for c in lvl])).otherwise(kv)
        payload = F.when(here, _payload(o, lvl)) if payload is None else payload.when(here, _payload(o, lvl))
    return stored(table.where(F.col("level_order").isin(*level)).select(
        F.col("level_order").alias("lo"), kv.alias("kv"), payload.alias("_m")), "backoff")


def resolve_cold_start(requests: DataFrame, table: DataFrame, defaults: DataFrame, key: str = "request_id",
                       broadcast_rows: int = BROADCAST_ROWS, index: DataFrame | None = None) -> DataFrame:
    """Add ``resolved`` = first level (in backoff order) whose keys all match.

    The lookup is stored and its rows are counted.  If no level has more than
    ``broadcast_rows``, every level is broadcast and joined map-side: requests are
    never shuffled (under the default support rule a level holds at most about
    n / max(10, n/2000) < 2,200 groups whatever n is).  Else requests are exploded
    to one row per level key and equi-joined on (level, key), and the lowest level
    wins per request.  ``index``: ``lookup_index(table)``, if it is at hand (a stream
    makes it once).
    """
    keys = [c for c in K.BACKOFF_KEYS if c in requests.columns]
    levels = [(o, lvl) for o, lvl in present_levels(keys) if lvl]
    req = requests
    for c in keys:
        req = req.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(K.UNKNOWN)))
    glob = _global_payload(table, defaults)
    index = lookup_index(table) if index is None else index
    largest = max((r["n"] for r in index.groupBy("lo").agg(F.count(F.lit(1)).alias("n")).collect()), default=0)  # 9 rows
    if largest <= broadcast_rows:
        names = []
        for o, lvl in levels:
            t = index.where(F.col("lo") == o).select(F.col("kv").alias(f"_k{o}"), F.col("_m").alias(f"_m{o}"))
            req = req.join(F.broadcast(t), F.array(*[F.col(c) for c in lvl]) == F.col(f"_k{o}"), "left").drop(f"_k{o}")
            names.append(f"_m{o}")
        return req.withColumn("resolved", F.coalesce(*[F.col(n) for n in names], glob)).drop(*names)
    probes = F.array(*[F.struct(F.lit(o).alias("lo"), F.array(*[F.col(c) for c in lvl]).alias("kv"))
                       for o, lvl in levels])
    exploded = req.select(key, F.explode(probes).alias("_p")).select(key, "_p.lo", "_p.kv")
    best = exploded.join(index, ["lo", "kv"]).groupBy(key).agg(F.min_by("_m", "lo").alias("_best"))
    out = req.join(best, key, "left")
    return out.withColumn("resolved", F.coalesce(F.col("_best"), glob)).drop("_best")


# -- S7: lookup tables -----------------------------------------------------------
def save_lookup_tables(path: str, table: DataFrame, defaults: DataFrame, names: DataFrame | None = None) -> None:
    """Persist the cold-start table, global defaults and segment names as parquet."""
    table.write.mode("overwrite").parquet(f"{path}/cold_start")
    defaults.write.mode("overwrite").parquet(f"{path}/defaults")
    if names is not None:
        names.write.mode("overwrite").parquet(f"{path}/segment_names")


def load_lookup_tables(spark, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reload (table, defaults, names); absent parts fall back like a fresh service:
    no table -> every request resolves to the global default; no names -> the
    fixed persona order."""
    from pyspark.sql.utils import AnalysisException

    def read(sub):
        try:
            return spark.read.parquet(f"{path}/{sub}")
        except AnalysisException:
            return None

    table = read("cold_start")
    if table is None:
        table = spark.createDataFrame([], "level string, level_order int, region string, category string, "
                                          "source string, medium string, support long, top_category string, "
                                          "cluster int, avg_revenue double")
    defaults = read("defaults")
    if defaults is None:
        defaults = spark.createDataFrame([(K.GLOBAL_TOP_CATEGORY, K.GLOBAL_CLUSTER)],
                                         "global_top_category string, global_cluster int")
    names = read("segment_names")
    if names is None:
        names = spark.createDataFrame(list(enumerate(K.PERSONA_ORDER)), "target_cluster int, segment_name string")
    return table, defaults, names
