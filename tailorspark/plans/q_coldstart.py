"""Registered cold-start queries (A4, A5, J4, X5) and request defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailorspark import constants as K
from tailorspark.functions.columns import array_text, business_tags, coldstart_tags, device_category
from tailorspark.operators.coldstart import coldstart_table, global_defaults, level_name, resolve_cold_start
from tailorspark.operators.segments import training_frame
from tailorspark.plans.oracle import (
    DEVICE_SQL, TAGS_SQL, request_defaults_cte, requests_ctes, training_ctes, with_ctes)
from tailorspark.plans.registry import register
from tailorspark.sources.requests import apply_request_defaults, parse_requests, requests_as_json
from tailorspark.sources.tables import AS_OF, activity, request_extra, requests
from tailorspark.session import stored

CS_COLS = ["level", "level_order", "region", "category", "source", "medium", "support", "top_category",
           "cluster", "avg_revenue"]


def coldstart_parts(spark, sf_dir, min_support=None, materialize=False):
    """Activity, training users, cold-start table and global defaults.

    ``materialize`` stores the activity (for requests made of the same events, which
    are then read once) and the fitted artefacts (global defaults and the small
    lookup table) in the shared folder, cutting their lineage for the request-side
    plans that join them many times.
    """
    act = activity(spark, sf_dir, "visit")
    if materialize:
        act = stored(act, "activity")
    # the rollup under ``users`` is already stored by training_frame; users
    # itself is a cheap projection over it
    users = training_frame(act, AS_OF, extra=request_extra() if materialize else ())
    defaults = global_defaults(act, users)
    if materialize:
        defaults = stored(defaults, "defaults")
    table = coldstart_table(users, act, min_support, defaults=defaults)
    if materialize:
        table = stored(table, "coldstart")
    return act, users, table, defaults


def default_requests(spark, sf_dir, act=None, rollup=None):
    """Request fixture -> JSON payloads -> parsed with typed defaults."""
    raw = requests_as_json(requests(spark, sf_dir, act=act, rollup=rollup))
    return apply_request_defaults(parse_requests(raw, "payload", keep=["request_id", "user_agent"]))


# ---------------------------------------------------------------------------
# SQL
# ---------------------------------------------------------------------------
def _cs_level_ctes(min_support_sql: str) -> list[tuple[str, str]]:
    ctes = [
        ("cs_ms", min_support_sql),
        ("cs_gtop", "SELECT coalesce((SELECT ItemCategory FROM activity WHERE ItemCategory IS NOT NULL "
                    "GROUP BY ItemCategory ORDER BY count(*) DESC, ItemCategory LIMIT 1), "
                    f"'{K.GLOBAL_TOP_CATEGORY}') AS gtop"),
    ]
    parts = []
    for o, lvl in enumerate(K.BACKOFF_LEVELS, 1):
        cols = list(lvl)
        keysel = ", ".join(f"{c}" if c in cols else f"CAST(NULL AS VARCHAR) AS {c}" for c in K.BACKOFF_KEYS)
        if cols:
            g = ", ".join(cols)
            using = f"USING ({g})"
            ctes.append((f"cs{o}_a", f"SELECT {g}, count(*) AS support, "
                                     "CAST(sum(CAST(total_revenue AS DECIMAL(28,8))) AS DOUBLE) / count(*) AS avg_revenue "
                                     f"FROM training GROUP BY {g}"))
            ctes.append((f"cs{o}_c", f"""SELECT {g}, target_cluster FROM (SELECT {g}, target_cluster,
  row_number() OVER (PARTITION BY {g} ORDER BY count(*) DESC, target_cluster) AS rn
  FROM training GROUP BY {g}, target_cluster) WHERE rn = 1"""))
            ctes.append((f"cs{o}_t", f"""SELECT {g}, top_category FROM (SELECT {g}, top_category,
  row_number() OVER (PARTITION BY {g} ORDER BY count(*) DESC, top_category) AS rn
  FROM training WHERE top_category IS NOT NULL GROUP BY {g}, top_category) WHERE rn = 1"""))
            parts.append(f"""SELECT '{level_name(lvl)}' AS level, {o} AS level_order, {keysel},
       a.support, coalesce(t.top_category, gt.gtop) AS top_category, c.target_cluster AS cluster, a.avg_revenue
FROM cs{o}_a a JOIN cs{o}_c c {using} LEFT JOIN cs{o}_t t {using}, cs_ms, cs_gtop gt
WHERE a.support >= cs_ms.min_support""")
        else:
            parts.append(f"""SELECT 'global' AS level, {o} AS level_order, {keysel},
       (SELECT count(*) FROM training) AS support,
       coalesce((SELECT top_category FROM training WHERE top_category IS NOT NULL GROUP BY top_category
                 ORDER BY count(*) DESC, top_category LIMIT 1), (SELECT gtop FROM cs_gtop)) AS top_category,
       (SELECT target_cluster FROM training GROUP BY target_cluster ORDER BY count(*) DESC, target_cluster
        LIMIT 1) AS cluster,
       (SELECT CAST(sum(CAST(total_revenue AS DECIMAL(28,8))) AS DOUBLE) / count(*) FROM training) AS avg_revenue""")
    ctes.append(("cs_table", "\nUNION ALL\n".join(parts)))
    return ctes


def _ms_sql(override=None):
    if override:
        return f"SELECT CAST({int(override)} AS BIGINT) AS min_support"
    return (f"SELECT greatest({K.MIN_SUPPORT_FLOOR}, CAST(floor(count(*) * {K.MIN_SUPPORT_FRACTION}) AS BIGINT)) "
            "AS min_support FROM training")


def cs_ctes(override=None):
    return training_ctes() + _cs_level_ctes(_ms_sql(override))


def _resolve_ctes(override=None) -> list[tuple[str, str]]:
    """Training + cold table + request fixture with defaults + resolution."""
    ctes = cs_ctes(override)
    rq = [c for c in requests_ctes() if c[0] != "activity"]
    ctes += rq + [request_defaults_cte()]
    joins, cl, tc, av, src, ml = [], [], [], [], [], []
    for o, lvl in enumerate(K.BACKOFF_LEVELS, 1):
        if not lvl:
            continue
        cond = " AND ".join(f"l{o}.{c} = r.{c}" for c in lvl)
        joins.append(f"LEFT JOIN (SELECT * FROM cs_table WHERE level_order = {o}) l{o} ON {cond}")
        cl.append(f"l{o}.cluster")
        tc.append(f"l{o}.top_category")
        av.append(f"l{o}.avg_revenue")
        src.append(f"CASE WHEN l{o}.level IS NOT NULL THEN '{K.SOURCE_LOOKUP_PREFIX}{level_name(lvl)}' END")
        ml.append(f"CASE WHEN l{o}.level IS NOT NULL THEN '{level_name(lvl)}' END")
    g = len(K.BACKOFF_LEVELS)
    ctes.append(("resolved", f"""
SELECT r.*,
       coalesce({', '.join(cl)}, g.cluster) AS cs_cluster,
       coalesce({', '.join(tc)}, g.top_category) AS cs_top_category,
       coalesce({', '.join(av)}, g.avg_revenue) AS cs_avg_revenue,
       coalesce({', '.join(src)}, '{K.SOURCE_GLOBAL}') AS cs_source,
       coalesce({', '.join(ml)}, 'global') AS cs_match_level
FROM req r
{chr(10).join(joins)}
CROSS JOIN (SELECT * FROM cs_table WHERE level_order = {g}) g"""))
    return ctes


def resolve_ctes(override=None):
    return _resolve_ctes(override)


def _cs_select(df):
    return df.select(*[F.round("avg_revenue", 4).alias("avg_revenue") if c == "avg_revenue" else c
                       for c in CS_COLS])


CS_SQL_SELECT = "SELECT " + ", ".join(
    "round(avg_revenue, 4) AS avg_revenue" if c == "avg_revenue" else
    ("CAST(level_order AS INTEGER) AS level_order" if c == "level_order" else
     ("CAST(support AS BIGINT) AS support" if c == "support" else
      ("CAST(cluster AS INTEGER) AS cluster" if c == "cluster" else c))) for c in CS_COLS) + " FROM cs_table"


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------
@register("coldstart_global", lambda: with_ctes(training_ctes() + _cs_level_ctes(_ms_sql())[:2], """
SELECT (SELECT gtop FROM cs_gtop) AS global_top_category,
       CAST((SELECT target_cluster FROM training GROUP BY target_cluster ORDER BY count(*) DESC, target_cluster
             LIMIT 1) AS INTEGER) AS global_cluster"""))
def q_coldstart_global(spark, sf_dir):
    act = activity(spark, sf_dir, "visit")
    return global_defaults(act, training_frame(act, AS_OF))


@register("coldstart_table", lambda: with_ctes(cs_ctes(), CS_SQL_SELECT))
def q_coldstart_table(spark, sf_dir):
    return _cs_select(coldstart_parts(spark, sf_dir)[2])


@register("coldstart_table_support3", lambda: with_ctes(cs_ctes(3), CS_SQL_SELECT))
def q_coldstart_table_support3(spark, sf_dir):
    """A5 with a min_support override of 3 (no size bound on the levels)."""
    return _cs_select(coldstart_parts(spark, sf_dir, 3)[2])


RESOLVE_OUT = ("SELECT request_id, region, category, source, medium, CAST(cs_cluster AS INTEGER) AS cluster, "
               "cs_top_category AS top_category, round(cs_avg_revenue, 4) AS avg_revenue, cs_source AS source_label, "
               "cs_match_level AS match_level FROM resolved")


def _resolve_out(df):
    r = F.col("resolved")
    return df.select("request_id", "region", "category", "source", "medium",
                     r["cluster"].cast("int").alias("cluster"), r["top_category"].alias("top_category"),
                     F.round(r["avg_revenue"], 4).alias("avg_revenue"), r["source"].alias("source_label"),
                     r["match_level"].alias("match_level"))


@register("coldstart_resolve", lambda: with_ctes(resolve_ctes(), RESOLVE_OUT))
def q_coldstart_resolve(spark, sf_dir):
    act, users, table, defaults = coldstart_parts(spark, sf_dir, materialize=True)
    return _resolve_out(resolve_cold_start(default_requests(spark, sf_dir, act, users), table, defaults))


@register("coldstart_resolve_support3", lambda: with_ctes(resolve_ctes(3), RESOLVE_OUT))
def q_coldstart_resolve_support3(spark, sf_dir):
    """J4 through the shuffle (level, key) join used when a level is larger than what is broadcast."""
    act, users, table, defaults = coldstart_parts(spark, sf_dir, 3, materialize=True)
    return _resolve_out(resolve_cold_start(default_requests(spark, sf_dir, act, users), table, defaults, broadcast_rows=0))


COLD_TAGS_SQL = f"""
SELECT request_id, CASE WHEN cs_avg_revenue > {K.HIGH_VALUE_REVENUE}
                        THEN concat(t2, ',{K.TAG_HIGH_VALUE_SEGMENT}') ELSE t2 END AS tags
FROM (SELECT *, CASE WHEN list_contains(string_split(t1, ','), '{K.TAG_NEW_USER}') THEN t1
                     ELSE concat(t1, ',{K.TAG_NEW_USER}') END AS t2
      FROM (SELECT *, {TAGS_SQL} AS t1 FROM resolved))"""


@register("coldstart_tags", lambda: with_ctes(resolve_ctes(), COLD_TAGS_SQL))
def q_coldstart_tags(spark, sf_dir):
    act, users, table, defaults = coldstart_parts(spark, sf_dir, materialize=True)
    res = resolve_cold_start(default_requests(spark, sf_dir, act, users), table, defaults)
    tags = business_tags("total_revenue", "days_since_first_visit", "total_events")
    return res.select("request_id", array_text(coldstart_tags(tags, F.col("resolved")["avg_revenue"])).alias("tags"))


REQ_OUT = ["request_id", "user_pseudo_id", "total_events", "unique_pages", "total_revenue",
           "days_since_first_visit", "recent_sequence", "recent_items", "recent_categories",
           "recent_display_categories", "region", "country", "source", "medium", "Age", "category"]


@register("request_defaults", lambda: with_ctes(
    [c for c in requests_ctes()] + [request_defaults_cte()],
    "SELECT " + ", ".join(
        f"array_to_string({c}, ',') AS {c}" if c.startswith("recent_") else c for c in REQ_OUT) + " FROM req"))
def q_request_defaults(spark, sf_dir):
    df = default_requests(spark, sf_dir)
    return df.select(*[array_text(c).alias(c) if c.startswith("recent_") else c for c in REQ_OUT])


@register("device_category", lambda: with_ctes(
    requests_ctes(), f"SELECT request_id, user_agent, category AS explicit_category, "
                     f"{DEVICE_SQL} AS guessed, coalesce(nullif(category, ''), {DEVICE_SQL}) AS device FROM requests"))
def q_device_category(spark, sf_dir):
    r = requests(spark, sf_dir)
    return r.select("request_id", "user_agent", F.col("category").alias("explicit_category"),
                    device_category("user_agent").alias("guessed"),
                    device_category("user_agent", "category").alias("device"))
