"""DuckDB SQL equivalents of the views and operators, for the correctness gate.

Each builder returns a CTE body; ``with_ctes`` assembles a full statement.
Modes are written as ``row_number() over (... order by count desc, value)``
because DuckDB's ``mode()`` does not promise the smallest value on ties.
Arrays are compared as joined strings.
"""

from __future__ import annotations

from tailorspark import constants as K
from tailorspark.sources.tables import AS_OF, USER_AGENTS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_ctes(ctes: list[tuple[str, str]], select: str) -> str:
    # stored once: an engine that inlines them evaluates shared ones again for every use
    body = ",\n".join(f"{name} AS MATERIALIZED (\n{sql}\n)" for name, sql in ctes)
    return f"WITH {body}\n{select}"


def activity_cte(grain: str = "visit") -> str:
    uid = ("concat(CAST(e.user_id AS VARCHAR), '-', CAST(CAST(e.ts AS DATE) AS VARCHAR))"
           if grain == "visit" else "CAST(e.user_id AS VARCHAR)")
    return f"""
SELECT e.event_id,
       {uid} AS user_pseudo_id,
       CASE e.event_type WHEN 'view' THEN 'view_item' WHEN 'click' THEN 'add_to_cart'
                         WHEN 'purchase' THEN 'purchase' ELSE 'page_view' END AS event_name,
       concat('page_', CAST(e.k % 10 AS VARCHAR)) AS page_type,
       CASE WHEN e.event_type = 'purchase' THEN e.value END AS purchase_revenue,
       e.ts AS event_ts,
       CASE e.k % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS category,
       r.r_name AS region, n.n_name AS country,
       CASE e.k % 5 WHEN 0 THEN 'google' WHEN 1 THEN 'direct' WHEN 2 THEN 'newsletter' WHEN 3 THEN 'bing' END AS source,
       CASE e.k % 4 WHEN 0 THEN 'organic' WHEN 1 THEN 'cpc' WHEN 2 THEN 'email' END AS medium,
       CASE WHEN c.c_acctbal < 2000 THEN '18-24' WHEN c.c_acctbal < 5000 THEN '25-44' ELSE '45+' END AS Age,
       CASE WHEN e.event_type IN ('view','click','purchase') THEN p.p_type END AS ItemCategory,
       p.p_partkey AS item_id,
       e.k AS k
FROM (SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events) e
JOIN customer c ON c.c_custkey = e.user_id
JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
LEFT JOIN part p ON p.p_partkey = e.k"""


def mode_cte(src: str, key: str, col: str, alias: str, where: str = "") -> str:
    cond = f"{col} IS NOT NULL" + (f" AND {where}" if where else "")
    return f"""SELECT {key}, {alias} FROM (
  SELECT {key}, {col} AS {alias},
         row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {col}) AS _rn
  FROM {src} WHERE {cond} GROUP BY {key}, {col}) WHERE _rn = 1"""


def days_sql(col: str) -> str:
    return (f"coalesce(CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({col})) / 86400000000.0) AS INTEGER), "
            f"{K.DAYS_WHEN_UNKNOWN})")


def users_ctes(src: str = "activity") -> list[tuple[str, str]]:
    """Rollup (A1), context modes (A2), top category (A3), days."""
    ctes = [("u_base", f"""
SELECT user_pseudo_id,
       count(event_name) AS total_events,
       count(DISTINCT page_type) AS unique_pages,
       coalesce(sum(purchase_revenue), 0.0) AS total_revenue,
       count(*) FILTER (WHERE event_name = 'purchase') AS num_purchases,
       count(*) FILTER (WHERE event_name = 'add_to_cart') AS num_cart_adds,
       min(event_ts) AS first_visit
FROM {src} WHERE user_pseudo_id IS NOT NULL GROUP BY user_pseudo_id""")]
    for c in K.CONTEXT_COLS:
        ctes.append((f"u_mode_{c}", mode_cte(src, "user_pseudo_id", c, "v")))
    ctes.append(("u_topcat", mode_cte(src, "user_pseudo_id", "ItemCategory", "v")))
    joins = "\n".join(f"LEFT JOIN u_mode_{c} ON u_mode_{c}.user_pseudo_id = b.user_pseudo_id" for c in K.CONTEXT_COLS)
    cols = ",\n       ".join(f"coalesce(u_mode_{c}.v, 'unknown') AS {c}" for c in K.CONTEXT_COLS)
    ctes.append(("users", f"""
SELECT b.user_pseudo_id, b.total_events, b.unique_pages, b.total_revenue, b.num_purchases, b.num_cart_adds,
       {days_sql('b.first_visit')} AS days_since_first_visit,
       {cols},
       u_topcat.v AS top_category
FROM u_base b
{joins}
LEFT JOIN u_topcat ON u_topcat.user_pseudo_id = b.user_pseudo_id"""))
    return ctes


PERSONA_CASE = f"""CASE WHEN num_purchases > 1 THEN '{K.PERSONA_ORDER[0]}'
            WHEN num_purchases = 1 THEN '{K.PERSONA_ORDER[1]}'
            WHEN num_cart_adds > 0 THEN '{K.PERSONA_ORDER[2]}'
            WHEN total_events >= med THEN '{K.PERSONA_ORDER[3]}'
            ELSE '{K.PERSONA_ORDER[4]}' END"""

PERSONA_INDEX = "CASE persona " + " ".join(
    f"WHEN '{p}' THEN {i}" for i, p in enumerate(K.PERSONA_ORDER)) + " END"

TAGS_SQL = f"""coalesce(nullif(concat_ws(',',
    CASE WHEN total_revenue > {K.HIGH_VALUE_REVENUE} THEN '{K.TAG_HIGH_VALUE}' END,
    CASE WHEN days_since_first_visit < {K.NEW_USER_DAYS} THEN '{K.TAG_NEW_USER}' END,
    CASE WHEN total_events > {K.FREQUENT_EVENTS} THEN '{K.TAG_FREQUENT}' END), ''), '{K.TAG_STANDARD}')"""


def training_ctes(grain: str = "visit") -> list[tuple[str, str]]:
    """Activity + users + personas + dense ids + intent + tags."""
    return [("activity", activity_cte(grain))] + users_ctes() + [
        ("u_med", "SELECT median(CAST(total_events AS DOUBLE)) AS med FROM users"),
        ("u_persona", f"SELECT u.*, m.med AS median_events, {PERSONA_CASE} AS persona FROM users u, u_med m"),
        ("u_present", f"""SELECT persona, CAST(row_number() OVER (ORDER BY idx) - 1 AS INTEGER) AS target_cluster
FROM (SELECT DISTINCT persona, {PERSONA_INDEX} AS idx FROM u_persona)"""),
        ("training", f"""SELECT p.*, s.target_cluster,
       CAST(CASE WHEN total_revenue > 0 OR total_events > {K.HIGH_INTENT_EVENTS} THEN 1 ELSE 0 END AS INTEGER) AS is_high_intent,
       {TAGS_SQL} AS tags
FROM u_persona p JOIN u_present s USING (persona)"""),
    ]


def requests_ctes(recent_max: int = 20) -> list[tuple[str, str]]:
    """The request fixture (one per visit), arrays as DuckDB lists."""
    ua = "[" + ", ".join(q(s) for s in USER_AGENTS) + "]"
    ctx = ["region", "country", "source", "medium", "Age", "category"]
    ctes = [("activity", activity_cte("visit"))]
    ctes.append(("r_base", f"""
SELECT user_pseudo_id,
       CAST(count(event_name) AS INTEGER) AS total_events,
       CAST(count(DISTINCT page_type) AS INTEGER) AS unique_pages,
       round(coalesce(sum(purchase_revenue), 0.0), 2) AS total_revenue,
       min(event_ts) AS first_ts,
       arg_min(k, event_id) AS first_k,
       min(event_id) AS first_event_id
FROM activity WHERE user_pseudo_id IS NOT NULL GROUP BY user_pseudo_id"""))
    for c in ctx:
        ctes.append((f"r_mode_{c}", mode_cte("activity", "user_pseudo_id", c, "v")))
    ctes.append(("r_recent", f"""
SELECT user_pseudo_id,
       list(event_name ORDER BY event_ts, event_id) AS recent_sequence,
       coalesce(list(CAST(item_id AS VARCHAR) ORDER BY event_ts, event_id) FILTER (WHERE ItemCategory IS NOT NULL), []) AS recent_items,
       coalesce(list(ItemCategory ORDER BY event_ts, event_id) FILTER (WHERE ItemCategory IS NOT NULL), []) AS recent_categories
FROM (SELECT *, row_number() OVER (PARTITION BY user_pseudo_id ORDER BY event_ts DESC, event_id DESC) AS _rn
      FROM activity) WHERE _rn <= {recent_max} GROUP BY user_pseudo_id"""))
    joins = "\n".join(f"LEFT JOIN r_mode_{c} ON r_mode_{c}.user_pseudo_id = b.user_pseudo_id" for c in ctx)
    cols = ",\n       ".join(
        f"CASE WHEN b.first_event_id % 7 <> 0 THEN r_mode_{c}.v END AS {c}" for c in ctx)
    ctes.append(("requests", f"""
SELECT b.user_pseudo_id AS request_id, b.user_pseudo_id, b.total_events, b.unique_pages, b.total_revenue,
       CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(b.first_ts)) / 86400000000.0) AS INTEGER) AS days_since_first_visit,
       r.recent_sequence, r.recent_items, r.recent_categories, r.recent_categories AS recent_display_categories,
       {cols},
       {ua}[CAST(b.first_k % 5 AS INTEGER) + 1] AS user_agent
FROM r_base b JOIN r_recent r ON r.user_pseudo_id = b.user_pseudo_id
{joins}"""))
    return ctes


DEVICE_SQL = """CASE WHEN coalesce(user_agent, '') = '' THEN 'unknown'
     WHEN contains(lower(user_agent), 'tablet') OR contains(lower(user_agent), 'ipad') THEN 'tablet'
     WHEN contains(lower(user_agent), 'mobi') OR contains(lower(user_agent), 'android')
          OR contains(lower(user_agent), 'iphone') THEN 'mobile'
     ELSE 'desktop' END"""


def request_defaults_cte() -> tuple[str, str]:
    """S4 + X7: typed defaults, empty -> unknown, device guess."""
    ctx = ["region", "country", "source", "medium", "Age"]
    cols = ",\n       ".join(f"coalesce(nullif({c}, ''), 'unknown') AS {c}" for c in ctx)
    return ("req", f"""
SELECT request_id, user_pseudo_id,
       coalesce(total_events, {K.REQUEST_DEFAULT_EVENTS}) AS total_events,
       coalesce(unique_pages, {K.REQUEST_DEFAULT_PAGES}) AS unique_pages,
       coalesce(total_revenue, {K.REQUEST_DEFAULT_REVENUE}) AS total_revenue,
       coalesce(days_since_first_visit, {K.REQUEST_DEFAULT_DAYS}) AS days_since_first_visit,
       coalesce(recent_sequence, []) AS recent_sequence,
       coalesce(recent_items, []) AS recent_items,
       coalesce(recent_categories, []) AS recent_categories,
       coalesce(recent_display_categories, []) AS recent_display_categories,
       {cols},
       coalesce(nullif(category, ''), {DEVICE_SQL}) AS category
FROM requests""")


def catalog_cte() -> str:
    return """
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS category, p_brand AS subcategory,
       CAST(NULL AS VARCHAR) AS display_category, p_retailprice AS price,
       concat('Part ', p_name) AS description,
       concat('/images/', CAST(p_partkey AS VARCHAR), '.png') AS image_url,
       p_partkey AS catalog_pos
FROM part"""


ALL_POOL_SQL = "chr(1) || 'all'"


def seeded_int_sql(salt_sql: str, key_sql: str, seed: int = K.SEED) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {salt_sql}, {key_sql})), 1, 8)) AS BIGINT)"


def catalog_ctes() -> list[tuple[str, str]]:
    """Catalog, its category list, and the ranked pools."""
    return [
        ("cat", catalog_cte()),
        ("cat_list", "SELECT list(category ORDER BY category) AS cats FROM (SELECT DISTINCT category FROM cat)"),
        ("ranked", f"""
SELECT category AS pool,
       CAST(row_number() OVER (PARTITION BY category ORDER BY md5(concat_ws('|', '{K.SEED}', id)), id) - 1 AS BIGINT) AS pos,
       count(*) OVER (PARTITION BY category) AS m, id FROM cat
UNION ALL
SELECT {ALL_POOL_SQL} AS pool,
       CAST(row_number() OVER (ORDER BY md5(concat_ws('|', '{K.SEED}', id)), id) - 1 AS BIGINT) AS pos,
       count(*) OVER () AS m, id FROM cat"""),
        ("pool_m", "SELECT pool, max(m) AS m FROM ranked GROUP BY pool"),
    ]


def target_sql(src: str, key: str = "request_id") -> str:
    """W2 (base 2) + W4 over ``src`` (needs recent_display_categories, recent_categories)."""
    h_t = seeded_int_sql("'target'", key)
    h_s = seeded_int_sql("'secondary'", key)
    return f"""
SELECT *,
       CASE WHEN k = 0 THEN target_category
            WHEN ti IS NULL THEN cats[CAST({h_s} % k AS INTEGER) + 1]
            WHEN k = 1 THEN target_category
            ELSE cats[CAST((ti + 1 + {h_s} % (k - 1)) % k AS INTEGER) + 1] END AS secondary_category
FROM (
  SELECT *, list_position(cats, target_category) - 1 AS ti
  FROM (
    SELECT *, coalesce(
        list_filter(CASE WHEN len(recent_display_categories) > 0 THEN recent_display_categories
                         ELSE recent_categories END,
                    lambda x: x IS NOT NULL AND x <> '' AND list_contains(cats, x))[-1],
        CASE WHEN k > 0 THEN cats[CAST({h_t} % k AS INTEGER) + 1] ELSE '{K.UNKNOWN_CATEGORY}' END) AS target_category
    FROM (SELECT s.*, cl.cats, len(cl.cats) AS k FROM {src} s, cat_list cl)))"""


def modules_sql(src: str, key: str = "request_id", n: int = K.PRODUCTS_PER_MODULE) -> list[tuple[str, str]]:
    """W6 over ``src`` (needs target_category, secondary_category)."""
    def st(salt, m):
        return f"CASE WHEN {m} > 0 THEN {seeded_int_sql(repr(salt), key)} % {m} ELSE 0 END"

    return [
        ("mp_b", f"""
SELECT s.{key},
       coalesce(pt.pool, {ALL_POOL_SQL}) AS t_pool, coalesce(pt.m, pa.m) AS t_m,
       coalesce(ps.pool, {ALL_POOL_SQL}) AS s_pool, coalesce(ps.m, pa.m) AS s_m
FROM {src} s
LEFT JOIN pool_m pt ON pt.pool = s.target_category
LEFT JOIN pool_m ps ON ps.pool = s.secondary_category
CROSS JOIN (SELECT m FROM pool_m WHERE pool = {ALL_POOL_SQL}) pa"""),
        ("mp_pos", f"""
SELECT {key}, t_pool, s_pool,
       list_transform(range(0, least(t_m, {n})), lambda i: ({st('hero', 't_m')} + i) % t_m) AS hero,
       list_transform(range(0, least(t_m, {n})), lambda i: ({st('primary', 't_m')} + i) % t_m) AS prim,
       list_transform(range(0, least(s_m, {2 * n})), lambda i: ({st('secondary', 's_m')} + i) % s_m) AS sec_all
FROM mp_b"""),
        ("mp_pos2", f"""
SELECT {key}, t_pool, s_pool, hero, prim,
       CASE WHEN t_pool = s_pool THEN list_filter(sec_all, lambda p: NOT list_contains(prim, p)) ELSE sec_all END[1:{n}] AS sec
FROM mp_pos"""),
        ("mp_probe", f"""
SELECT {key}, 'hero' AS module, i, t_pool AS pool, hero[i + 1] AS pos FROM mp_pos2, range(0, len(hero)) t(i)
UNION ALL
SELECT {key}, 'primary', i, t_pool, prim[i + 1] FROM mp_pos2, range(0, len(prim)) t(i)
UNION ALL
SELECT {key}, 'secondary', i, s_pool, sec[i + 1] FROM mp_pos2, range(0, len(sec)) t(i)"""),
        ("mp_out", f"""
SELECT p.{key},
       coalesce(list(r.id ORDER BY p.i) FILTER (WHERE p.module = 'hero'), []) AS hero_products,
       coalesce(list(r.id ORDER BY p.i) FILTER (WHERE p.module = 'primary'), []) AS primary_products,
       coalesce(list(r.id ORDER BY p.i) FILTER (WHERE p.module = 'secondary'), []) AS secondary_products
FROM mp_probe p JOIN ranked r ON r.pool = p.pool AND r.pos = p.pos
GROUP BY p.{key}"""),
    ]


def client_events_ctes() -> list[tuple[str, str]]:
    """Clicks with the catalog lookup (user grain), as ``client_events``."""
    return [("cat", catalog_cte()), ("ce", """
SELECT CAST(e.user_id AS VARCHAR) AS user_pseudo_id, e.ts AS event_ts, e.event_id, 'view_item' AS event_name,
       e.item_ref AS item_name,
       coalesce(coalesce(i.category, n.category), 'UNKNOWN_CATEGORY') AS category,
       CASE WHEN e.k % 5 = 1 THEN '' ELSE coalesce(coalesce(coalesce(nullif(i.display_category, ''), i.category),
                coalesce(nullif(n.display_category, ''), n.category)), 'Unknown') END AS display_category
FROM (SELECT ev.event_id, ev.ts, ev.user_id, ev.k,
             CASE WHEN ev.k % 4 = 0 THEN p.p_name WHEN ev.k % 4 = 3 THEN concat('missing-', CAST(ev.k AS VARCHAR))
                  ELSE CAST(ev.k AS VARCHAR) END AS item_ref
      FROM (SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events
            WHERE event_type IN ('view', 'click', 'purchase')) ev
      LEFT JOIN part p ON p.p_partkey = ev.k) e
LEFT JOIN cat i ON i.id = e.item_ref
LEFT JOIN (SELECT name, arg_min(id, catalog_pos) AS id, arg_min(category, catalog_pos) AS category,
                  arg_min(display_category, catalog_pos) AS display_category FROM cat GROUP BY name) n
  ON n.name = e.item_ref""")]


def recent_signals_ctes(n: int = 20) -> list[tuple[str, str]]:
    return client_events_ctes() + [("ce_last", f"""
SELECT *, row_number() OVER (PARTITION BY user_pseudo_id ORDER BY event_ts DESC, event_id DESC) AS rn
FROM ce"""), ("ce_disp", """
SELECT l.*, CASE WHEN coalesce(l.display_category, '') = '' THEN
         coalesce(coalesce(coalesce(nullif(i.display_category, ''), i.category),
                           coalesce(nullif(n.display_category, ''), n.category)), 'Unknown')
       ELSE l.display_category END AS disp
FROM ce_last l
LEFT JOIN cat i ON i.id = l.item_name
LEFT JOIN (SELECT name, arg_min(id, catalog_pos) AS id, arg_min(category, catalog_pos) AS category,
                  arg_min(display_category, catalog_pos) AS display_category FROM cat GROUP BY name) n
  ON n.name = l.item_name
WHERE l.rn <= """ + str(n)), ("signals", """
SELECT user_pseudo_id, CAST(greatest(1, count(*)) AS INTEGER) AS total_events,
       CAST(greatest(1, count(item_name)) AS INTEGER) AS unique_pages,
       array_to_string(list(event_name ORDER BY event_ts, event_id), ',') AS recent_sequence,
       array_to_string(list(item_name ORDER BY event_ts, event_id), ',') AS recent_items,
       array_to_string(list(category ORDER BY event_ts, event_id), ',') AS recent_categories,
       array_to_string(list(disp ORDER BY event_ts, event_id), ',') AS recent_display_categories
FROM ce_disp GROUP BY user_pseudo_id""")]
