"""Registered catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailorspark import constants as K
from tailorspark.functions.columns import array_text, categories_for_target
from tailorspark.operators.catalog import (
    category_counts, category_dim, dedupe_catalog, hydrate_products, lookup_items, module_picks, product_picks,
    products_by_category, rank_catalog, recency_winner, secondary_category, target_category)
from tailorspark.plans.oracle import (
    catalog_ctes, modules_sql, request_defaults_cte, requests_ctes, seeded_int_sql, target_sql, with_ctes)
from tailorspark.plans.q_coldstart import default_requests
from tailorspark.plans.registry import register
from tailorspark.session import scratch_dir, stored
from tailorspark.sources.catalog import load_catalog
from tailorspark.sources.tables import catalog, read_table


def _req_sql_ctes():
    return requests_ctes() + [request_defaults_cte()] + catalog_ctes()


def with_targets(spark, sf_dir):
    """Requests with defaults + target and secondary category; also returns the catalog parts."""
    cat = catalog(spark, sf_dir)
    cats = category_dim(category_counts(cat))
    req = stored(default_requests(spark, sf_dir), "requests")
    req = req.withColumn("_for_target", categories_for_target("recent_display_categories", "recent_categories"))
    req = target_category(req, cats, "_for_target").drop("_for_target")
    req = secondary_category(req, cats)
    return req, cat, cats


# -- S2 -----------------------------------------------------------------------
@register("catalog_load", lambda: with_ctes(catalog_ctes()[:1], """
SELECT coalesce(category, 'Unknown') AS category, count(*) AS n_items, min(price) AS min_price,
       max(price) AS max_price FROM cat GROUP BY 1"""))
def q_catalog_load(spark, sf_dir):
    items = dedupe_catalog(catalog(spark, sf_dir))
    return items.groupBy("category").agg(F.count(F.lit(1)).alias("n_items"), F.min("price").alias("min_price"),
                                         F.max("price").alias("max_price"))


@register("catalog_file", lambda: with_ctes(catalog_ctes()[:1], """
SELECT id, name, CASE WHEN catalog_pos % 5 = 0 THEN 'Unknown' ELSE category END AS category, price FROM cat"""))
def q_catalog_file(spark, sf_dir):
    """The catalog written as JSON, every fifth item without a category, and loaded again."""
    cat = catalog(spark, sf_dir)
    path = f"{scratch_dir(spark, 'catalog')}/json"
    cat.withColumn("category", F.when(F.col("catalog_pos") % 5 != 0, F.col("category"))).drop("catalog_pos").write.json(path)
    return load_catalog(spark, path).select("id", "name", "category", "price")


# -- J2 + X17 -----------------------------------------------------------------
LOOKUP_SQL = """
SELECT e.event_id, e.item_ref, coalesce(i.id, n.id) AS item_id,
       coalesce(i.category, n.category) AS item_category,
       coalesce(coalesce(nullif(i.display_category, ''), i.category),
                coalesce(nullif(n.display_category, ''), n.category)) AS item_display_category
FROM (SELECT ev.event_id,
             CASE WHEN ev.k % 4 = 0 THEN p.p_name WHEN ev.k % 4 = 3 THEN concat('missing-', CAST(ev.k AS VARCHAR))
                  ELSE CAST(ev.k AS VARCHAR) END AS item_ref
      FROM (SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events
            WHERE event_type IN ('view', 'click', 'purchase')) ev
      LEFT JOIN part p ON p.p_partkey = ev.k) e
LEFT JOIN cat i ON i.id = e.item_ref
LEFT JOIN (SELECT name, arg_min(id, catalog_pos) AS id, arg_min(category, catalog_pos) AS category,
                  arg_min(display_category, catalog_pos) AS display_category FROM cat GROUP BY name) n
  ON n.name = e.item_ref"""


@register("catalog_lookup", lambda: with_ctes(catalog_ctes()[:1], LOOKUP_SQL))
def q_catalog_lookup(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "event_id", "event_type", "props").where(
        F.col("event_type").isin("view", "click", "purchase"))
    ev = ev.withColumn("k", F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT)"))
    names = read_table(spark, sf_dir, "part", "p_partkey", "p_name")
    ev = ev.join(names, names.p_partkey == ev.k.cast("long"), "left")
    ref = (F.when(F.col("k") % 4 == 0, F.col("p_name"))
           .when(F.col("k") % 4 == 3, F.concat(F.lit("missing-"), F.col("k").cast("string")))
           .otherwise(F.col("k").cast("string")))
    refs = ev.select("event_id", ref.alias("item_ref"))
    return lookup_items(refs, catalog(spark, sf_dir), "item_ref")


# -- X18 ----------------------------------------------------------------------
@register("products_by_category", lambda: with_ctes(catalog_ctes()[:1], """
SELECT id, name, category FROM cat
WHERE category IN (SELECT p.p_type FROM events e JOIN part p
                   ON p.p_partkey = TRY_CAST(regexp_extract(e.props, '([0-9]+)', 1) AS INTEGER)
                   WHERE e.event_type = 'purchase')"""))
def q_products_by_category(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", "event_type", "props").where(F.col("event_type") == "purchase")
    ev = ev.withColumn("k", F.expr("try_cast(regexp_extract(props, '([0-9]+)', 1) AS INT)"))
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_type")
    cats = ev.join(part, part.p_partkey == ev.k.cast("long")).select(F.col("p_type").alias("category"))
    return products_by_category(catalog(spark, sf_dir), cats).select("id", "name", "category")


# -- W2 / W4 ------------------------------------------------------------------
TARGET_OUT = ("SELECT request_id, array_to_string(recent_display_categories, ',') AS recent_display_categories, "
              "target_category, secondary_category FROM tgt")


@register("target_category", lambda: with_ctes(_req_sql_ctes() + [("tgt", target_sql("req"))], TARGET_OUT))
def q_target_category(spark, sf_dir):
    req, _, _ = with_targets(spark, sf_dir)
    return req.select("request_id", array_text("recent_display_categories").alias("recent_display_categories"),
                      "target_category", "secondary_category")


@register("secondary_category", lambda: with_ctes(
    _req_sql_ctes() + [("tgt", target_sql("req"))],
    "SELECT request_id, target_category, secondary_category, "
    "CAST(target_category <> secondary_category AS BOOLEAN) AS differs FROM tgt"))
def q_secondary_category(spark, sf_dir):
    req, _, _ = with_targets(spark, sf_dir)
    return req.select("request_id", "target_category", "secondary_category",
                      (F.col("target_category") != F.col("secondary_category")).alias("differs"))


RECENCY_BASE_GENERAL = 1.5


def _recency_sql():
    b = RECENCY_BASE_GENERAL
    return with_ctes(_req_sql_ctes() + [
        ("rv", """SELECT r.request_id, list_filter(r.recent_display_categories,
                      lambda x: x IS NOT NULL AND x <> '' AND list_contains(cl.cats, x)) AS v
                 FROM req r, cat_list cl"""),
        ("rs", f"SELECT request_id, v[greatest(len(v) - {K.RECENCY_WINDOW - 1}, 1):] AS recent FROM rv"),
        ("rx", "SELECT request_id, recent[i] AS c, i - 1 AS p FROM rs, range(1, len(recent) + 1) t(i)"),
        ("rsc", f"SELECT request_id, c, sum(pow({b}, p)) AS score, min(p) AS first_p FROM rx GROUP BY 1, 2"),
        ("rb", """SELECT request_id, c AS best, score FROM (SELECT *, row_number() OVER (PARTITION BY request_id
                 ORDER BY score DESC, first_p) AS rn FROM rsc) WHERE rn = 1"""),
    ], "SELECT r.request_id, rb.best AS recency_category, round(rb.score, 6) AS best_score "
       "FROM req r LEFT JOIN rb ON rb.request_id = r.request_id")


@register("recency_scores", _recency_sql)
def q_recency_scores(spark, sf_dir):
    """W2 with a general base (1.5): scores are summed, ties go to the first seen."""
    req = default_requests(spark, sf_dir)
    cats = category_counts(catalog(spark, sf_dir))
    out = recency_winner(req, cats, "recent_display_categories", base=RECENCY_BASE_GENERAL)
    return out.select("request_id", F.col("recency.category").alias("recency_category"),
                      F.round("recency.score", 6).alias("best_score"))


# -- W3 + J8 ------------------------------------------------------------------
def _picks_sql():
    n = K.PRODUCTS_PER_MODULE
    h = seeded_int_sql("'picks'", "request_id")
    return with_ctes(_req_sql_ctes() + [("tgt", target_sql("req")), ("pk_b", f"""
SELECT t.request_id, t.recent_items AS ex, coalesce(pm.pool, chr(1) || 'all') AS pool,
       coalesce(pm.m, pa.m) AS m
FROM tgt t LEFT JOIN pool_m pm ON pm.pool = t.target_category
CROSS JOIN (SELECT m FROM pool_m WHERE pool = chr(1) || 'all') pa"""), ("pk_pos", f"""
SELECT request_id, ex, pool,
       list_transform(range(0, least(m, {n} + len(ex))), lambda i: ((CASE WHEN m > 0 THEN {h} % m ELSE 0 END) + i) % m) AS ps
FROM pk_b"""), ("pk_hit", """
SELECT p.request_id, t.i, r.id FROM pk_pos p, range(0, len(p.ps)) t(i)
JOIN ranked r ON r.pool = p.pool AND r.pos = p.ps[t.i + 1]
WHERE NOT list_contains(p.ex, r.id)"""), ("pk_out", f"""
SELECT request_id, list(id ORDER BY i)[1:{n}] AS products FROM pk_hit GROUP BY request_id""")],
        "SELECT t.request_id, t.target_category, array_to_string(t.recent_items, ',') AS excluded, "
        "array_to_string(coalesce(o.products, []), ',') AS products "
        "FROM tgt t LEFT JOIN pk_out o ON o.request_id = t.request_id")


@register("product_picks", _picks_sql)
def q_product_picks(spark, sf_dir):
    req, cat, cats = with_targets(spark, sf_dir)
    ranked = rank_catalog(cat)
    out = product_picks(req, ranked, "target_category", K.PRODUCTS_PER_MODULE, "picks", "recent_items",
                        counts=cats)
    return out.select("request_id", "target_category", array_text("recent_items").alias("excluded"),
                      array_text("products").alias("products"))


# -- W6 -----------------------------------------------------------------------
MODULES_OUT = ("SELECT t.request_id, t.target_category, t.secondary_category, "
               "array_to_string(coalesce(o.hero_products, []), ',') AS hero_products, "
               "array_to_string(coalesce(o.primary_products, []), ',') AS primary_products, "
               "array_to_string(coalesce(o.secondary_products, []), ',') AS secondary_products "
               "FROM tgt t LEFT JOIN mp_out o ON o.request_id = t.request_id")


@register("product_modules", lambda: with_ctes(
    _req_sql_ctes() + [("tgt", target_sql("req"))] + modules_sql("tgt"), MODULES_OUT))
def q_product_modules(spark, sf_dir):
    req, cat, cats = with_targets(spark, sf_dir)
    out = module_picks(req, rank_catalog(cat), counts=cats)
    return out.select("request_id", "target_category", "secondary_category",
                      *[array_text(c).alias(c) for c in ("hero_products", "primary_products", "secondary_products")])


# -- J3 -----------------------------------------------------------------------
@register("hydrate_products", lambda: with_ctes(_req_sql_ctes() + [("hx", """
SELECT r.request_id, t.i, r.recent_items[t.i + 1] AS id FROM req r, range(0, len(r.recent_items)) t(i)"""), ("hy", """
SELECT hx.request_id, list(c.id ORDER BY hx.i) AS ids, list(c.name ORDER BY hx.i) AS names
FROM hx JOIN cat c ON c.id = hx.id GROUP BY hx.request_id""")], """
SELECT r.request_id, array_to_string(hy.ids[1:4], ',') AS hero_ids, array_to_string(hy.names[1:4], '|') AS hero_names,
       CAST(coalesce(len(hy.ids), 0) AS INTEGER) AS n_found
FROM req r LEFT JOIN hy ON hy.request_id = r.request_id"""))
def q_hydrate_products(spark, sf_dir):
    req = default_requests(spark, sf_dir)
    cat = catalog(spark, sf_dir)
    full = hydrate_products(req, cat, "recent_items", out_col="all_items")
    return full.select(
        "request_id",
        array_text(F.slice(F.transform("all_items", lambda s: s["id"]), 1, 4)).alias("hero_ids"),
        array_text(F.slice(F.transform("all_items", lambda s: s["name"]), 1, 4), "|").alias("hero_names"),
        F.coalesce(F.size("all_items"), F.lit(0)).cast("int").alias("n_found"))
