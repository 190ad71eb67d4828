"""Registered page queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailorspark import constants as K
from tailorspark.functions.columns import array_text, confidence_round, percent_match
from tailorspark.operators.pages import (
    PAGE_FLAT, flatten_document, normalize_responses, page_document, personalize, route, write_pages)
from tailorspark.operators.segments import segment_names, training_frame
from tailorspark.plans.oracle import TAGS_SQL, catalog_ctes, modules_sql, q, target_sql, with_ctes
from tailorspark.plans.q_coldstart import coldstart_parts, default_requests, resolve_ctes
from tailorspark.plans.registry import register
from tailorspark.session import scratch_dir, stored
from tailorspark.sources.tables import AS_OF, activity, catalog, request_extra


def cold_pages_and_names(spark, sf_dir):
    """C2 plan: cold path for every request, stateless (no stored users); and the names of the segments."""
    act, users, table, defaults = coldstart_parts(spark, sf_dir, materialize=True)
    req = stored(default_requests(spark, sf_dir, act, users), "requests")
    names = stored(segment_names(users), "names")  # at most five rows
    return personalize(req, table, defaults, catalog(spark, sf_dir), names=names), names


def cold_pages(spark, sf_dir):
    return cold_pages_and_names(spark, sf_dir)[0]


def flat_pages(df):
    return flatten_document(page_document(df))


# ---------------------------------------------------------------------------
# SQL for the cold page
# ---------------------------------------------------------------------------
def _cta_sql(tags: str, avg: str) -> str:
    lst = f"string_split({tags}, ',')"
    out = {}
    for i, name in enumerate(("type", "title", "button")):
        out[name] = (f"CASE WHEN list_contains({lst}, {q(K.TAG_HIGH_VALUE)}) "
                     f"OR list_contains({lst}, {q(K.TAG_HIGH_VALUE_SEGMENT)}) THEN {q(K.CTA_LOYALTY[i])} "
                     f"WHEN list_contains({lst}, {q(K.TAG_NEW_USER)}) THEN {q(K.CTA_FIRST_PURCHASE[i])} "
                     f"WHEN {avg} < {K.CTA_ENGAGEMENT_BELOW} THEN {q(K.CTA_ENGAGEMENT[i])} "
                     f"ELSE {q(K.CTA_STANDARD[i])} END")
    return out


def page_ctes():
    ctes = resolve_ctes() + catalog_ctes() + [("tgt", target_sql("resolved"))] + modules_sql("tgt")
    ctes.append(("pg0", f"""
SELECT t.*, coalesce(o.hero_products, []) AS hero_products, coalesce(o.primary_products, []) AS primary_products,
       coalesce(o.secondary_products, []) AS secondary_products,
       coalesce(nullif(cs_avg_revenue, 0.0), 0.0) AS page_avg_revenue,
       {TAGS_SQL} AS t1
FROM tgt t LEFT JOIN mp_out o ON o.request_id = t.request_id"""))
    ctes.append(("pg1", f"""
SELECT *, CASE WHEN cs_avg_revenue > {K.HIGH_VALUE_REVENUE} THEN concat(t2, ',{K.TAG_HIGH_VALUE_SEGMENT}') ELSE t2 END AS page_tags
FROM (SELECT *, CASE WHEN list_contains(string_split(t1, ','), '{K.TAG_NEW_USER}') THEN t1
                     ELSE concat(t1, ',{K.TAG_NEW_USER}') END AS t2 FROM pg0)"""))
    cta = _cta_sql("page_tags", "page_avg_revenue")
    ctes.append(("pages", f"""
SELECT p.request_id, 'cold' AS path, CAST(p.cs_cluster AS INTEGER) AS predicted_segment,
       coalesce(n.persona, concat('segment_', CAST(p.cs_cluster AS VARCHAR))) AS segment_name,
       p.cs_source AS prediction_source, CAST({K.COLD_CONFIDENCE} AS DOUBLE) AS confidence,
       starts_with(p.cs_source, 'cold_start') AS is_cold_start,
       p.target_category, p.secondary_category, p.page_tags AS assigned_business_tags,
       concat('Explore Our ', p.target_category, ' Collection') AS hero_title,
       '{K.HERO_SUBTITLE}' AS hero_subtitle, '{K.HERO_CTA}' AS hero_cta,
       array_to_string(p.hero_products, ',') AS hero_products,
       concat_ws('|', CASE WHEN len(p.primary_products) > 0 THEN concat('Top Picks in ', p.target_category) END,
                      CASE WHEN len(p.secondary_products) > 0 THEN concat('Trending in ', p.secondary_category) END)
         AS module_titles,
       concat_ws('|', CASE WHEN len(p.primary_products) > 0 THEN array_to_string(p.primary_products, ',') END,
                      CASE WHEN len(p.secondary_products) > 0 THEN array_to_string(p.secondary_products, ',') END)
         AS module_products,
       {cta['type']} AS cta_type, {cta['title']} AS cta_title, {cta['button']} AS cta_button,
       round(p.page_avg_revenue, 4) AS avg_revenue
FROM pg1 p LEFT JOIN u_present n ON n.target_cluster = p.cs_cluster"""))
    return ctes


PAGE_SQL_COLS = ", ".join(PAGE_FLAT)


# -- C2 -----------------------------------------------------------------------
@register("personalize_cold", lambda: with_ctes(page_ctes(), f"SELECT {PAGE_SQL_COLS} FROM pages"))
def q_personalize_cold(spark, sf_dir):
    return flat_pages(cold_pages(spark, sf_dir)).select(*PAGE_FLAT)


# -- S5 -----------------------------------------------------------------------
@register("page_document", lambda: with_ctes(page_ctes(), f"SELECT {PAGE_SQL_COLS} FROM pages"))
def q_page_document(spark, sf_dir):
    """Nested documents written as JSON to the shared folder and read back."""
    doc = page_document(cold_pages(spark, sf_dir))
    path = scratch_dir(spark, "pages")
    write_pages(doc, path, "json")
    back = spark.read.schema(doc.schema).json(path)
    return flatten_document(back).select(*PAGE_FLAT)


# -- S6 -----------------------------------------------------------------------
def _response_logs(spark, sf_dir):
    """Logged responses: as sent, wrapped one level deeper, or hero-only."""
    doc = page_document(cold_pages(spark, sf_dir))
    bucket = F.conv(F.substring(F.md5(F.col("request_id")), 1, 2), 16, 10).cast("int") % 3
    plain = F.to_json(F.struct("hero_section", "product_modules", "cta_modules", "personalization_details"))
    wrapped = F.to_json(F.struct(F.struct(F.col("hero_section").alias("hero_section"), "product_modules",
                                          "personalization_details").alias("hero_section")))
    hero_only = F.to_json(F.struct("hero_section"))
    return doc.select("request_id", F.when(bucket == 0, plain).when(bucket == 1, wrapped).otherwise(hero_only)
                      .alias("response"))


@register("response_normalize", lambda: with_ctes(page_ctes(), f"""
SELECT request_id,
       hero_title,
       CASE WHEN b = 2 THEN '' ELSE module_titles END AS module_titles,
       CASE WHEN b = 2 THEN 0 ELSE predicted_segment END AS predicted_segment,
       CASE WHEN b = 2 THEN 'fallback_mode' ELSE assigned_business_tags END AS assigned_business_tags,
       CASE WHEN b = 2 THEN NULL ELSE prediction_source END AS prediction_source
FROM (SELECT *, CAST(('0x' || substr(md5(request_id), 1, 2)) AS INTEGER) % 3 AS b FROM pages)"""))
def q_response_normalize(spark, sf_dir):
    n = normalize_responses(_response_logs(spark, sf_dir))
    d = F.col("personalization_details")
    return n.select(
        "request_id", F.col("hero_section.title").alias("hero_title"),
        F.array_join(F.transform("product_modules", lambda m: m["title"]), "|").alias("module_titles"),
        d["predicted_segment"].alias("predicted_segment"),
        F.array_join(d["assigned_business_tags"], ",").alias("assigned_business_tags"),
        d["prediction_source"].alias("prediction_source"))


# -- X9 + X8 + J5 -------------------------------------------------------------
@register("route_requests", lambda: with_ctes(resolve_ctes(), """
SELECT r.request_id,
       CASE WHEN (CASE WHEN len(r.recent_sequence) > 0 THEN len(r.recent_sequence) ELSE r.total_events END) >= 3
            THEN 'live' ELSE 'cold' END AS path_stateless,
       CASE WHEN u.user_pseudo_id IS NOT NULL AND u.total_events >= 3 THEN 'stored'
            WHEN (CASE WHEN len(r.recent_sequence) > 0 THEN len(r.recent_sequence) ELSE r.total_events END) >= 3
            THEN 'live' ELSE 'cold' END AS path_stored,
       CAST(CASE WHEN u.user_pseudo_id IS NOT NULL AND u.total_events >= 3 THEN u.total_events
                 ELSE r.total_events END AS BIGINT) AS routed_events,
       'cold' AS path_no_models
FROM req r LEFT JOIN training u ON u.user_pseudo_id = r.user_pseudo_id"""))
def q_route_requests(spark, sf_dir):
    act = stored(activity(spark, sf_dir, "visit"), "activity")
    users = training_frame(act, AS_OF, extra=request_extra())
    req = default_requests(spark, sf_dir, act, users).withColumn("total_events", F.col("total_events").cast("long"))
    # one pass over the requests: the stored route comes last, it replaces their numerics
    out = route(req, True).withColumnRenamed("path", "path_stateless")
    out = route(out, False).withColumnRenamed("path", "path_no_models")
    out = route(out, True, users).withColumnRenamed("path", "path_stored")
    return out.select("request_id", "path_stateless", "path_stored", F.col("total_events").alias("routed_events"),
                      "path_no_models")


# -- X14 + X15 + X16 ----------------------------------------------------------
@register("telemetry", lambda: with_ctes(page_ctes(), """
SELECT request_id, predicted_segment, segment_name, round(confidence, 4) AS confidence,
       CAST(floor(confidence * 100 + 0.5) AS INTEGER) AS percent_match, prediction_source, target_category,
       is_cold_start, replace(assigned_business_tags, ',', ', ') AS tags_text FROM pages"""))
def q_telemetry(spark, sf_dir):
    p = cold_pages(spark, sf_dir)
    return p.select("request_id", F.col("cluster").alias("predicted_segment"), "segment_name",
                    confidence_round("confidence").alias("confidence"),
                    percent_match("confidence").alias("percent_match"), "prediction_source", "target_category",
                    F.col("prediction_source").startswith("cold_start").alias("is_cold_start"),
                    F.array_join("tags", ", ").alias("tags_text"))


@register("segment_name", lambda: with_ctes(page_ctes(), """
SELECT p.request_id, p.segment_name,
       coalesce(n.persona, concat('segment_', CAST(p.predicted_segment + 3 AS VARCHAR))) AS shifted_name
FROM pages p LEFT JOIN u_present n ON n.target_cluster = p.predicted_segment + 3"""))
def q_segment_name(spark, sf_dir):
    """X14, including ids with no name (cluster + 3 may be unknown)."""
    from tailorspark.functions.columns import segment_name as seg_name

    # the names of the pages' own training frame: the events are read and rolled up once
    pages, names = cold_pages_and_names(spark, sf_dir)
    names = F.broadcast(names.select(F.col("target_cluster").alias("_c"), F.col("segment_name").alias("_n")))
    p = pages.select("request_id", "segment_name", (F.col("cluster") + 3).alias("_s"))
    p = p.join(names, p["_s"] == names["_c"], "left")
    return p.select("request_id", "segment_name", seg_name("_n", "_s").alias("shifted_name"))


# -- X10 + X11 ----------------------------------------------------------------
@register("cta_modules", lambda: with_ctes(page_ctes(), """
SELECT request_id, avg_revenue, assigned_business_tags, cta_type, cta_title, cta_button FROM pages"""))
def q_cta_modules(spark, sf_dir):
    p = cold_pages(spark, sf_dir)
    return p.select("request_id", F.round("avg_revenue", 4).alias("avg_revenue"),
                    array_text("tags").alias("assigned_business_tags"), F.col("cta.type").alias("cta_type"),
                    F.col("cta.title").alias("cta_title"), F.col("cta.button_text").alias("cta_button"))


# -- X12 ----------------------------------------------------------------------
@register("hero_section", lambda: with_ctes(page_ctes(), """
SELECT request_id, hero_title, hero_subtitle, hero_cta, hero_products FROM pages"""))
def q_hero_section(spark, sf_dir):
    p = cold_pages(spark, sf_dir)
    return p.select("request_id", F.col("hero.title").alias("hero_title"), F.col("hero.subtitle").alias("hero_subtitle"),
                    F.col("hero.cta").alias("hero_cta"), array_text("hero_products").alias("hero_products"))
