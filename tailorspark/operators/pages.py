"""Page assembly: routing, segment profile, CTA, hero, modules, documents.

(X8-X12, X14-X16, W6 composition, S5, S6, C2, C3.)  Every step is a column
expression or a broadcast join against a small, bounded table; requests are
never shuffled except for the one regroup that collects module picks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailorspark import constants as K
from tailorspark.functions.columns import (
    avg_revenue_fallback, business_tags, categories_for_target, coldstart_tags, confidence_round, cta_module,
    hero_copy, segment_name, signal_strength)
from tailorspark.operators.catalog import (
    category_counts, category_dim, module_picks, rank_catalog, secondary_category, target_category)
from tailorspark.operators.coldstart import resolve_cold_start
from tailorspark.session import stored
from tailorspark.sources.visitors import asked_visitors


STORED = (*K.NUMERIC_FEATURE_COLS, *K.CONTEXT_COLS)


def route(df: DataFrame, models_ready: bool, users: DataFrame | None = None, key: str = "request_id") -> DataFrame:
    """X9 (+ J5, X8): 'stored', 'live' or 'cold' per request.

    stored: the id is in the user table with >= 3 events and models exist;
    live: signal strength >= 3 and models exist; otherwise cold.  On the stored
    path the stored row's numerics and context replace the request's; a context
    value that the table lacks is 'unknown'.

    ``users`` (one row per visitor; bucketed, as ``load_visitors`` gives it, it is
    not shuffled) is first reduced to the visitors asked for.  Requests without an
    id join under a key of their own, so they do not meet in one task; many
    requests of one visitor are split by the adaptive skew join.
    """
    strength = signal_strength("recent_sequence", "total_events")
    live = F.when((strength >= K.MIN_EVENTS_FOR_BEHAVIORAL) & F.lit(models_ready), "live").otherwise("cold")
    if users is None:
        return df.withColumn("path", live)
    hits = asked_visitors(users, df).where(F.col("total_events") >= K.MIN_EVENTS_FOR_BEHAVIORAL).select(
        F.col("user_pseudo_id").alias("_su"),
        *[F.col(c).alias(f"_s_{c}") if c in users.columns else F.lit(K.UNKNOWN).alias(f"_s_{c}") for c in STORED])
    asking = F.coalesce(F.col("user_pseudo_id"), F.concat(F.lit("\u0000"), F.col(key).cast("string")))
    out = df.withColumn("_asking", asking).join(hits, F.col("_asking") == F.col("_su"), "left")
    is_stored = F.col("_su").isNotNull() & F.lit(models_ready)
    out = out.withColumn("path", F.when(is_stored, "stored").otherwise(live))
    for c in STORED:
        dtype = df.schema[c].dataType
        out = out.withColumn(c, F.when(is_stored, F.coalesce(F.col(f"_s_{c}").cast(dtype), F.lit(K.UNKNOWN).cast(dtype))
                                       if c in K.CONTEXT_COLS else F.col(f"_s_{c}").cast(dtype)).otherwise(F.col(c)))
    return out.drop("_asking", "_su", *[f"_s_{c}" for c in STORED])


def segment_profiles(users: DataFrame | None, spark) -> DataFrame:
    """A8 as a lookup (cluster -> avg revenue); empty when stateless."""
    if users is None:
        return spark.createDataFrame([], "seg_cluster int, seg_avg_revenue double")
    return users.groupBy(F.col("target_cluster").cast("int").alias("seg_cluster")).agg(
        F.avg("total_revenue").alias("seg_avg_revenue"))


def personalize(requests: DataFrame, cold_table: DataFrame, defaults: DataFrame, catalog: DataFrame,
                names: DataFrame | None = None, users: DataFrame | None = None,
                predictions: DataFrame | None = None, key: str = "request_id",
                seed: int = K.SEED, ranked: DataFrame | None = None,
                index: DataFrame | None = None) -> DataFrame:
    """One page per request (flat columns; see ``page_document``).

    ``requests`` must already carry typed defaults; routed ones (with ``path``) are
    taken as they are.  ``predictions`` (optional)
    holds the cascade output per request (``key``, ``m_cluster``,
    ``m_confidence``, ``m_source``); without it no model is ready and every
    request takes the cold path.  ``names`` maps cluster -> segment name.
    ``ranked`` (the catalog numbered by ``rank_catalog``) and ``index`` (the cold-start
    table as ``lookup_index`` stores it) can be computed once and passed in, e.g. by a stream.
    Give a stored table of requests, unique by ``key``: it is read twice.
    """
    spark = requests.sparkSession
    models_ready = predictions is not None
    # catalog side first: the choices of every request, stored (each step reads them twice)
    cats = category_dim(category_counts(catalog))
    if ranked is None:
        ranked = rank_catalog(catalog, seed)
    choice = requests.select(key, categories_for_target("recent_display_categories", "recent_categories").alias("_ft"))
    choice = target_category(choice, cats, "_ft", key=key, seed=seed).drop("_ft")
    choice = stored(secondary_category(choice, cats, key=key, seed=seed), "choice")
    df = requests.join(stored(module_picks(choice, ranked, key=key, seed=seed, counts=cats), "picks"), key, "left")
    # segment side: routing, cold-start resolution, model output
    if "path" not in requests.columns:
        df = route(df, models_ready, users, key)
    df = resolve_cold_start(df, cold_table, defaults, key=key, index=index)
    if models_ready:
        df = df.join(predictions, key, "left")
        # a failed live prediction (no row) falls back to the cold path
        df = df.withColumn("path", F.when((F.col("path") == "live") & F.col("m_cluster").isNull(), "cold")
                           .otherwise(F.col("path")))
    else:
        df = df.withColumns({"m_cluster": F.lit(None).cast("int"), "m_confidence": F.lit(None).cast("double"),
                             "m_source": F.lit(None).cast("string")})
    cold = F.col("path") == "cold"
    tags = business_tags("total_revenue", "days_since_first_visit", "total_events")
    df = df.withColumns({
        "tags": F.when(cold, coldstart_tags(tags, F.col("resolved")["avg_revenue"])).otherwise(tags),
        "cluster": F.when(cold, F.col("resolved")["cluster"]).otherwise(F.col("m_cluster")).cast("int"),
        "prediction_source": F.when(cold, F.col("resolved")["source"]).otherwise(F.col("m_source")),
        "confidence": F.when(cold, F.lit(K.COLD_CONFIDENCE)).otherwise(F.col("m_confidence")),
    })
    fallback = (F.when(cold, F.col("resolved")["avg_revenue"])
                .when(F.col("path") == "live", F.col("total_revenue")).otherwise(F.lit(None)))
    prof = F.broadcast(segment_profiles(users, spark))  # at most one row per segment
    df = df.join(prof, df["cluster"] == prof["seg_cluster"], "left").drop("seg_cluster")
    if names is None:
        names = spark.createDataFrame(list(enumerate(K.PERSONA_ORDER)), "target_cluster int, segment_name string")
    nm = F.broadcast(names.select(F.col("target_cluster").alias("_nc"), F.col("segment_name").alias("_nn")))
    df = df.join(nm, df["cluster"] == nm["_nc"], "left")
    avg = avg_revenue_fallback(F.coalesce("seg_avg_revenue", F.lit(0.0)), fallback)
    df = df.withColumns({"segment_name": segment_name("_nn", "cluster"), "avg_revenue": avg}).drop("_nc", "_nn")
    return df.withColumns({"hero": hero_copy("target_category"), "cta": cta_module("tags", "avg_revenue")})


PAGE_FLAT = ["request_id", "path", "predicted_segment", "segment_name", "prediction_source", "confidence",
             "is_cold_start", "target_category", "secondary_category", "assigned_business_tags", "hero_title",
             "hero_products", "module_titles", "module_products", "cta_type", "cta_title", "avg_revenue"]


def page_document(df: DataFrame, key: str = "request_id") -> DataFrame:
    """The nested response document per request (empty modules omitted)."""
    mod = T.StructType([T.StructField("title", T.StringType()), T.StructField("products", T.ArrayType(T.StringType()))])
    modules = F.filter(F.array(
        F.struct(F.format_string(K.MODULE_PRIMARY_FORMAT, "target_category").alias("title"),
                 F.col("primary_products").alias("products")),
        F.struct(F.format_string(K.MODULE_SECONDARY_FORMAT, "secondary_category").alias("title"),
                 F.col("secondary_products").alias("products")),
    ).cast(T.ArrayType(mod)), lambda m: F.size(m["products"]) > 0)
    return df.select(
        key, "path",
        F.struct(F.col("hero.title").alias("title"), F.col("hero.subtitle").alias("subtitle"),
                 F.col("hero.cta").alias("cta"), F.col("hero_products").alias("targeted_products")).alias("hero_section"),
        modules.alias("product_modules"),
        F.array(F.col("cta")).alias("cta_modules"),
        F.struct(
            F.col("cluster").alias("predicted_segment"), F.col("segment_name").alias("segment_name"),
            F.col("tags").alias("assigned_business_tags"), F.col("prediction_source").alias("prediction_source"),
            confidence_round("confidence").alias("confidence"),
            F.col("prediction_source").startswith("cold_start").alias("is_cold_start"),
            F.col("target_category").alias("target_category")).alias("personalization_details"),
        F.round("avg_revenue", 4).alias("avg_revenue"),
        "secondary_category",
    )


def flatten_document(doc: DataFrame, key: str = "request_id") -> DataFrame:
    """Nested document -> comparable flat columns (arrays joined)."""
    d = F.col("personalization_details")
    return doc.select(
        key, "path",
        d["predicted_segment"].alias("predicted_segment"), d["segment_name"].alias("segment_name"),
        d["prediction_source"].alias("prediction_source"), d["confidence"].alias("confidence"),
        d["is_cold_start"].alias("is_cold_start"), d["target_category"].alias("target_category"),
        "secondary_category",
        F.array_join(d["assigned_business_tags"], ",").alias("assigned_business_tags"),
        F.col("hero_section.title").alias("hero_title"),
        F.array_join("hero_section.targeted_products", ",").alias("hero_products"),
        F.array_join(F.transform("product_modules", lambda m: m["title"]), "|").alias("module_titles"),
        F.array_join(F.transform("product_modules", lambda m: F.array_join(m["products"], ",")), "|")
        .alias("module_products"),
        F.col("cta_modules")[0]["type"].alias("cta_type"), F.col("cta_modules")[0]["title"].alias("cta_title"),
        "avg_revenue",
    )


def write_pages(doc: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """S5 sink: one nested record per request."""
    w = doc.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)


# -- S6 ------------------------------------------------------------------------
HERO_T = T.StructType([T.StructField("title", T.StringType()), T.StructField("subtitle", T.StringType()),
                       T.StructField("cta", T.StringType()),
                       T.StructField("targeted_products", T.ArrayType(T.StringType()))])


def normalize_responses(logs: DataFrame, json_col: str = "response", key: str = "request_id",
                        default_hero: tuple[str, str, str] = K.DEFAULT_HERO) -> DataFrame:
    """Accept a response whose content may be nested one level too deep.

    hero = raw.hero_section.hero_section ?? raw.hero_section ?? default;
    modules = raw.product_modules if an array, else the nested one, else [];
    details = raw ?? nested ?? {predicted_segment 0, ['fallback_mode']};
    cta_modules are dropped.  Parsed through VARIANT so that "is an array"
    and "is an object" are checked on the actual JSON types.
    """
    v = F.try_parse_json(F.col(json_col))

    def obj(x):
        return F.when(F.schema_of_variant(x).startswith("OBJECT"), x)

    def arr(x):
        return F.when(F.schema_of_variant(x).startswith("ARRAY"), x)

    raw_hero = obj(F.try_variant_get(v, "$.hero_section", "variant"))
    nested_hero = obj(F.try_variant_get(raw_hero, "$.hero_section", "variant"))
    hero_v = F.coalesce(nested_hero, raw_hero)
    mods_v = F.coalesce(arr(F.try_variant_get(v, "$.product_modules", "variant")),
                        arr(F.try_variant_get(raw_hero, "$.product_modules", "variant")))
    det_v = F.coalesce(obj(F.try_variant_get(v, "$.personalization_details", "variant")),
                       obj(F.try_variant_get(raw_hero, "$.personalization_details", "variant")))
    mod_t = "array<struct<title:string,products:array<string>>>"
    fallback = F.struct(*[F.lit(x).alias(n) for x, n in zip(default_hero, ("title", "subtitle", "cta"))],
                        F.lit(None).cast("array<string>").alias("targeted_products"))
    return logs.select(
        key,
        F.coalesce(F.try_variant_get(hero_v, "$", HERO_T.simpleString()), fallback).alias("hero_section"),
        F.coalesce(F.try_variant_get(mods_v, "$", mod_t), F.array().cast(mod_t)).alias("product_modules"),
        F.when(det_v.isNull(), F.struct(F.lit(0).alias("predicted_segment"),
                                        F.array(*[F.lit(t) for t in K.DEFAULT_DETAILS_TAGS]).alias(
                                            "assigned_business_tags"),
                                        F.lit(None).cast("string").alias("segment_name"),
                                        F.lit(None).cast("string").alias("prediction_source"),
                                        F.lit(None).cast("double").alias("confidence")))
        .otherwise(F.struct(
            F.try_variant_get(det_v, "$.predicted_segment", "int").alias("predicted_segment"),
            F.try_variant_get(det_v, "$.assigned_business_tags", "array<string>").alias("assigned_business_tags"),
            F.try_variant_get(det_v, "$.segment_name", "string").alias("segment_name"),
            F.try_variant_get(det_v, "$.prediction_source", "string").alias("prediction_source"),
            F.try_variant_get(det_v, "$.confidence", "double").alias("confidence"))).alias("personalization_details"),
    )
