"""Registered queries over the user rollup."""

from __future__ import annotations

from pyspark.sql import functions as F

from tailorspark import constants as K
from tailorspark.functions.columns import array_text, days_since, log_feature
from tailorspark.operators.features import top_category, user_rollup
from tailorspark.operators.segments import (
    assign_personas, dense_segments, persona_distribution, rollup_for_segments, segment_profile, training_frame)
from tailorspark.plans.oracle import activity_cte, training_ctes, users_ctes, with_ctes
from tailorspark.plans.registry import register
from tailorspark.sources.tables import AS_OF, activity


def _users(spark, sf_dir, grain="visit"):
    return user_rollup(activity(spark, sf_dir, grain), AS_OF)


def _sql_users(select: str, grain: str = "visit") -> str:
    return with_ctes([("activity", activity_cte(grain))] + users_ctes(), select)


# -- A1 -----------------------------------------------------------------------
@register("user_features", lambda: _sql_users(
    "SELECT user_pseudo_id, total_events, unique_pages, round(total_revenue, 4) AS total_revenue, "
    "num_purchases, num_cart_adds, days_since_first_visit FROM users"))
def q_user_features(spark, sf_dir):
    return _users(spark, sf_dir).select(
        "user_pseudo_id", "total_events", "unique_pages", F.round("total_revenue", 4).alias("total_revenue"),
        "num_purchases", "num_cart_adds", "days_since_first_visit")


# -- A2 -----------------------------------------------------------------------
@register("user_context", lambda: _sql_users(
    "SELECT user_pseudo_id, " + ", ".join(K.CONTEXT_COLS) + " FROM users"))
def q_user_context(spark, sf_dir):
    return _users(spark, sf_dir).select("user_pseudo_id", *K.CONTEXT_COLS)


# -- A3 + J1 ------------------------------------------------------------------
@register("user_top_category", lambda: _sql_users(
    "SELECT user_pseudo_id, total_events, top_category FROM users"))
def q_user_top_category(spark, sf_dir):
    act = activity(spark, sf_dir, "visit")
    users = user_rollup(act, AS_OF, with_top_category=False)
    return users.join(top_category(act), "user_pseudo_id", "left").select(
        "user_pseudo_id", "total_events", "top_category")


# -- X1 -----------------------------------------------------------------------
@register("days_since_first_visit", lambda: with_ctes(
    [("activity", activity_cte("user"))],
    "SELECT user_pseudo_id, CAST(strftime(min(event_ts), '%Y-%m-%d %H:%M:%S') AS VARCHAR) AS first_visit, "
    "coalesce(CAST(floor((epoch_us(TIMESTAMP '" + AS_OF + "') - epoch_us(min(event_ts))) / 86400000000.0) "
    "AS INTEGER), 365) AS days_since_first_visit FROM activity GROUP BY user_pseudo_id"))
def q_days_since(spark, sf_dir):
    act = activity(spark, sf_dir, "user")
    return act.groupBy("user_pseudo_id").agg(F.min("event_ts").alias("_f")).select(
        "user_pseudo_id", F.date_format("_f", "yyyy-MM-dd HH:mm:ss").alias("first_visit"),
        days_since("_f", AS_OF).alias("days_since_first_visit"))


# -- X2 + A6 ------------------------------------------------------------------
@register("personas", lambda: with_ctes(
    training_ctes(), "SELECT user_pseudo_id, persona, median_events FROM training"))
def q_personas(spark, sf_dir):
    users = rollup_for_segments(activity(spark, sf_dir, "visit"), AS_OF)
    med = users.agg(F.median(F.col("total_events").cast("double"))).scalar()
    return assign_personas(users).select("user_pseudo_id", "persona", med.alias("median_events"))


# -- X3 -----------------------------------------------------------------------
@register("high_intent", lambda: with_ctes(
    training_ctes(), "SELECT user_pseudo_id, is_high_intent FROM training"))
def q_high_intent(spark, sf_dir):
    return training_frame(activity(spark, sf_dir, "visit"), AS_OF).select("user_pseudo_id", "is_high_intent")


# -- X4 -----------------------------------------------------------------------
@register("business_tags", lambda: with_ctes(
    training_ctes(), "SELECT user_pseudo_id, tags FROM training"))
def q_business_tags(spark, sf_dir):
    tf = training_frame(activity(spark, sf_dir, "visit"), AS_OF)
    return tf.select("user_pseudo_id", array_text("tags").alias("tags"))


@register("business_tags_user_grain", lambda: with_ctes(
    training_ctes("user"), "SELECT user_pseudo_id, total_events, round(total_revenue, 4) AS total_revenue, "
    "tags FROM training"))
def q_business_tags_user(spark, sf_dir):
    tf = training_frame(activity(spark, sf_dir, "user"), AS_OF)
    return tf.select("user_pseudo_id", "total_events", F.round("total_revenue", 4).alias("total_revenue"),
                     array_text("tags").alias("tags"))


# -- A7 -----------------------------------------------------------------------
@register("persona_distribution", lambda: with_ctes(
    training_ctes(), "SELECT persona, count(*) AS n_users FROM training GROUP BY persona"))
def q_persona_distribution(spark, sf_dir):
    return persona_distribution(assign_personas(rollup_for_segments(activity(spark, sf_dir, "visit"), AS_OF)))


# -- A15 ----------------------------------------------------------------------
@register("dense_segments", lambda: with_ctes(
    training_ctes(), "SELECT user_pseudo_id, persona, target_cluster FROM training"))
def q_dense_segments(spark, sf_dir):
    users = rollup_for_segments(activity(spark, sf_dir, "visit"), AS_OF)
    return dense_segments(assign_personas(users)).select("user_pseudo_id", "persona", "target_cluster")


# -- A8 -----------------------------------------------------------------------
@register("segment_profile", lambda: with_ctes(
    training_ctes(), "SELECT target_cluster, round(avg(total_revenue), 4) AS avg_revenue, "
    "round(avg(CAST(total_events AS DOUBLE)), 4) AS avg_events FROM training GROUP BY target_cluster"))
def q_segment_profile(spark, sf_dir):
    sp = segment_profile(training_frame(activity(spark, sf_dir, "visit"), AS_OF))
    return sp.select("target_cluster", F.round("avg_revenue", 4).alias("avg_revenue"),
                     F.round("avg_events", 4).alias("avg_events"))


# -- C1 -----------------------------------------------------------------------
TRAINING_COLS = ["user_pseudo_id", "total_events", "unique_pages", "total_revenue", "num_purchases",
                 "num_cart_adds", "days_since_first_visit", *K.CONTEXT_COLS, "persona", "target_cluster",
                 "is_high_intent", "tags"]


@register("training_frame", lambda: with_ctes(training_ctes(), "SELECT " + ", ".join(
    "round(total_revenue, 4) AS total_revenue" if c == "total_revenue" else c for c in TRAINING_COLS)
    + " FROM training"))
def q_training_frame(spark, sf_dir):
    tf = training_frame(activity(spark, sf_dir, "visit"), AS_OF)
    return tf.select(*[
        F.round("total_revenue", 4).alias("total_revenue") if c == "total_revenue"
        else array_text("tags").alias("tags") if c == "tags" else c for c in TRAINING_COLS])


# -- X6 -----------------------------------------------------------------------
@register("log_features", lambda: _sql_users(
    "SELECT user_pseudo_id, round(ln(1 + greatest(CAST(total_events AS DOUBLE), 0.0)), 6) AS log_events, "
    "round(ln(1 + greatest(CAST(unique_pages AS DOUBLE), 0.0)), 6) AS log_pages, "
    "round(ln(1 + greatest(total_revenue, 0.0)), 6) AS log_revenue, days_since_first_visit FROM users"))
def q_log_features(spark, sf_dir):
    u = _users(spark, sf_dir)
    return u.select("user_pseudo_id", F.round(log_feature("total_events"), 6).alias("log_events"),
                    F.round(log_feature("unique_pages"), 6).alias("log_pages"),
                    F.round(log_feature("total_revenue"), 6).alias("log_revenue"), "days_since_first_visit")


# -- S1 -----------------------------------------------------------------------
ACT_COLS = ["event_id", "user_pseudo_id", "event_name", "page_type", "purchase_revenue", "event_time", "category",
            "region", "country", "source", "medium", "Age", "ItemCategory"]


@register("activity_load", lambda: with_ctes([("activity", activity_cte("visit"))], "SELECT " + ", ".join(
    "strftime(event_ts, '%Y-%m-%d %H:%M:%S.%f') AS event_time" if c == "event_time" else c for c in ACT_COLS)
    + " FROM activity"))
def q_activity_load(spark, sf_dir):
    """Activity and transactions written as CSV to the shared folder, then
    loaded back through the file loader."""
    from tailorspark.session import scratch_dir
    from tailorspark.sources.activity import load_activity, split_for_export

    a, t = split_for_export(activity(spark, sf_dir, "visit"))
    base = scratch_dir(spark, "activity")
    a.write.option("header", "true").csv(f"{base}/activity")
    t.write.option("header", "true").csv(f"{base}/transactions")
    loaded = load_activity(spark, f"{base}/activity", f"{base}/transactions")
    return loaded.select(*[F.date_format("event_ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time")
                           if c == "event_time" else c for c in ACT_COLS])
