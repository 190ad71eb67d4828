"""Personas, dense segment ids, tags, distribution and segment profile.

(A6, X2, X3, X4, A7, A8, A15; C1 is ``training_frame``.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailorspark import constants as K
from tailorspark.functions.columns import business_tags, high_intent, persona
from tailorspark.operators.features import user_rollup
from tailorspark.session import stored


def assign_personas(users: DataFrame) -> DataFrame:
    """X2 with A6: persona by first matching rule; the median (exact,
    interpolated like pandas) is a scalar subquery computed once."""
    med = users.agg(F.median(F.col("total_events").cast("double"))).scalar()
    return users.withColumn("persona", persona("num_purchases", "num_cart_adds", "total_events", med))


def _persona_index():
    return F.array_position(F.array(*[F.lit(p) for p in K.PERSONA_ORDER]), F.col("persona")).cast("int") - 1


def dense_segments(users_with_persona: DataFrame) -> DataFrame:
    """``target_cluster`` = rank of the persona among the personas present.

    The set of present personas (at most five) is a scalar subquery whose
    aggregate is partial map-side; no window or dimension join is needed.
    """
    present = users_with_persona.agg(F.array_sort(F.collect_set(_persona_index()))).scalar()
    return users_with_persona.withColumn(
        "target_cluster", (F.array_position(present, _persona_index()) - 1).cast("int"))


def segment_names(users_with_persona: DataFrame) -> DataFrame:
    """cluster id -> persona name for the personas present (at most five rows)."""
    present = users_with_persona.agg(F.array_sort(F.collect_set(_persona_index())).alias("_present"))
    names = F.array(*[F.lit(p) for p in K.PERSONA_ORDER])
    return present.select(F.posexplode("_present").alias("target_cluster", "_idx")).select(
        F.col("target_cluster").cast("int"), F.element_at(names, F.col("_idx") + 1).alias("segment_name"))


def with_segment_ids(users_with_persona: DataFrame, names: DataFrame) -> DataFrame:
    """``target_cluster`` by the names of another table's segments (at most five rows); null if it has none."""
    ids = names.select(F.col("segment_name").alias("persona"), "target_cluster")
    return users_with_persona.drop("target_cluster").join(F.broadcast(ids), "persona", "left")


def rollup_for_segments(activity: DataFrame, as_of: str, materialize_rollup: bool = True, extra: tuple = ()) -> DataFrame:
    """The user rollup, materialised once for the statistics computed over it.

    The median and the set of present personas are scalar subqueries over the
    rollup; column pruning gives each a different plan, so without a stored
    copy every one of them would repeat the event shuffle.  The stored copy
    holds one row per user (far smaller than the events) in the shared folder.
    """
    users = user_rollup(activity, as_of, extra=extra)
    if materialize_rollup:
        users = stored(users, "rollup")
    return users


def training_frame(activity: DataFrame, as_of: str, materialize_rollup: bool = True, extra: tuple = ()) -> DataFrame:
    """Rollup + personas + dense ids + high-intent flag + business tags."""
    users = rollup_for_segments(activity, as_of, materialize_rollup, extra)
    users = dense_segments(assign_personas(users))
    return users.withColumn("is_high_intent", high_intent("total_revenue", "total_events")).withColumn(
        "tags", business_tags("total_revenue", "days_since_first_visit", "total_events"))


def persona_distribution(users_with_persona: DataFrame) -> DataFrame:
    """A7."""
    return users_with_persona.groupBy("persona").agg(F.count(F.lit(1)).alias("n_users"))


def segment_profile(users: DataFrame) -> DataFrame:
    """Mean revenue and events per segment."""
    return users.groupBy("target_cluster").agg(
        F.avg("total_revenue").alias("avg_revenue"), F.avg(F.col("total_events").cast("double")).alias("avg_events"))


def min_support_value(n_users: int, override: int | None = None) -> int:
    """max(10, floor(n * 0.0005)) unless overridden (0 counts as unset)."""
    if override:
        return int(override)
    return max(K.MIN_SUPPORT_FLOOR, int(n_users * K.MIN_SUPPORT_FRACTION))
