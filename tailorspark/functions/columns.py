"""Scalar logic as native Column expressions (whole-stage codegen, no UDFs).

Each function takes and returns ``Column`` objects so that callers compose
them into one projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tailorspark import constants as K


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- X1 ----------------------------------------------------------------------
def days_since(first_ts: Column | str, as_of: Column | str) -> Column:
    """Whole days from ``first_ts`` to ``as_of``, floored; null -> 365."""
    as_of_c = F.to_timestamp(F.lit(as_of)) if isinstance(as_of, str) else as_of
    micros = F.unix_micros(as_of_c) - F.unix_micros(_c(first_ts).cast("timestamp"))
    days = F.floor(micros / F.lit(86400 * 1_000_000)).cast("int")
    return F.coalesce(days, F.lit(K.DAYS_WHEN_UNKNOWN))


# -- X2 ----------------------------------------------------------------------
def persona(num_purchases: Column | str, num_cart_adds: Column | str,
            total_events: Column | str, median_events: Column | str) -> Column:
    """First matching persona rule (order is significant)."""
    p, c, e, m = _c(num_purchases), _c(num_cart_adds), _c(total_events), _c(median_events)
    return (
        F.when(p > 1, K.PERSONA_ORDER[0])
        .when(p == 1, K.PERSONA_ORDER[1])
        .when(c > 0, K.PERSONA_ORDER[2])
        .when(e >= m, K.PERSONA_ORDER[3])
        .otherwise(K.PERSONA_ORDER[4])
    )


# -- X3 ----------------------------------------------------------------------
def high_intent(total_revenue: Column | str, total_events: Column | str) -> Column:
    return ((_c(total_revenue) > 0) | (_c(total_events) > K.HIGH_INTENT_EVENTS)).cast("int")


# -- X4 ----------------------------------------------------------------------
def business_tags(total_revenue: Column | str, days: Column | str, total_events: Column | str) -> Column:
    """[high_value, new_user, frequent_shopper] in this order; none -> [standard]."""
    tags = F.filter(
        F.array(
            F.when(_c(total_revenue) > K.HIGH_VALUE_REVENUE, F.lit(K.TAG_HIGH_VALUE)),
            F.when(_c(days) < K.NEW_USER_DAYS, F.lit(K.TAG_NEW_USER)),
            F.when(_c(total_events) > K.FREQUENT_EVENTS, F.lit(K.TAG_FREQUENT)),
        ),
        lambda t: t.isNotNull(),
    )
    return F.when(F.size(tags) == 0, F.array(F.lit(K.TAG_STANDARD))).otherwise(tags)


# -- X5 ----------------------------------------------------------------------
def coldstart_tags(tags: Column | str, resolved_avg_revenue: Column | str) -> Column:
    """Append new_user if absent, then high_value_segment when avg > 200."""
    t = _c(tags)
    with_new = F.when(F.array_contains(t, K.TAG_NEW_USER), t).otherwise(
        F.concat(t, F.array(F.lit(K.TAG_NEW_USER))))
    add_seg = (F.coalesce(_c(resolved_avg_revenue), F.lit(0.0)) > K.HIGH_VALUE_REVENUE) & ~F.array_contains(
        with_new, K.TAG_HIGH_VALUE_SEGMENT)
    return F.when(add_seg, F.concat(with_new, F.array(F.lit(K.TAG_HIGH_VALUE_SEGMENT)))).otherwise(with_new)


# -- X6 ----------------------------------------------------------------------
def log_feature(x: Column | str) -> Column:
    return F.log1p(F.greatest(_c(x).cast("double"), F.lit(0.0)))


def numeric_transform(name: str) -> Column:
    """log1p(max(x, 0)) for the skewed columns, the value itself otherwise."""
    return (log_feature(name) if name in K.LOG_TRANSFORM_COLS else F.col(name).cast("double")).alias(name)


# -- X7 ----------------------------------------------------------------------
def device_category(user_agent: Column | str, explicit: Column | str | None = None) -> Column:
    """Device guess from a user agent; a non-empty explicit value wins."""
    ua = F.lower(F.coalesce(_c(user_agent), F.lit("")))
    guess = (
        F.when(ua == "", F.lit(K.UNKNOWN))
        .when(ua.contains(K.DEVICE_TABLET_MARKERS[0]) | ua.contains(K.DEVICE_TABLET_MARKERS[1]), F.lit("tablet"))
        .when(ua.contains(K.DEVICE_MOBILE_MARKERS[0]) | ua.contains(K.DEVICE_MOBILE_MARKERS[1])
              | ua.contains(K.DEVICE_MOBILE_MARKERS[2]), F.lit("mobile"))
        .otherwise(F.lit("desktop"))
    )
    if explicit is None:
        return guess
    return F.coalesce(F.nullif(_c(explicit), F.lit("")), guess)


# -- X8 ----------------------------------------------------------------------
def signal_strength(recent_sequence: Column | str, total_events: Column | str) -> Column:
    n = F.coalesce(F.size(_c(recent_sequence)), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    return F.when(n > 0, n.cast("double")).otherwise(F.coalesce(_c(total_events).cast("double"), F.lit(0.0)))


# -- X10 ---------------------------------------------------------------------
def avg_revenue_fallback(segment_avg: Column | str, fallback: Column | str) -> Column:
    """Segment mean when non-zero, else the path's fallback, else 0."""
    return F.coalesce(
        F.nullif(_c(segment_avg).cast("double"), F.lit(0.0)),
        F.nullif(_c(fallback).cast("double"), F.lit(0.0)),
        F.lit(0.0),
    )


# -- X11 ---------------------------------------------------------------------
def cta_module(tags: Column | str, avg_revenue: Column | str) -> Column:
    """struct(type, title, button_text), first matching rule."""
    t, avg = _c(tags), F.coalesce(_c(avg_revenue), F.lit(0.0))

    def s(v):
        return F.struct(F.lit(v[0]).alias("type"), F.lit(v[1]).alias("title"), F.lit(v[2]).alias("button_text"))

    return (
        F.when(F.array_contains(t, K.TAG_HIGH_VALUE) | F.array_contains(t, K.TAG_HIGH_VALUE_SEGMENT), s(K.CTA_LOYALTY))
        .when(F.array_contains(t, K.TAG_NEW_USER), s(K.CTA_FIRST_PURCHASE))
        .when(avg < K.CTA_ENGAGEMENT_BELOW, s(K.CTA_ENGAGEMENT))
        .otherwise(s(K.CTA_STANDARD))
    )


# -- X12 ---------------------------------------------------------------------
def hero_copy(target_category: Column | str) -> Column:
    return F.struct(
        F.format_string(K.HERO_TITLE_FORMAT, _c(target_category)).alias("title"),
        F.lit(K.HERO_SUBTITLE).alias("subtitle"),
        F.lit(K.HERO_CTA).alias("cta"),
    )


# -- X13 ---------------------------------------------------------------------
STEM_PATTERN = r"^(\.*[^.].*)\.[^.]*$"
EXT_PATTERN = r"^\.*[^.].*(\.[^.]*)$"


def file_stem(path: Column | str) -> Column:
    """Basename without its last extension; leading dots do not start one."""
    base = F.regexp_extract(_c(path), r"([^/]*)$", 1)
    stem = F.regexp_extract(base, STEM_PATTERN, 1)
    return F.when(base.rlike(STEM_PATTERN), stem).otherwise(base)


def file_extension(path: Column | str) -> Column:
    base = F.regexp_extract(_c(path), r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, EXT_PATTERN, 1))


def slug_id(path: Column | str) -> Column:
    """Non-alphanumeric runs -> '-', trimmed, upper-cased; empty -> ITEM."""
    s = F.upper(F.regexp_replace(F.regexp_replace(file_stem(path), r"[^a-zA-Z0-9]+", "-"), r"^-+|-+$", ""))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(K.SLUG_EMPTY))


# -- X14 ---------------------------------------------------------------------
def segment_name(known_name: Column | str, segment: Column | str) -> Column:
    return F.coalesce(_c(known_name), F.concat(F.lit("segment_"), _c(segment).cast("string")))


# -- X15 ---------------------------------------------------------------------
def confidence_round(conf: Column | str) -> Column:
    return F.round(_c(conf).cast("double"), 4)


def percent_match(conf: Column | str) -> Column:
    """Client display: Math.round(confidence * 100) (half rounds up)."""
    return F.floor(F.coalesce(_c(conf), F.lit(0.0)) * 100 + 0.5).cast("int")


# -- X17 ---------------------------------------------------------------------
def display_category(display: Column | str, category: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(display), F.lit("")), _c(category))


# -- X21 ---------------------------------------------------------------------
def categories_for_target(display_cats: Column | str, cats: Column | str) -> Column:
    d = F.coalesce(_c(display_cats), F.array().cast("array<string>"))
    return F.when(F.size(d) > 0, d).otherwise(F.coalesce(_c(cats), F.array().cast("array<string>")))


# -- X22 ---------------------------------------------------------------------
def first_n(arr: Column | str, n: int = K.SEQUENCE_MAX_LEN) -> Column:
    return F.slice(_c(arr), 1, n)


def last_n(arr: Column | str, n: int = K.SEQUENCE_MAX_LEN) -> Column:
    a = _c(arr)
    m = F.least(F.size(a), F.lit(n))
    return F.when(m <= 0, F.slice(a, 1, 0)).otherwise(F.slice(a, -m, m))


# -- W2 ----------------------------------------------------------------------
def recency_category(categories: Column | str, valid: Column | str | None = None,
                     window: int = K.RECENCY_WINDOW, base: float = K.RECENCY_BASE) -> Column:
    """Recency-weighted winner among the last ``window`` valid categories.

    ``valid`` is an array column of allowed categories (e.g. the catalog's);
    entries that are null, empty or not allowed are dropped first.  Weight of
    position i (0 = oldest of the slice) is ``base ** i``; the highest total
    wins, ties go to the category seen first in the slice.  With base 2 this
    is always the last valid entry.  Returns null when nothing is valid.
    """
    arr = F.coalesce(_c(categories), F.array().cast("array<string>"))
    if valid is None:
        cleaned = F.filter(arr, lambda x: x.isNotNull() & (x != ""))
    else:
        vcol = _c(valid)
        cleaned = F.filter(arr, lambda x: x.isNotNull() & (x != "") & F.array_contains(vcol, x))
    n = F.size(cleaned)
    recent = F.slice(cleaned, F.greatest(n - window + 1, F.lit(1)), window)
    if float(base) == 2.0:
        return F.try_element_at(recent, F.lit(-1))
    # general base: score every distinct category, keep the first best one
    distinct = F.array_distinct(recent)
    scored = F.transform(
        distinct,
        lambda c, i: F.struct(
            F.aggregate(
                F.transform(recent, lambda x, j: F.when(x == c, F.pow(F.lit(float(base)), j)).otherwise(0.0)),
                F.lit(0.0), lambda acc, v: acc + v,
            ).alias("score"),
            (-i).alias("neg_first"),
            c.alias("category"),
        ),
    )
    return F.array_max(scored)["category"]


def array_text(arr: Column | str, sep: str = ",") -> Column:
    """Arrays are compared as joined strings (null -> null)."""
    return F.array_join(_c(arr), sep)
