"""Request payloads: JSON parsing and typed defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailorspark import constants as K
from tailorspark.functions.columns import device_category

ARRAY_FIELDS = ["recent_sequence", "recent_items", "recent_categories", "recent_display_categories"]
CONTEXT_FIELDS = ["region", "country", "source", "medium", "Age", "category"]

REQUEST_SCHEMA = T.StructType([
    T.StructField("user_pseudo_id", T.StringType()),
    T.StructField("total_events", T.IntegerType()),
    T.StructField("unique_pages", T.IntegerType()),
    T.StructField("total_revenue", T.DoubleType()),
    T.StructField("days_since_first_visit", T.IntegerType()),
    *[T.StructField(a, T.ArrayType(T.StringType())) for a in ARRAY_FIELDS],
    *[T.StructField(c, T.StringType()) for c in CONTEXT_FIELDS],
])


def parse_requests(df: DataFrame, json_col: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """JSON payload strings -> typed request columns (absent fields -> null)."""
    parsed = df.select(*(keep or []), F.from_json(F.col(json_col), REQUEST_SCHEMA).alias("_r"))
    return parsed.select(*(keep or []), "_r.*")


def apply_request_defaults(df: DataFrame, user_agent_col: str | None = "user_agent") -> DataFrame:
    """Typed defaults (1, 1, 0.0, 0, []), empty context -> 'unknown', device
    from the user agent unless the request names one."""
    empty = F.array().cast("array<string>")
    cols = {}
    for c, v in (("total_events", K.REQUEST_DEFAULT_EVENTS), ("unique_pages", K.REQUEST_DEFAULT_PAGES),
                 ("days_since_first_visit", K.REQUEST_DEFAULT_DAYS)):
        cols[c] = F.coalesce(F.col(c).cast("int"), F.lit(v)) if c in df.columns else F.lit(v)
    cols["total_revenue"] = (F.coalesce(F.col("total_revenue").cast("double"), F.lit(K.REQUEST_DEFAULT_REVENUE))
                             if "total_revenue" in df.columns else F.lit(K.REQUEST_DEFAULT_REVENUE))
    for a in ARRAY_FIELDS:
        cols[a] = F.coalesce(F.col(a), empty) if a in df.columns else empty
    for c in CONTEXT_FIELDS[:-1]:
        src = F.col(c) if c in df.columns else F.lit(None).cast("string")
        cols[c] = F.coalesce(F.nullif(src, F.lit("")), F.lit(K.UNKNOWN))
    ua = F.col(user_agent_col) if user_agent_col and user_agent_col in df.columns else F.lit(None).cast("string")
    explicit = F.col("category") if "category" in df.columns else F.lit(None).cast("string")
    cols["category"] = device_category(ua, explicit)
    return df.withColumns(cols)


def requests_as_json(df: DataFrame) -> DataFrame:
    """Serialise request rows as the API would receive them (nulls omitted)."""
    fields = [c for c in ["user_pseudo_id", "total_events", "unique_pages", "total_revenue",
                          "days_since_first_visit", *ARRAY_FIELDS, *CONTEXT_FIELDS] if c in df.columns]
    return df.select("request_id", "user_agent", F.to_json(F.struct(*fields)).alias("payload"))
