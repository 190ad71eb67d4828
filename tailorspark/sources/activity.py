"""Load raw activity and transaction files into one event table.

Files are read with explicit schemas (no inference).  Event time comes from
``eventTimestamp`` when present, else ``timestamp`` (unparseable -> null);
revenue comes from the transactions file through a left join on
``transaction_id``; rows without one pass it by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACTIVITY_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("user_pseudo_id", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("page_type", T.StringType()),
    T.StructField("eventTimestamp", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("medium", T.StringType()),
    T.StructField("Age", T.StringType()),
    T.StructField("ItemCategory", T.StringType()),
    T.StructField("transaction_id", T.StringType()),
])

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("purchase_revenue", T.DoubleType()),
])


def load_activity(spark: SparkSession, activity_path: str, transactions_path: str | None = None,
                  fmt: str = "csv") -> DataFrame:
    reader = spark.read.format(fmt).schema(ACTIVITY_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", "true")
    act = reader.load(activity_path)
    ts = F.coalesce(F.try_to_timestamp(F.col("eventTimestamp")), F.try_to_timestamp(F.col("timestamp")))
    act = act.withColumn("event_ts", ts).drop("eventTimestamp", "timestamp")
    if transactions_path is None:
        return act.withColumn("purchase_revenue", F.lit(None).cast("double"))
    tr_reader = spark.read.format(fmt).schema(TRANSACTION_SCHEMA)
    if fmt == "csv":
        tr_reader = tr_reader.option("header", "true")
    tr = tr_reader.load(transactions_path)
    # rows without a transaction, most of a clickstream, are not dealt to the join (their null ids would meet in one task)
    of_one = act.where(F.col("transaction_id").isNotNull()).join(tr, "transaction_id", "left")
    return of_one.unionByName(act.where(F.col("transaction_id").isNull()).withColumn(
        "purchase_revenue", F.lit(None).cast("double")))


def split_for_export(activity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An event table -> (activity rows with a transaction id, transactions)."""
    tid = F.when(F.col("purchase_revenue").isNotNull(), F.concat(F.lit("T"), F.col("event_id").cast("string")))
    fmt = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    ts = F.date_format("event_ts", fmt)
    a = activity.select(
        "event_id", "user_pseudo_id", "event_name", "page_type",
        F.when(F.col("event_id") % 2 == 0, ts).alias("eventTimestamp"),
        F.when(F.col("event_id") % 2 == 1, ts).alias("timestamp"),
        "category", "region", "country", "source", "medium", "Age", "ItemCategory", tid.alias("transaction_id"))
    t = activity.where(F.col("purchase_revenue").isNotNull()).select(
        tid.alias("transaction_id"), "purchase_revenue")
    return a, t
