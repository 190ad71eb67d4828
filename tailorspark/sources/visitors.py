"""Stored visitors: one row per known visitor, bucketed and sorted by visitor id.

``save_visitors`` lays the table out once (say, nightly); requests look it up without
shuffling it: the ids asked for are dealt to the table's buckets and meet each bucket where
it lies.  The number of buckets follows the number of visitors.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Visitors of one bucket, and most buckets (a limit of Spark's).
ROWS_PER_BUCKET, MOST_BUCKETS = 1_000_000, 100_000
KEY = "user_pseudo_id"


def save_visitors(users: DataFrame, path: str, key: str = KEY, buckets: int | None = None) -> None:
    """Write ``users`` below ``path``, at least as many buckets as the session shuffles to.

    Rows without an id are left out.  An id stands once: of repeated ones the row that is
    greatest by ``total_events``, then by the other columns in their order.
    """
    spark = users.sparkSession
    known = users.where(F.col(key).isNotNull())
    if buckets is None:
        shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(MOST_BUCKETS, max(shuffled, -(-known.count() // ROWS_PER_BUCKET)))
    rest = sorted((c for c in users.columns if c != key), key=lambda c: c != "total_events")
    rows = known.repartition(buckets, key).groupBy(key).agg(F.max(F.struct(*rest)).alias("_row")).select(
        *[F.col(c) if c == key else F.col(f"_row.{c}").alias(c) for c in users.columns])
    name = f"visitors_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", f"{path}/rows").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # external: the files stay
    layout = json.dumps({"key": key, "buckets": buckets, "schema": rows.schema.jsonValue()})
    spark.createDataFrame([(layout,)], "value string").coalesce(1).write.text(f"{path}/layout")


def load_visitors(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``save_visitors`` wrote, with its buckets known to the planner."""
    from pyspark.sql.types import StructType

    layout = json.loads(spark.read.text(f"{path}/layout").first()[0])
    schema = StructType.fromJson(layout["schema"])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    name = f"visitors_{uuid.uuid4().hex}"
    # a bucketed table is known by its definition; the frame keeps it, the catalog need not
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{layout['key']}`) "
              f"SORTED BY (`{layout['key']}`) INTO {layout['buckets']} BUCKETS LOCATION '{path}/rows'")
    out = spark.table(name)
    out.schema  # noqa: B018  (resolves the relation)
    spark.sql(f"DROP TABLE {name}")
    return out


def asked_visitors(visitors: DataFrame, requests: DataFrame, key: str = KEY) -> DataFrame:
    """The rows of ``visitors`` whose ids occur in ``requests``: each id is asked for once, however many requests it has."""
    asked = requests.select(key).where(F.col(key).isNotNull()).distinct()
    return visitors.join(asked, key, "left_semi")
