"""``dense_index``: ``row_number() - 1`` within groups without putting a group into one task.

The rows are stored once (a frame made by ``stored`` is read as it is).  Up to ``ROWS_PER_BUCKET`` of them a window numbers them.  Beyond,
Spark's range exchange deals them to as many buckets as the count asks for (it samples the
stored rows, takes quantiles as boundaries and finds a row's bucket by binary search); every
bucket is sorted and stored with each row's place in it.  One small row for each group and
bucket then gives the rows of the group before the bucket, and the number is arithmetic.  What
is numbered and what is counted are the same stored rows, so the numbers agree however often
the planner reads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailorspark.session import discard, stored

#: Rows that one task sorts.
ROWS_PER_BUCKET = 1_000_000
#: ``monotonically_increasing_id`` holds the partition above these bits and the row in it below.
_ROW_BITS = 33


def range_buckets(df: DataFrame, keys: list, buckets: int) -> DataFrame:
    """``df`` dealt to ``buckets`` ranges of ``keys`` (nulls first), stored in order, with ``_bucket`` and ``_inside``
    (the row's place in its bucket, from 0)."""
    order = [F.col(c).asc_nulls_first() for c in keys]
    placed = df.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumn(
        "_place", F.monotonically_increasing_id())
    return stored(placed, "ranges").withColumns({
        "_bucket": F.shiftright("_place", _ROW_BITS), "_inside": F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)}).drop("_place")


def dense_index(df: DataFrame, order_cols: list[str], group_cols: list[str] | None = None,
                index_col: str = "pos", size_col: str | None = None, buckets: int | None = None) -> DataFrame:
    """Add a 0-based dense ``index_col`` (and optionally the group size).

    Rows are numbered within ``group_cols`` in ascending ``order_cols`` (nulls
    first), which must make the order total (end with a unique column; equal
    rows are interchangeable).  Equivalent to
    ``row_number() over (partition by group order by order) - 1``; a null group
    is a group too.  ``buckets``: as many ranges, whatever the number of rows.
    """
    group_cols = list(group_cols or [])
    own = not hasattr(df, "stored_at")
    rows = stored(df, "numbered") if own else df
    if buckets is None:
        buckets = -(-rows.count() // ROWS_PER_BUCKET)
    if buckets <= 1:
        whole = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(0))
        inside = whole.orderBy(*[F.col(c).asc_nulls_first() for c in order_cols])
        out = rows.withColumn(index_col, (F.row_number().over(inside) - 1).cast("long"))
        return out.withColumn(size_col, F.count(F.lit(1)).over(whole)) if size_col else out
    placed = range_buckets(rows, [*group_cols, *order_cols], buckets)
    if own:
        discard(rows)
    renamed = {c: f"_g{i}" for i, c in enumerate(group_cols)}
    parts = placed.groupBy(F.col("_bucket").alias("_b"), *[F.col(c).alias(a) for c, a in renamed.items()]).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_inside").alias("_first"))
    whole = Window.partitionBy(*renamed.values()) if group_cols else Window.partitionBy(F.lit(0))  # a row for each bucket
    parts = parts.withColumn("_before", F.sum("_n").over(whole.orderBy("_b")) - F.col("_n"))
    if size_col:
        parts = parts.withColumn(size_col, F.sum("_n").over(whole))
    same = placed["_bucket"] == F.col("_b")
    for c, a in renamed.items():
        same &= placed[c].eqNullSafe(F.col(a))
    out = placed.join(parts.drop("_n"), same)
    out = out.withColumn(index_col, (F.col("_before") + F.col("_inside") - F.col("_first")).cast("long"))
    return out.drop("_bucket", "_inside", "_b", "_first", "_before", *renamed.values())


def dealt_evenly(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The ``rows`` rows of ``df`` dealt to tasks by hash of ``key`` (unique), in its order there: iterative fits read
    them many times, and a count of its own keeps adaptive execution from merging small partitions into a few tasks."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_BUCKET))
    return df.repartition(parts, key).sortWithinPartitions(key)
