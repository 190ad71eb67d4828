"""Shared-folder tables and small column helpers used by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailorspark.session import scratch_dir


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` once as Parquet in the cluster's shared folder and read it back.

    Cuts lineage (a lost executor costs a re-read, not a re-run) and lets several
    readers share one computation.  zstd, because packed columns compress well.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing reads any more (results built on them are stored)."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored_by_key(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``stored``, bucketed by ``key``: what groups or joins by the key later does not shuffle these rows.

    Bucketing is a property of catalog tables, so there is a table while the
    frame is being resolved; the frame keeps the bucketing, the catalog nothing.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    table = f"stored_{uuid.uuid4().hex}"
    df.write.bucketBy(min(buckets, 100_000), key).option("path", path).option("compression", "zstd") \
        .format("parquet").saveAsTable(table)
    out = spark.table(table)
    out.schema  # noqa: B018  (resolves the relation)
    spark.sql(f"DROP TABLE {table}")  # external: the files stay
    return out


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """``crc32(doc_id as text) mod modulus``: the fold of a document."""
    return F.crc32(doc_id.cast("string")) % modulus
