"""SparkSession construction and the shared scratch folder.

On a cluster the session is created by the platform; we only read
``spark.checkpoint.dir`` (the shared, reliable folder) and never invent a
machine-local one.  Tests and local runs get a fresh ``/tmp`` folder when the
setting is unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Local runs only: the driver is the executor.  A cluster sets its own sizes.
LOCAL_CONF = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}

# Merging scalar subqueries can leave a reference that code generation cannot
# compile when scalar subqueries nest (one-row statistics computed over frames
# that already use one); correctness needs the rule off.
EXCLUDED_RULES = "org.apache.spark.sql.catalyst.optimizer.MergeScalarSubqueries"


def get_session(master: str | None = None, app_name: str = "tailorspark", **conf) -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    master = master or os.environ.get("TAILORSPARK_MASTER", "local[*]")
    builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(LOCAL_CONF if master.startswith("local") else {}), **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_sql_rules(spark: SparkSession) -> None:
    current = spark.conf.get("spark.sql.optimizer.excludedRules", "") or ""
    if EXCLUDED_RULES not in current:
        rules = ",".join(r for r in (current, EXCLUDED_RULES) if r)
        spark.conf.set("spark.sql.optimizer.excludedRules", rules)


def is_local(spark: SparkSession) -> bool:
    """One JVM does all the work, so a folder of this machine is shared by all of it."""
    master = spark.conf.get("spark.master", "")
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a local one only if unset."""
    ensure_sql_rules(spark)
    set_ = spark.sparkContext.getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or set_
    if not path:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tailorspark-ckpt-")
    if not set_:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (never reused)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Reliable checkpoint into the shared folder, computing the plan once.

    An eager checkpoint runs one job to count and a second to write unless
    the rows are persisted in between; the persisted copy is dropped as soon
    as the checkpoint files exist (lineage is cut, executors may be lost).
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        out = df.checkpoint(eager=True)
    finally:
        df.unpersist()
    return out


def stored(df, name: str):
    """Write ``df`` once as Parquet in the shared folder and read it back (lineage is cut)."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables) -> None:
    """Delete tables made by ``stored`` that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
