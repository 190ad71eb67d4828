"""Score a stream of request payloads against static lookup tables.

Requests arrive as JSON files; every micro-batch is a static DataFrame that
goes through the same plan as the batch personaliser (stream-static joins
with the checkpointed cold-start table, catalog and names).  Results are
written per batch to parquet under the batch id, so a replayed batch
overwrites its own output (idempotent sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tailorspark.operators.catalog import rank_catalog
from tailorspark.operators.coldstart import lookup_index
from tailorspark.operators.pages import flatten_document, page_document, personalize
from tailorspark.session import materialize
from tailorspark.sources.requests import REQUEST_SCHEMA, apply_request_defaults

PAYLOAD_SCHEMA = T.StructType([T.StructField("request_id", T.StringType()),
                               T.StructField("user_agent", T.StringType()),
                               T.StructField("payload", T.StringType())])


def run_personalize_stream(spark: SparkSession, in_dir: str, out_dir: str, ckpt: str, cold_table: DataFrame,
                           defaults: DataFrame, catalog: DataFrame, names: DataFrame | None = None,
                           max_files: int = 4, timeout_s: int | None = None) -> DataFrame:
    src = (spark.readStream.schema(PAYLOAD_SCHEMA).option("maxFilesPerTrigger", max_files).json(in_dir))
    # the static side is prepared once, before the first batch
    ranked = materialize(rank_catalog(catalog))
    index = lookup_index(cold_table)

    def handle(batch: DataFrame, batch_id: int) -> None:
        req = batch.select("request_id", "user_agent", F.from_json("payload", REQUEST_SCHEMA).alias("_r"))
        req = apply_request_defaults(req.select("request_id", "user_agent", "_r.*"))
        pages = personalize(req, cold_table, defaults, catalog, names=names, ranked=ranked, index=index)
        doc = page_document(pages)
        doc.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    q = src.writeStream.foreachBatch(handle).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("stream did not finish")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return flatten_document(spark.read.parquet(out_dir))
