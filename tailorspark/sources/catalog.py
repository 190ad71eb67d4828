"""Product catalog from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailorspark import constants as K

CATALOG_SCHEMA = ("id string, name string, category string, subcategory string, display_category string, "
                  "price double, description string, image_url string")


def load_catalog(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Catalog rows from JSON: one object a line, or with ``array`` files that hold one array each.

    Missing fields are null, a missing category is Unknown; ``catalog_pos``
    ascends in file order.
    """
    rows = spark.read.schema(CATALOG_SCHEMA).option("multiLine", array).json(path)
    return rows.withColumn("category", F.coalesce("category", F.lit(K.UNKNOWN_CATEGORY))).withColumn(
        "catalog_pos", F.monotonically_increasing_id())
