"""Properties: answers do not depend on partition count, resolution is
total, personas partition the users, picks fit their category without repeats."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tailorspark.plans.registry import all_queries


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_answers_independent_of_partitioning(spark):
    qs = all_queries()
    names = ["personalize_cold", "coldstart_table", "product_picks", "recent_signals", "unique_ids"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = {n: _rows(qs[n](spark, SF_SMALL)) for n in names}
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        seven = {n: _rows(qs[n](spark, SF_SMALL)) for n in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for n in names:
        assert one[n] == seven[n], n


def test_resolution_total_and_personas_partition(spark):
    qs = all_queries()
    res = qs["coldstart_resolve"](spark, SF_SMALL)
    assert res.where(F.col("cluster").isNull() | F.col("source_label").isNull()).count() == 0
    users = qs["personas"](spark, SF_SMALL)
    assert users.count() == users.select("user_pseudo_id").distinct().count()
    assert users.where(F.col("persona").isNull()).count() == 0


def test_picks_fit_category_and_do_not_repeat(spark):
    from tailorspark.sources.tables import catalog

    picks = all_queries()["product_picks"](spark, SF_SMALL)
    cat = catalog(spark, SF_SMALL).select(F.col("id").alias("pid"), F.col("category").alias("pcat"))
    ex = picks.select("request_id", "target_category", "excluded", F.explode(F.split("products", ",")).alias("pid"))
    ex = ex.where(F.col("pid") != "")
    j = ex.join(cat, "pid", "left")
    assert j.where(F.col("pcat") != F.col("target_category")).count() == 0
    assert ex.groupBy("request_id", "pid").count().where("count > 1").count() == 0
    assert ex.where(F.array_contains(F.split("excluded", ","), F.col("pid"))).count() == 0
