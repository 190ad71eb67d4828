"""Stored visitors: bucketed table, lookup without shuffling it, routing with stored values."""

import pytest
from pyspark.sql import functions as F

from tailorspark.operators.pages import route
from tailorspark.sources.visitors import asked_visitors, load_visitors, save_visitors

USERS = ("user_pseudo_id string, total_events long, unique_pages long, total_revenue double, days_since_first_visit int, "
         "category string, region string, country string, source string, medium string, Age string, tags array<string>")


def users(spark, n=400):
    return spark.createDataFrame([(f"u{i}", i % 7, 1, float(i), i, "mobile", None if i % 5 == 0 else "EU", "DE", "bing", "cpc",
                                   "45+", ["x"]) for i in range(n)], USERS)


def requests(spark, ids):
    return spark.createDataFrame(
        [(i, u, 2, 9, 0.5, 3, ["view_item"] * (i % 4), "desktop", "US", "CA", "google", "email", "18-24") for i, u in enumerate(ids)],
        "request_id int, user_pseudo_id string, total_events int, unique_pages int, total_revenue double, "
        "days_since_first_visit int, recent_sequence array<string>, category string, region string, country string, "
        "source string, medium string, Age string")


@pytest.fixture()
def table(spark, tmp_path):
    save_visitors(users(spark), str(tmp_path / "v"))
    return load_visitors(spark, str(tmp_path / "v"))


def test_saved_and_loaded_rows_are_equal_and_ids_stand_once(spark, tmp_path):
    twice = users(spark).union(users(spark).withColumn("total_events", F.lit(50).cast("long")).limit(10)).union(
        users(spark).limit(1).withColumn("user_pseudo_id", F.lit(None).cast("string")))
    save_visitors(twice, str(tmp_path / "v"), buckets=6)
    got = load_visitors(spark, str(tmp_path / "v"))
    assert got.schema.simpleString() == twice.schema.simpleString()
    assert got.count() == got.select("user_pseudo_id").distinct().count() == 400
    assert got.where("total_events = 50").count() == 10
    assert spark.catalog.listTables() == []


def test_visitors_are_not_shuffled(spark, table):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        hits = asked_visitors(table, requests(spark, ["u3", "u4", "u3", None, "nobody"]))
        assert sorted(r[0] for r in hits.select("user_pseudo_id").collect()) == ["u3", "u4"]
        plan = hits._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert "Bucketed: true" in final
        # one side is dealt to the other's buckets: the only exchanges are the ids asked for
        scan = next(line for line in final.splitlines() if "Bucketed: true" in line)
        above = final.splitlines()[:final.splitlines().index(scan)]
        depth = len(scan) - len(scan.lstrip(" :|+-*()0123456789"))
        on_path = []
        for line in reversed(above):
            d = len(line) - len(line.lstrip(" :|+-*()0123456789"))
            if d < depth:
                on_path.append(line)
                depth = d
        assert not any("Exchange" in line or "ShuffleQueryStage" in line for line in on_path)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_route_replaces_numerics_and_context_of_stored_visitors(spark, table):
    ids = ["u6", "u2", "nobody", None, "u5", None, "u6", "u10"]
    got = {r["request_id"]: r for r in route(requests(spark, ids), True, table).collect()}
    # u6: 6 stored events; u2: only 2; u5: 5, without a region; u10: 3
    assert [got[i]["path"] for i in range(8)] == ["stored", "cold", "cold", "live", "stored", "cold", "stored", "stored"]
    assert (got[0]["total_events"], got[0]["total_revenue"], got[0]["category"], got[0]["region"]) == (6, 6.0, "mobile", "EU")
    assert got[4]["region"] == "unknown" and got[4]["country"] == "DE"
    assert (got[3]["total_events"], got[3]["category"], got[1]["total_revenue"]) == (2, "desktop", 0.5)
    assert got[0]["recent_sequence"] == [] and got[7]["recent_sequence"] == ["view_item"] * 3
    no_models = {r["path"] for r in route(requests(spark, ids), False, table).collect()}
    assert no_models == {"cold"}


def test_anonymous_requests_do_not_meet_in_one_task(spark, table):
    many = spark.range(40_000).select(F.col("id").cast("int").alias("request_id"), F.when(
        F.col("id") % 100 == 0, F.lit("u6")).alias("user_pseudo_id"))
    rest = requests(spark, ["x"]).drop("request_id", "user_pseudo_id")
    req = many.join(F.broadcast(rest), F.lit(True))
    keys = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    old = {k: spark.conf.get(k) for k in keys}
    try:
        spark.conf.set(keys[0], -1)
        spark.conf.set(keys[1], "false")
        sizes = route(req, True, table).groupBy(F.spark_partition_id()).count()
        counts = [r["count"] for r in sizes.collect()]
        assert sum(counts) == 40_000 and max(counts) < 0.5 * 40_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
