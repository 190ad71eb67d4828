"""Expected values at sf0.01 published with the fixtures (FIXTURES §3)."""

from pyspark.sql import functions as F

from tailorspark.operators.coldstart import coldstart_table, global_defaults, min_support_col
from tailorspark.operators.segments import training_frame
from tailorspark.sources.tables import AS_OF, activity

SF = "/root/testdata/sf0.01"


def test_fixture_values_sf001(spark):
    act = activity(spark, SF, "visit")
    assert act.count() == 10000
    r = act.agg(F.count("source"), F.count("medium"), F.count("ItemCategory"),
                F.round(F.sum("purchase_revenue"), 2)).first()
    assert tuple(r) == (7975, 7471, 5969, 95455.77)
    users = training_frame(act, AS_OF).cache()
    assert users.count() == 4006
    dist = {x.persona: x["count"] for x in users.groupBy("persona").count().collect()}
    assert dist == {"repeat_purchaser": 332, "one_time_buyer": 1272, "cart_abandoner": 1010, "browser": 705,
                    "cold_user": 687}
    tags = users.select(F.explode("tags").alias("t")).groupBy("t").count().collect()
    tags = {x.t: x["count"] for x in tags}
    assert tags.get("high_value", 0) == 54 and tags.get("new_user", 0) == 2012 and tags.get("frequent_shopper", 0) == 0
    assert users.where("total_events >= 3").count() == 1739
    assert users.select(min_support_col(users)).first()[0] == 10
    table = coldstart_table(users, act)
    per = {x.level_order: x["count"] for x in table.groupBy("level_order").count().collect()}
    assert [per[i] for i in range(1, 11)] == [75, 15, 25, 15, 20, 5, 3, 5, 4, 1]
    g = table.where("level_order = 10").first()
    assert (g.support, g.cluster, g.top_category, round(g.avg_revenue, 4)) == (4006, 1, "ECONOMY", 23.8282)
    users.unpersist()


def test_user_grain_values(spark):
    users = training_frame(activity(spark, SF, "user"), AS_OF)
    assert users.count() == 150
    assert users.where("total_events > 50").count() == 149
    assert users.where("total_revenue > 200").count() == 149
