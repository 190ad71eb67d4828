"""Boundary rows of the scalar rules (FIXTURES §4)."""

from pyspark.sql import functions as F

from tailorspark.functions.columns import (
    business_tags, coldstart_tags, cta_module, days_since, device_category, first_n, last_n, persona,
    recency_category, signal_strength, slug_id)


def test_business_tags_boundaries(spark):
    df = spark.createDataFrame([(200.0, 30, 50), (200.01, 29, 51), (0.0, 365, 0)], "rev double, days int, ev long")
    got = [r.t for r in df.select(business_tags("rev", "days", "ev").alias("t")).collect()]
    assert got == [["standard"], ["high_value", "new_user", "frequent_shopper"], ["standard"]]


def test_persona_rules(spark):
    df = spark.createDataFrame([(1, 3, 10, 5.0), (0, 0, 5, 5.0), (0, 0, 4, 5.0), (2, 0, 1, 5.0), (0, 1, 1, 5.0)],
                               "p long, c long, e long, m double")
    got = [r.x for r in df.select(persona("p", "c", "e", "m").alias("x")).collect()]
    assert got == ["one_time_buyer", "browser", "cold_user", "repeat_purchaser", "cart_abandoner"]


def test_days_since(spark):
    df = spark.createDataFrame([("2024-02-15 12:00:00",), (None,), ("2024-02-13 23:59:59",)], "t string")
    df = df.select(F.to_timestamp("t").alias("t"))
    got = [r.d for r in df.select(days_since("t", "2024-02-15 00:00:00").alias("d")).collect()]
    assert got == [-1, 365, 1]


def test_device_guess(spark):
    df = spark.createDataFrame([("iPad Mobile", None), ("Android", None), ("", None), ("X11", None),
                                ("Android", "desktop"), (None, "")], "ua string, cat string")
    got = [r.d for r in df.select(device_category("ua", "cat").alias("d")).collect()]
    assert got == ["tablet", "mobile", "unknown", "desktop", "desktop", "unknown"]


def test_coldstart_tags_and_cta(spark):
    df = spark.createDataFrame([(["standard"], 50.0), (["standard"], 200.01), (["new_user"], 10.0)],
                               "t array<string>, avg double")
    got = [r.x for r in df.select(coldstart_tags("t", "avg").alias("x")).collect()]
    assert got == [["standard", "new_user"], ["standard", "new_user", "high_value_segment"], ["new_user"]]
    cta = spark.createDataFrame([(["standard"], 50.0), (["standard"], 100.0), (["high_value", "new_user"], 0.0),
                                 (["new_user"], 500.0)], "t array<string>, avg double")
    got = [r.x.type for r in cta.select(cta_module("t", "avg").alias("x")).collect()]
    assert got == ["engagement", "standard", "loyalty", "first_purchase"]


def test_signal_strength(spark):
    df = spark.createDataFrame([([], 2), ([], 3), (["a", "b"], 50)], "s array<string>, e int")
    got = [r.x for r in df.select(signal_strength("s", "e").alias("x")).collect()]
    assert got == [2.0, 3.0, 2.0]


def test_recency_category(spark):
    df = spark.createDataFrame([(["A", "A", "A", "B"],), (["A", None, "ZZZ"],), ([],), (["B", "", "A"],)],
                               "c array<string>")
    valid = F.array(F.lit("A"), F.lit("B"))
    got = [r.x for r in df.select(recency_category("c", valid).alias("x")).collect()]
    assert got == ["B", "A", None, "A"]
    # general base: counts (base 1) favour A; ties go to the first seen
    got1 = [r.x for r in df.select(recency_category("c", valid, base=1.0).alias("x")).collect()]
    assert got1 == ["A", "A", None, "B"]


def test_last_window_of_eight(spark):
    df = spark.createDataFrame([(["B"] + ["A"] * 8,)], "c array<string>")
    got = df.select(recency_category("c", None, base=1.0).alias("x")).first().x
    assert got == "A"


def test_sequence_slices(spark):
    df = spark.createDataFrame([(list(range(1, 31)),), ([],)], "s array<int>")
    out = df.select(first_n("s").alias("f"), last_n("s").alias("l")).collect()
    assert out[0].f == list(range(1, 26)) and out[0].l == list(range(6, 31))
    assert out[1].f == [] and out[1].l == []


def test_slugs(spark):
    df = spark.createDataFrame([("---.png",), ("b.jpg",), ("a b.c.PNG",), (".hidden",), ("x/y/Hello World!.gif",)],
                               "p string")
    got = [r.s for r in df.select(slug_id("p").alias("s")).collect()]
    assert got == ["ITEM", "B", "A-B-C", "HIDDEN", "HELLO-WORLD"]
