"""The five sample visitor payloads through page assembly (FIXTURES §5)."""

import pytest
from pyspark.sql import functions as F

from tailorspark.operators.coldstart import coldstart_table, global_defaults
from tailorspark.operators.pages import personalize
from tailorspark.operators.segments import training_frame
from tailorspark.sources.requests import apply_request_defaults
from tailorspark.sources.tables import AS_OF, activity
from conftest import SF_SMALL

CATS = ["Apparel", "Shoes", "Accessories", "Furniture", "Office Gear"]

PAYLOADS = [
    ("cold_user", 1, 1, 0.0, 0, [], []),
    ("browser", 8, 6, 0.0, 2, ["page_view", "page_view", "view_item", "page_view", "view_item", "page_view"],
     ["Apparel", "Apparel", "Shoes"]),
    ("cart_abandoner", 14, 8, 0.0, 5, ["page_view", "view_item", "view_item", "add_to_cart", "page_view",
                                        "view_item"], ["Accessories", "Accessories"]),
    ("one_time_buyer", 20, 10, 65.0, 14, ["view_item", "add_to_cart", "purchase", "page_view", "view_item"],
     ["Furniture", "Furniture"]),
    ("repeat_purchaser", 55, 22, 340.0, 180, ["view_item", "purchase", "view_item", "purchase", "view_item",
                                              "add_to_cart", "purchase"], ["Office Gear", "Office Gear"]),
]


@pytest.fixture(scope="module")
def parts(spark):
    act = activity(spark, SF_SMALL, "visit")
    users = training_frame(act, AS_OF)
    cat_rows = [(f"{c[:2].upper()}-{i}", f"{c} item {i}", c, None, 10.0 + i, j * 10 + i)
                for j, c in enumerate(CATS) for i in range(7)]
    catalog = spark.createDataFrame(cat_rows, "id string, name string, category string, display_category string, "
                                              "price double, catalog_pos long")
    return coldstart_table(users, act), global_defaults(act, users), catalog


def _requests(spark):
    rows = [(k, k, e, p, r, d, s, c, c) for k, e, p, r, d, s, c in PAYLOADS]
    df = spark.createDataFrame(rows, "request_id string, user_pseudo_id string, total_events int, unique_pages int, "
                                     "total_revenue double, days_since_first_visit int, recent_sequence array<string>, "
                                     "recent_categories array<string>, recent_display_categories array<string>")
    return apply_request_defaults(df)


def test_golden_cold_pages(spark, parts):
    table, defaults, catalog = parts
    pages = {r.request_id: r for r in personalize(_requests(spark), table, defaults, catalog).collect()}
    assert pages["browser"].target_category == "Shoes"
    assert pages["cart_abandoner"].target_category == "Accessories"
    assert pages["one_time_buyer"].target_category == "Furniture"
    assert pages["repeat_purchaser"].target_category == "Office Gear"
    assert pages["cold_user"].target_category in CATS
    for k in ("cold_user", "browser", "cart_abandoner", "one_time_buyer"):
        assert pages[k].path == "cold" and pages[k].confidence == 0.5
        assert pages[k].tags[-1] == "new_user" and pages[k].cta.type == "first_purchase"
    rp = pages["repeat_purchaser"]
    assert rp.tags[:3] == ["high_value", "frequent_shopper", "new_user"] and rp.cta.type == "loyalty"
    for p in pages.values():
        assert len(p.hero_products) == 4 and len(p.primary_products) == 4 and len(p.secondary_products) == 4
        assert p.secondary_category != p.target_category
        assert not set(p.primary_products) & set(p.secondary_products)


def test_golden_live_pages(spark, parts):
    """With a model ready, requests with >= 3 signals take the live path."""
    table, defaults, catalog = parts
    req = _requests(spark)
    preds = req.select("request_id", F.lit(1).alias("m_cluster"), F.lit(0.97).alias("m_confidence"),
                       F.lit("deep_model").alias("m_source"))
    pages = {r.request_id: r for r in personalize(req, table, defaults, catalog, predictions=preds).collect()}
    assert pages["cold_user"].path == "cold"
    for k in ("browser", "cart_abandoner", "one_time_buyer"):
        assert pages[k].path == "live" and pages[k].tags == ["new_user"]
        assert pages[k].cta.type == "first_purchase" and pages[k].prediction_source == "deep_model"
    rp = pages["repeat_purchaser"]
    assert rp.tags == ["high_value", "frequent_shopper"] and rp.cta.type == "loyalty"
    assert pages["one_time_buyer"].avg_revenue == 65.0


def test_stored_mode_page(spark, parts):
    """A known visitor with >= 3 stored events takes the stored path; its
    numerics come from the user table and the CTA average from its segment."""
    table, defaults, catalog = parts
    users = spark.createDataFrame([
        ("repeat_purchaser", 12, 5, 150.0, 40, "mobile", "EU", "DE", "google", "cpc", "25-44", 0),
        ("other", 3, 2, 250.0, 10, "mobile", "EU", "DE", "google", "cpc", "25-44", 0),
        ("browser", 2, 1, 0.0, 1, "mobile", "EU", "DE", "google", "cpc", "25-44", 3),
    ], "user_pseudo_id string, total_events long, unique_pages long, total_revenue double, "
       "days_since_first_visit int, category string, region string, country string, source string, "
       "medium string, Age string, target_cluster int")
    req = _requests(spark)
    preds = req.select("request_id", F.lit(0).alias("m_cluster"), F.lit(0.9).alias("m_confidence"),
                       F.lit("deep_model").alias("m_source"))
    pages = {r.request_id: r for r in personalize(req, table, defaults, catalog, users=users,
                                                  predictions=preds).collect()}
    rp = pages["repeat_purchaser"]
    assert rp.path == "stored" and rp.total_events == 12 and rp.tags == ["standard"]
    assert rp.avg_revenue == 200.0 and rp.cta.type == "standard"   # mean of segment 0 revenues
    assert pages["browser"].path == "live"                          # stored row has < 3 events
