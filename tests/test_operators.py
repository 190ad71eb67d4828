"""Operators on hand-made frames (FIXTURES §4)."""

import pytest
from pyspark.sql import functions as F

from tailorspark import constants as K
from tailorspark.operators.bootstrap import unique_ids, image_listing
from tailorspark.operators.catalog import (
    category_counts, lookup_items, module_picks, product_picks, rank_catalog, target_category)
from tailorspark.operators.clickstream import recent_events, valid_events
from tailorspark.operators.coldstart import coldstart_table, resolve_cold_start
from tailorspark.operators.features import user_rollup
from tailorspark.operators.models import cascade, merge_small_clusters
from tailorspark.operators.partitioning import dense_index
from tailorspark.operators.segments import dense_segments, min_support_value


def test_dense_index_matches_row_number(spark):
    from pyspark.sql import Window

    df = spark.range(0, 5000).select((F.col("id") % 7).alias("g"), F.hash("id").alias("h"), "id")
    df = df.withColumn("g", F.when(F.col("g") < 3, F.lit(0)).otherwise(F.col("g")))  # one hot group
    a = dense_index(df, ["h", "id"], ["g"], index_col="pos", size_col="m")
    w = Window.partitionBy("g").orderBy("h", "id")
    b = df.withColumn("pos2", F.row_number().over(w) - 1).withColumn("m2", F.count("*").over(Window.partitionBy("g")))
    j = a.join(b, ["id"])
    assert j.where((F.col("pos") != F.col("pos2")) | (F.col("m") != F.col("m2"))).count() == 0
    assert j.count() == 5000


def test_mode_ties_and_unknown(spark):
    df = spark.createDataFrame([
        (1, "u1", "view_item", "p1", None, "2024-01-01 00:00:00", "z"),
        (2, "u1", "view_item", "p1", None, "2024-01-01 00:01:00", "b"),
        (3, "u2", "purchase", "p2", 5.0, "2024-01-02 00:00:00", None),
    ], "event_id long, user_pseudo_id string, event_name string, page_type string, purchase_revenue double, "
       "event_ts string, region string")
    df = df.withColumn("event_ts", F.to_timestamp("event_ts"))
    out = {r.user_pseudo_id: r for r in user_rollup(df, "2024-02-15 00:00:00").collect()}
    assert out["u1"].region == "b" and out["u2"].region == "unknown"
    assert out["u1"].total_revenue == 0.0 and out["u2"].num_purchases == 1


def test_rollup_counts_values_instead_of_mode_maps(spark):
    import datetime
    import random
    from collections import Counter

    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", "c", None]), r.choice(["purchase", "add_to_cart", None]), r.choice(["p1", "p2", None]),
             r.choice([1.5, None]), r.choice(["x", "y", None]), r.choice([9, 10, None])) for i in range(60)]
    rows += [(60, "d", None, None, None, None, None), (61, "e", "purchase", "p1", 2.0, None, 10), (62, "e", None, "p1", None, "x", 9)]
    df = spark.createDataFrame(rows, "event_id long, user_pseudo_id string, event_name string, page_type string, "
                               "purchase_revenue double, source string, ItemCategory int")
    df = df.withColumn("event_ts", F.lit(datetime.datetime(2024, 2, 1)))
    out = user_rollup(df, "2024-02-15 00:00:00", extra=(F.min("event_id").alias("first"),))
    # a mode aggregate encodes its map of values for every user, column and exchange
    assert "mode(" not in out._jdf.queryExecution().optimizedPlan().toString()

    def mode(values):
        n = Counter(v for v in values if v is not None)
        return min(n, key=lambda v: (-n[v], v), default=None)

    got = {x.user_pseudo_id: x for x in out.collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    for u, x in got.items():
        mine = [row for row in rows if row[1] == u]
        assert x.total_events == sum(row[2] is not None for row in mine) and x.first == mine[0][0]
        assert x.unique_pages == len({row[3] for row in mine} - {None})
        assert x.total_revenue == sum(row[4] or 0 for row in mine)
        assert x.source == (mode([row[5] for row in mine]) or "unknown")
        assert x.top_category == mode([row[6] for row in mine])  # a number: 9 before 10


def test_dense_ids_only_present(spark):
    df = spark.createDataFrame([("a", "cart_abandoner"), ("b", "cold_user")], "user_pseudo_id string, persona string")
    got = sorted((r.persona, r.target_cluster) for r in dense_segments(df).collect())
    assert got == [("cart_abandoner", 0), ("cold_user", 1)]


def test_min_support_rule():
    assert min_support_value(4006) == 10
    assert min_support_value(40000) == 20
    assert min_support_value(40000, 0) == 20
    assert min_support_value(40000, 7) == 7


def _users(spark):
    rows = []
    # 12 users in (EU, mobile, google), 12 in (EU, desktop, bing)
    for i in range(12):
        rows.append((f"a{i}", "EU", "mobile", "google", "cpc", 1, "X", 10.0))
        rows.append((f"b{i}", "EU", "desktop", "bing", "organic", 2, None, 300.0))
    return spark.createDataFrame(rows, "user_pseudo_id string, region string, category string, source string, "
                                       "medium string, target_cluster int, top_category string, total_revenue double")


def test_backoff_levels(spark):
    users = _users(spark)
    act = spark.createDataFrame([("X",)], "ItemCategory string")
    table = coldstart_table(users, act, min_support=10)
    defaults = spark.createDataFrame([("X", 1)], "global_top_category string, global_cluster int")
    req = spark.createDataFrame([
        ("r1", "EU", "mobile", "google", "cpc"),      # full match
        ("r2", "EU", "tablet", "google", "cpc"),      # region+category absent; region+source present
        ("r3", "US", "tablet", "yahoo", "unknown"),   # nothing -> global
        ("r4", "EU", "desktop", "bing", "organic"),
    ], "request_id string, region string, category string, source string, medium string")
    for most in (1000, 0):
        res = {r.request_id: r.resolved for r in resolve_cold_start(req, table, defaults, broadcast_rows=most).collect()}
        assert res["r1"].match_level == "region+category+source" and res["r1"].cluster == 1
        assert res["r2"].match_level == "region+source"
        assert res["r3"].source == K.SOURCE_GLOBAL and res["r3"].cluster == 1
        assert res["r4"].cluster == 2 and res["r4"].avg_revenue == 300.0
        # top category falls back to the global one when the group has none
        assert res["r4"].top_category == "X"


def _catalog(spark):
    rows = [("1", "Shoe A", "Shoes", None, 1), ("2", "Shoe B", "Shoes", "", 2), ("3", "Hat", "Accessories", None, 3),
            ("4", "Hat", "Accessories", "Caps", 4), ("5", "Desk", "Furniture", None, 5),
            ("3", "Hat v2", "Accessories", None, 6)]
    return spark.createDataFrame(rows, "id string, name string, category string, display_category string, "
                                       "catalog_pos long").withColumn("price", F.lit(1.0)).withColumn(
        "image_url", F.lit("x")).withColumn("subcategory", F.lit(None).cast("string")).withColumn(
        "description", F.lit(""))


def test_lookup_by_id_then_first_name(spark):
    cat = _catalog(spark)
    refs = spark.createDataFrame([("3",), ("Hat",), ("nope",), ("Shoe B",)], "ref string")
    got = {r.ref: (r.item_id, r.item_display_category) for r in lookup_items(refs, cat, "ref").collect()}
    # duplicate id 3: last row wins (name 'Hat v2'); 'Hat' by name -> first remaining item named Hat (id 4)
    assert got["3"] == ("3", "Accessories")
    assert got["Hat"] == ("4", "Caps")
    assert got["nope"] == (None, None)
    assert got["Shoe B"] == ("2", "Shoes")


def test_product_picks(spark):
    cat = _catalog(spark)
    ranked = rank_catalog(cat)
    counts = category_counts(cat)
    req = spark.createDataFrame([("r1", "Shoes", []), ("r2", "Nowhere", []), ("r3", "Shoes", ["1"])],
                                "request_id string, cat string, ex array<string>")
    got = {r.request_id: r.products for r in product_picks(req, ranked, "cat", 4, "t", "ex", counts=counts).collect()}
    assert sorted(got["r1"]) == ["1", "2"]
    assert len(got["r2"]) == 4 and len(set(got["r2"])) == 4   # whole catalog (5 distinct ids)
    assert got["r3"] == ["2"]


def test_modules_exclude_primary_when_single_category(spark):
    cat = _catalog(spark).where("category = 'Shoes'")
    req = spark.createDataFrame([("r1", "Shoes", "Shoes")], "request_id string, target_category string, "
                                                          "secondary_category string")
    out = module_picks(req, rank_catalog(cat), counts=category_counts(cat)).first()
    assert sorted(out.primary_products) == ["1", "2"] and out.secondary_products == []


def test_target_category_seeded_when_none_valid(spark):
    cat = _catalog(spark)
    req = spark.createDataFrame([("r1", ["Shoes", None, "ZZZ"]), ("r2", []), ("r3", ["ZZZ"])],
                                "request_id string, c array<string>")
    out = {r.request_id: r.target_category for r in target_category(req, category_counts(cat), "c").collect()}
    names = {r.category for r in category_counts(cat).collect()}
    assert out["r1"] == "Shoes" and out["r2"] in names and out["r3"] in names


def test_recent_buffer_keeps_last_twenty(spark):
    ev = spark.range(25).select(F.lit("u").alias("user_pseudo_id"), F.col("id").alias("event_id"),
                                F.timestamp_seconds(F.col("id")).alias("event_ts"))
    out = recent_events(ev).orderBy("position").collect()
    assert [r.event_id for r in out] == list(range(5, 25)) and out[0].position == 1


def test_valid_events(spark):
    logs = spark.createDataFrame([
        ("u1", '[{"event_name":"view_item","item_name":"a"},{"event_name":"view_item","item_name":5},'
               '{"event_name":"page_view","item_name":"b"}]'),
        ("u2", '[{"event_name":"view_item"'), ("u3", '{"event_name":"view_item","item_name":"a"}')],
        "user_pseudo_id string, log string")
    got = [(r.user_pseudo_id, r.seq, r.item_name) for r in valid_events(logs).collect()]
    assert got == [("u1", 0, "a")]


def test_unique_id_chains(spark):
    files = spark.createDataFrame([("b.jpg",), ("b.png",), ("b_2.png",), ("c.png",), ("c.gif",), ("c.JPEG",),
                                   ("d-2.png",), ("d.png",), ("notes.txt",)], "path string")
    got = {r.filename: r.id for r in unique_ids(image_listing(files)).collect()}
    assert got == {"b.jpg": "B", "b.png": "B-2", "b_2.png": "B-2-2", "c.JPEG": "C", "c.gif": "C-2",
                   "c.png": "C-3", "d-2.png": "D-2", "d.png": "D"}


def test_cascade_thresholds(spark):
    df = spark.createDataFrame([
        ([0.65, 0.35], [0.1, 0.9], None),
        ([0.6499, 0.3501], [0.1, 0.9], None),
        ([0.9, 0.1], [0.5, 0.5], [0.10, 0.90]),
        ([0.9, 0.1], [0.5, 0.5], [0.0999, 0.9001]),
    ], "mlp_prob array<double>, rf_prob array<double>, seq_prob array<double>")
    got = [(r.cascade_cluster, r.cascade_source) for r in cascade(df).collect()]
    assert got == [(0, "deep_model"), (1, "random_forest_fallback"), (0, "deep_model"), (1, "lstm_override")]


def test_merge_small_clusters(spark):
    rows = [(i, float(i % 3), 0.0, 0) for i in range(100)] + [(100 + i, 10.0, 0.0, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, x double, y double, cluster int")
    out = merge_small_clusters(df, ["x", "y"], "cluster")
    assert out.where("merged = 1").count() == 0
    rows = [(i, 0.0, 0.0, 0) for i in range(5)] + [(10 + i, 1.0, 0.0, 1) for i in range(6)]
    out = merge_small_clusters(spark.createDataFrame(rows, "id long, x double, y double, cluster int"), ["x", "y"],
                               "cluster")
    assert out.where("merged != cluster").count() == 0


def test_lookup_tables_roundtrip_and_absent(spark, tmp_path):
    from tailorspark.operators.coldstart import load_lookup_tables, save_lookup_tables

    users = _users(spark)
    act = spark.createDataFrame([("X",)], "ItemCategory string")
    table = coldstart_table(users, act, min_support=10)
    defaults = spark.createDataFrame([("X", 1)], "global_top_category string, global_cluster int")
    save_lookup_tables(str(tmp_path / "lk"), table, defaults)
    t2, d2, n2 = load_lookup_tables(spark, str(tmp_path / "lk"))
    assert t2.count() == table.count() and d2.first().global_cluster == 1
    assert [r.segment_name for r in n2.orderBy("target_cluster").collect()][0] == "repeat_purchaser"
    t3, d3, _ = load_lookup_tables(spark, str(tmp_path / "missing"))
    req = spark.createDataFrame([("r1", "EU", "mobile", "google", "cpc")],
                                "request_id string, region string, category string, source string, medium string")
    r = resolve_cold_start(req, t3, d3).first().resolved
    assert r.source == K.SOURCE_GLOBAL and r.cluster == 0 and r.top_category == K.GLOBAL_TOP_CATEGORY


def test_recency_winner(spark):
    from tailorspark.operators.catalog import recency_winner

    cat = _catalog(spark)
    req = spark.createDataFrame([
        ("r1", ["Shoes", "Furniture", "Shoes", "Mars", None, ""]),
        ("r2", ["Furniture"] + ["Shoes"] * 9),
        ("r3", []), ("r4", None)], "request_id string, c array<string>")
    got = {r.request_id: r.recency for r in recency_winner(req, category_counts(cat), "c", base=1.0).collect()}
    assert got["r3"] is None and got["r4"] is None
    assert got["r1"].category == "Shoes" and got["r1"].score == 2.0 and got["r2"].category == "Shoes"


def test_many_categories(spark):
    """5,000 categories: the target and the second category follow from plain positions."""
    from tailorspark.operators.catalog import secondary_category, seeded_int, target_category

    cats = spark.range(5000).select(F.format_string("c%05d", "id").alias("category"), F.lit(1).alias("m"))
    req = spark.range(300).select(F.concat(F.lit("r"), "id").alias("request_id"), F.when(
        F.col("id") % 2 == 0, F.array(F.format_string("c%05d", F.col("id") * 7))).alias("c"))
    out = secondary_category(target_category(req, cats, "c"), cats)
    out = out.withColumns({"t": seeded_int(F.lit("target"), F.col("request_id")),
                           "s": seeded_int(F.lit("secondary"), F.col("request_id"))}).collect()
    for r in out:
        i = int(r.c[0][1:]) if r.c else r.t % 5000
        assert (r.target_category, r.secondary_category) == (f"c{i:05d}", f"c{(i + 1 + r.s % 4999) % 5000:05d}")


def test_listed_rows_with_repeated_ids(spark):
    from tailorspark.operators.catalog import products_by_category

    cat = spark.createDataFrame([("1", "a", "Shoes"), ("1", "b", "Shoes"), ("2", "c", None)], "id string, name string, category string")
    want = spark.createDataFrame([("Shoes",), ("Unknown",)], "category string")
    got = products_by_category(cat, want).select("id", "name", "category")
    assert sorted(map(tuple, got.collect())) == [("1", "a", "Shoes"), ("1", "b", "Shoes"), ("2", "c", "Unknown")]


def test_unnamed_events_keep_their_place(spark):
    from tailorspark.operators.features import event_positions, event_sequences

    act = spark.createDataFrame([("u", 1, "view", 10), ("u", 2, None, 20), ("u", 3, "purchase", 30), (None, 4, "view", 40)],
                                "user_pseudo_id string, event_id long, event_name string, s long")
    act = act.withColumn("event_ts", F.timestamp_seconds("s")).drop("s")
    r = event_sequences(act).first()
    assert (r.n_events, r.first_ids, r.last_ids) == (3, [2, 0, 1], [2, 0, 1])
    got = sorted((x.position, x.event_id, x.event_index, x.n_events) for x in event_positions(act).collect())
    assert got == [(0, 1, 2, 3), (1, 2, 0, 3), (2, 3, 1, 3)]


def test_split_is_exact_in_every_class(spark):
    from tailorspark.operators.evaluate import stratified_split

    rows = [(f"u{c}-{k}", c) for c in range(30) for k in range(10)] + [(f"big{k}", 99) for k in range(1003)] + [("one", 50)]
    out = stratified_split(spark.createDataFrame(rows, "user_pseudo_id string, target_cluster int"))
    got = {r.target_cluster: (r.v, r.n) for r in out.groupBy("target_cluster").agg(
        F.count_if("is_validation").alias("v"), F.count("*").alias("n")).collect()}
    assert got == {**{c: (2, 10) for c in range(30)}, 99: (201, 1003), 50: (0, 1)}


def test_catalog_from_json(spark, tmp_path):
    import json

    from tailorspark.sources.catalog import load_catalog

    items = [{"id": "1", "name": "a", "category": "Shoes", "price": 1.5}, {"id": "2", "name": "b"}]
    (tmp_path / "c.json").write_text(json.dumps(items, indent=1))
    got = load_catalog(spark, str(tmp_path / "c.json"), array=True).orderBy("catalog_pos").collect()
    assert [(r.id, r.category, r.price) for r in got] == [("1", "Shoes", 1.5), ("2", "Unknown", None)]


def test_no_folder_on_a_cluster():
    from types import SimpleNamespace

    from tailorspark import session

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: "yarn" if k == "spark.master" else
                                                   "" if "Rules" in k else d, set=lambda k, v: None),
                              sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(cluster)


def test_metrics_match_mllib_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from tailorspark.operators import evaluate as E

    rows = [(i % 5, (i * 7) % 5 if i % 3 else i % 5) for i in range(500)] + [(0, 4)] * 20
    df = spark.createDataFrame(rows, "label int, prediction int")
    m = E.metrics(E.confusion(df)).first()
    d = df.select(F.col("label").cast("double"), F.col("prediction").cast("double"))
    acc = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(d)
    f1 = MulticlassClassificationEvaluator(metricName="weightedFMeasure").evaluate(d)
    assert abs(m.accuracy - acc) < 1e-12 and abs(m.f1_weighted - f1) < 1e-12


def test_hot_user_holding_a_third_of_events(spark):
    from tailorspark.operators.features import event_sequences

    n_hot, n_cold = 3000, 6000
    ev = spark.range(n_hot + n_cold).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") < n_hot, F.lit("HOT")).otherwise(F.concat(F.lit("u"), F.col("id").cast("string")))
        .alias("user_pseudo_id"),
        F.when(F.col("id") % 3 == 0, "purchase").otherwise("view_item").alias("event_name"),
        F.concat(F.lit("page_"), (F.col("id") % 10).cast("string")).alias("page_type"),
        F.when(F.col("id") % 3 == 0, F.lit(1.0)).alias("purchase_revenue"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("event_ts"),
    )
    roll = {r.user_pseudo_id: r for r in user_rollup(ev, "2024-02-15 00:00:00").where(
        "user_pseudo_id IN ('HOT', 'u3000')").collect()}
    assert roll["HOT"].total_events == n_hot and roll["HOT"].unique_pages == 10
    assert roll["HOT"].num_purchases == n_hot // 3 and roll["HOT"].total_revenue == float(n_hot // 3)
    seqs = {r.user_pseudo_id: r for r in event_sequences(ev).where("user_pseudo_id = 'HOT'").collect()}
    hot = seqs["HOT"]
    assert hot.n_events == n_hot and len(hot.first_names) == 25 and len(hot.last_names) == 25
    assert hot.first_names[0] == "purchase" and hot.last_names[-1] == ("purchase" if (n_hot - 1) % 3 == 0
                                                                        else "view_item")
    last = recent_events(ev.where("user_pseudo_id = 'HOT'")).orderBy("position").collect()
    assert [r.event_id for r in last] == list(range(n_hot - 20, n_hot))


def test_activity_loader_time_fallback(spark, tmp_path):
    from tailorspark.sources.activity import load_activity

    a = tmp_path / "act.csv"
    a.write_text("event_id,user_pseudo_id,event_name,page_type,eventTimestamp,timestamp,category,region,country,"
                 "source,medium,Age,ItemCategory,transaction_id\n"
                 "1,u1,purchase,p,2024-02-10 00:00:00,,mobile,EU,DE,google,cpc,18-24,X,T1\n"
                 "2,u2,view_item,p,,2024-02-01 12:00:00,desktop,EU,DE,,,18-24,,\n"
                 "3,u3,view_item,p,not a time,,desktop,EU,DE,,,18-24,,\n")
    t = tmp_path / "tr.csv"
    t.write_text("transaction_id,purchase_revenue\nT1,12.5\n")
    df = load_activity(spark, str(a), str(t))
    users = {r.user_pseudo_id: r for r in user_rollup(df, "2024-02-15 00:00:00").collect()}
    assert users["u1"].days_since_first_visit == 5 and users["u1"].total_revenue == 12.5
    assert users["u2"].days_since_first_visit == 13
    assert users["u3"].days_since_first_visit == 365 and users["u3"].source == "unknown"


def test_normalize_malformed_responses(spark):
    from tailorspark.operators.pages import normalize_responses

    logs = spark.createDataFrame([
        ("a", '{"product_modules": "nope"}'),
        ("b", 'not json'),
        ("c", '{"hero_section": {"hero_section": {"title": "T", "subtitle": "S", "cta": "C"}, '
              '"product_modules": [{"title": "M", "products": ["1"]}], '
              '"personalization_details": {"predicted_segment": 2, "assigned_business_tags": ["x"]}}}'),
    ], "request_id string, response string")
    out = {r.request_id: r for r in normalize_responses(logs).collect()}
    for k in ("a", "b"):
        assert out[k].hero_section.title == "Welcome to UltraPersonal." and out[k].product_modules == []
        assert out[k].personalization_details.predicted_segment == 0
        assert out[k].personalization_details.assigned_business_tags == ["fallback_mode"]
    assert out["c"].hero_section.title == "T" and out["c"].product_modules[0].title == "M"
    assert out["c"].personalization_details.predicted_segment == 2


def test_rows_without_a_transaction_pass_the_join_by(spark, tmp_path):
    """99 % of the rows have no transaction id: none of them is shuffled, and no task has them all."""
    from tailorspark.sources.activity import load_activity

    n = 20_000
    rows = spark.range(0, n, 1, 8)
    rows.select(F.col("id").alias("event_id"), F.concat(F.lit("u"), "id").alias("user_pseudo_id"),
                F.when(F.col("id") % 100 == 0, F.concat(F.lit("T"), "id")).alias("transaction_id")).write.parquet(f"{tmp_path}/a")
    rows.where("id % 100 = 0").select(F.concat(F.lit("T"), "id").alias("transaction_id"),
                                      F.col("id").cast("double").alias("purchase_revenue")).write.parquet(f"{tmp_path}/t")
    df = load_activity(spark, f"{tmp_path}/a", f"{tmp_path}/t", "parquet")
    r = df.agg(F.count("*"), F.count("purchase_revenue"), F.sum((F.col("purchase_revenue") == F.col("event_id")).cast("int"))).first()
    assert tuple(r) == (n, n // 100, n // 100)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        assert max(sizes) <= 2 * (n / 8)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_backoff_join_is_chosen_by_the_size_of_the_table(spark):
    users = _users(spark)
    act = spark.createDataFrame([("X",)], "ItemCategory string")
    table = coldstart_table(users, act, min_support=10)
    defaults = spark.createDataFrame([("X", 1)], "global_top_category string, global_cluster int")
    req = spark.createDataFrame([(i, "EU", "mobile" if i % 2 else "tablet", "google", "cpc") for i in range(20)],
                                "request_id int, region string, category string, source string, medium string")
    plans, found = [], []
    for most in (1000, 1):
        got = resolve_cold_start(req, table, defaults, broadcast_rows=most)
        found.append(sorted((r["request_id"], r["resolved"]) for r in got.collect()))
        plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert found[0] == found[1]
    assert plans[0].count("BroadcastHashJoin") >= 9 and "Generate explode" not in plans[0]
    assert "Generate explode" in plans[1]
