"""Model stack properties: gate, beats the baseline, save/load equality."""

import math
import random
import tempfile

import duckdb
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tailorspark.operators import evaluate as E
from tailorspark.operators import models as M
from tailorspark.operators.calibration import fit_curves
from tailorspark.operators.sequence import fit_sequence_model, sequence_probability, transitions
from tailorspark.operators.features import event_sequences
from tailorspark.operators.segments import training_frame
from tailorspark.sources.tables import AS_OF, activity
from conftest import SF_SMALL


def test_gate_rejects_tiny(spark):
    users = training_frame(activity(spark, SF_SMALL, "user"), AS_OF)  # 15 users
    assert M.train_stack(E.stratified_split(users)) is None


def test_stack_trains_scores_and_roundtrips(spark):
    act = activity(spark, SF_SMALL, "visit")
    users = E.stratified_split(training_frame(act, AS_OF)).checkpoint()
    seqs = event_sequences(act).select("user_pseudo_id", F.col("first_names").alias("seq_tokens"))
    stack = M.train_stack(users, seqs)
    assert stack is not None and 2 <= stack.k <= 5
    val = users.where("is_validation").join(seqs, "user_pseudo_id", "left")
    scored = M.cascade(M.score(val, stack, "seq_tokens"))
    r = scored.agg(F.min("cascade_confidence"), F.max("cascade_confidence"), F.count("*")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0 and r[2] > 0
    acc = scored.agg(F.avg((F.col("cascade_cluster") == F.col("target_cluster")).cast("double"))).first()[0]
    base = E.majority_baseline(users, "target_cluster").first().accuracy
    assert acc >= base
    path = tempfile.mkdtemp(prefix="ts-models-")
    M.save_stack(stack, path)
    again = M.load_stack(spark, path)
    b = M.cascade(M.score(val, again, "seq_tokens"))
    j = scored.select("user_pseudo_id", "cascade_cluster").join(
        b.select("user_pseudo_id", F.col("cascade_cluster").alias("c2")), "user_pseudo_id")
    assert j.where("cascade_cluster != c2").count() == 0
    # one forest on the whole split, beside the calibrated folds, survives the round trip
    assert len(stack.calibrated) == 3 and stack.forest.getNumTrees == 200
    feats = M.prepare_features(val, stack)
    one, two = (M.forest_probability(feats, s).select("user_pseudo_id", "forest_prob") for s in (stack, again))
    assert one.exceptAll(two).count() == 0
    for p in ("rf_prob", "mlp_prob", "seq_prob"):
        off = scored.where(F.col(p).isNotNull()).select(F.max(F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1)))
        assert off.first()[0] < 1e-9


def test_calibration_curves_are_the_best_ones(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        label, x = i % 3, rng.random()
        p = [0.2, 0.3, 0.1]
        p[label] = 0.2 + 0.8 * x
        rows.append((i % 2, label, p))
    rows += [(0, 3, [0.0, 0.0, 0.0, 1.0][:3])]
    scores = spark.createDataFrame([(f, c, p + [1.0 if c == 3 else 0.0]) for f, c, p in rows],
                                   "fold int, label int, p array<double>")
    curves = fit_curves(scores, 4)
    assert curves[1, 3] == (0.0, -30.0)  # no such row in this fold

    def loss(fold, c, a, b):
        of = [(x[c] if c < 3 else float(k == 3), k == c) for f, k, x in rows if f == fold]
        n = sum(hit for _, hit in of)
        hi, lo = (n + 1) / (n + 2), 1 / (len(of) - n + 2)
        return sum(math.log1p(math.exp(a * x + b)) - (hi if hit else lo) * (a * x + b) for x, hit in of)

    for (fold, c), (a, b) in curves.items():
        if (fold, c) == (1, 3):
            continue
        at = loss(fold, c, a, b)
        for da in (-0.05, 0, 0.05):
            for db in (-0.05, 0, 0.05):
                assert loss(fold, c, a + da, b + db) >= at - 1e-6


def test_kmeans_takes_the_cheapest_start(spark):
    rng = random.Random(2)
    pts = [(Vectors.dense([cx + rng.gauss(0, 0.2), cy + rng.gauss(0, 0.2)]),) for cx, cy in
           [(0, 0), (0, 3), (5, 0), (5, 3), (9, 9)] for _ in range(40)]
    df = spark.createDataFrame(pts, ["v"]).repartition(2).checkpoint()
    model, cost, costs = M.kmeans_starts(df, "v", 5, 4, seed=1)
    assert cost == min(costs) and len(costs) == 4
    # the cost again, from the centres and the stored points alone
    points = df.select(vector_to_array("v").alias("v")).toPandas()
    points["x"], points["y"] = points["v"].str[0], points["v"].str[1]
    points = points[["x", "y"]]
    con = duckdb.connect()
    con.register("points", points)
    con.execute("CREATE TABLE centres (x DOUBLE, y DOUBLE)")
    con.executemany("INSERT INTO centres VALUES (?, ?)", [tuple(map(float, c)) for c in model.clusterCenters()])
    again = con.execute("SELECT sum(d) FROM (SELECT min((p.x - c.x) ** 2 + (p.y - c.y) ** 2) AS d FROM "
                        "(SELECT row_number() OVER () AS i, * FROM points) p, centres c GROUP BY i)").fetchall()[0][0]
    assert abs(again - cost) < 1e-6 * max(1, cost)


def test_sequence_steps_and_probabilities(spark):
    seqs = spark.createDataFrame([(f"u{i}", ["view", "buy"] if i % 2 else ["buy", "view", "view"], i % 2) for i in range(30)]
                                 + [("e", [], 1)], "user_pseudo_id string, seq_tokens array<string>, label int")
    steps = [tuple(r) for r in transitions(seqs.where("user_pseudo_id = 'u0'"), "seq_tokens", "user_pseudo_id").collect()]
    assert steps == [("u0", "^", "buy#1"), ("u0", "buy#1", "view#1"), ("u0", "view#1", "view#2"), ("u0", "view#2", "$")]
    model = fit_sequence_model(seqs, 2)
    assert model.n_steps == 4 and sum(model.shares) == 1.0
    new = spark.createDataFrame([("p", ["view", "buy"]), ("q", ["buy", "view"]), ("r", []), ("s", ["odd"]), ("t", None)],
                                "user_pseudo_id string, seq_tokens array<string>")
    got = {r[0]: r["seq_prob"] for r in sequence_probability(new, model, "seq_tokens", "user_pseudo_id").collect()}
    assert got["p"][1] > 0.9 and got["q"][0] > 0.9 and got["r"] is None and got["t"] is None
    assert abs(sum(got["s"]) - 1) < 1e-12
    # by hand: ^ -> view#1 -> buy#1 -> $ under class 1 and class 0
    a, v = model.smoothing, 4
    ll = [math.log(sh) + sum(math.log((n + a) / (m + a * v)) for n, m in pairs) for sh, pairs in zip(
        model.shares, [[(0, 15), (0, 15), (0, 15)], [(15, 15), (15, 15), (15, 15)]])]
    assert abs(got["p"][1] - 1 / (1 + math.exp(ll[0] - ll[1]))) < 1e-8
    assert fit_sequence_model(seqs.limit(5), 2) is None and fit_sequence_model(seqs.where("label = 1"), 2) is None


def test_evaluation_recomputed_by_sql(spark):
    rng = random.Random(3)
    rows = [(m, rng.randrange(4), rng.randrange(5), rng.choice(["a", "b"]) if m == "x" else None)
            for m in ("x", "y") for _ in range(300)]
    df = spark.createDataFrame(rows, "model string, label int, prediction int, source string")
    got = {tuple(r)[:4]: r["value"] for r in E.evaluation(df).collect()}
    con = duckdb.connect()
    con.register("p", df.toPandas())
    for m in ("x", "y"):
        acc, n = con.execute(f"SELECT avg((label = prediction)::INT), count(*) FROM p WHERE model = '{m}'").fetchall()[0]
        assert got[m, "all", "", "n"] == n and abs(got[m, "all", "", "accuracy"] - acc) < 1e-12
        weighted = 0.0
        for c in range(5):
            tp, sup, pred = con.execute(
                f"SELECT count(*) FILTER (WHERE label = {c} AND prediction = {c}), count(*) FILTER (WHERE label = {c}), "
                f"count(*) FILTER (WHERE prediction = {c}) FROM p WHERE model = '{m}'").fetchall()[0]
            pr, rc = tp / pred if pred else 0.0, tp / sup if sup else 0.0
            f1 = 2 * pr * rc / (pr + rc) if pr + rc else 0.0
            weighted += f1 * sup / n
            for k, want in (("precision", pr), ("recall", rc), ("f1", f1), ("support", sup)):
                assert abs(got[m, "class", str(c), k] - want) < 1e-12
        assert abs(got[m, "all", "", "f1_weighted"] - weighted) < 1e-12
    shares = {k[2]: v for k, v in got.items() if k[1] == "source" and k[3] == "share"}
    assert set(shares) == {"a", "b"} and abs(sum(shares.values()) - 1) < 1e-12
    assert not [k for k in got if k[0] == "y" and k[1] == "source"]


def test_fits_read_rows_of_one_label_in_many_tasks(spark, monkeypatch):
    class Seen(Exception):
        pass

    def see(train, *_):
        raise Seen(train.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first())

    monkeypatch.setattr(M, "fit_forest", see)
    rows = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("user_pseudo_id"),
                                    (F.col("id") % 50 == 0).cast("double").alias("label"))
    try:
        M.fit_calibrated_forest(rows, 2, 2, 1, 2)
        raise AssertionError("no forest was fitted")
    except Seen as e:
        largest, total = e.args[0]
    tasks = spark.sparkContext.defaultParallelism
    assert total == 2000 and largest <= total if tasks == 1 else largest < 2.5 * total / tasks


def test_a_forest_takes_its_share_of_the_tasks(spark, monkeypatch):
    tasks = spark.sparkContext.defaultParallelism
    rows = spark.range(4000).repartition(2 * tasks).checkpoint()
    few = M._in_fewer_tasks(rows)
    assert few.rdd.getNumPartitions() == -(-tasks // M.FORESTS_AT_ONCE) and few.count() == 4000
    monkeypatch.setattr(M, "FOREST_ROWS", 4000 // (2 * tasks))  # large for it: as many tasks as before
    assert M._in_fewer_tasks(rows).rdd.getNumPartitions() == 2 * tasks


def test_model_inputs_read_the_events_once(spark, monkeypatch):
    from tailorspark.plans import q_models as Q

    seen, frame, sequences = [], Q.training_frame, Q._sequences
    monkeypatch.setattr(Q, "_FITTED", {})
    monkeypatch.setattr(Q, "training_frame", lambda act, *a, **k: seen.append(act) or frame(act, *a, **k))
    monkeypatch.setattr(Q, "_sequences", lambda act: seen.append(act) or sequences(act))
    users, seqs = Q.model_inputs(spark, SF_SMALL)
    assert users.count() == seqs.count() > 0
    assert len(seen) == 2 and not any("events.parquet" in f for act in seen for f in act.inputFiles())


def _with_slots(spark, rows):
    """Rows (label, x, value) with ``features``: the number and the value's one-hot slots."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    df = spark.createDataFrame(rows, "label double, x double, v string")
    return Pipeline(stages=[
        StringIndexer(inputCol="v", outputCol="i", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=["i"], outputCols=["o"], dropLast=False),
        VectorAssembler(inputCols=["x", "o"], outputCol="features")]).fit(df).transform(df).select("label", "features")


def test_a_forest_takes_slots_as_numbers_and_is_the_same(spark):
    from pyspark.ml.classification import RandomForestClassifier
    r = random.Random(3)
    rows = [(float((v in "ab") + (x > 0.5) * (v == "c")), x, v) for x, v in (
        (r.random(), r.choice("abcd")) for _ in range(400))]
    train = _with_slots(spark, rows).coalesce(1)
    assert train.schema["features"].metadata["ml_attr"]["attrs"].get("binary")
    numbers = M._slots_as_numbers(train)
    assert set(numbers.schema["features"].metadata["ml_attr"]["attrs"]) == {"numeric"}
    args = dict(numTrees=5, maxDepth=4, seed=7, labelCol="label", featuresCol="features", maxMemoryInMB=1024)
    plain = RandomForestClassifier(**args).fit(train)
    ours = M.fit_forest(train, 5, 4, 7)
    assert "not in {" not in ours.toDebugString and "in {" in plain.toDebugString
    both = [[x[0] for x in m.transform(train).select(vector_to_array(p)).collect()]
            for m, p in ((plain, "probability"), (ours, "rf_probability"))]
    assert both[0] == both[1]


def test_a_forest_splits_on_slots_that_a_sample_may_miss(spark):
    """Of 12,000 rows 12 decide their label by a slot of their own, and all but 60 share another one."""
    rows = [(2.0, 0.5, "rare")] * 12 + [(1.0, 0.5, "few")] * 48 + [(0.0, 0.5, "most")] * 11940
    train = _with_slots(spark, rows)
    attrs = M._slots_as_numbers(train).schema["features"].metadata["ml_attr"]["attrs"]
    assert len(attrs["numeric"]) == 2  # x and "few"
    assert [a["num_vals"] for a in attrs["nominal"]] == [M.ORDERED_KINDS] * 2
    forest = M.fit_forest(train, 3, 4, 1)
    wrong = forest.transform(train).where(F.col("rf_prediction") != F.col("label")).count()
    assert wrong == 0
