"""Forests and network of large splits: the same trees, steps and scores as MLlib's where nothing is drawn."""

import random
import tempfile

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tailorspark.operators import evaluate as E
from tailorspark.operators import forest as FO
from tailorspark.operators import models as M
from tailorspark.operators import network as N
from tailorspark.operators.features import event_sequences
from tailorspark.operators.segments import training_frame
from tailorspark.sources.tables import AS_OF, activity


def _rows(n: int, seed: int):
    r = random.Random(seed)
    x = np.array([[r.gauss(0, 1), float(r.random() < 0.3)] for _ in range(n)])
    y = np.array([int(a > 0.3) + int(b > 0 and a < 1) + int(r.random() < 0.1) for a, b in x])
    return x, y


def test_a_tree_is_mllibs(spark):
    x, y = _rows(900, 5)
    coding = FO.Coding([0], [FO.cut_points(x[:, 0])], [(1, 1)])  # sqrt(2) features are both: no draw of features
    made = FO.grow(coding.codes(x), y, coding.sizes, 1, 4, 6, np.random.default_rng(0), np.ones(len(y), np.uint8))
    ours = FO.Forest([made], coding, 2, 4).score(x)
    df = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x.tolist(), y)], ["label", "features"]).coalesce(1)
    tree = DecisionTreeClassifier(maxDepth=6, maxBins=32).fit(df)
    theirs = np.array([r[0] for r in tree.transform(df).select(vector_to_array("probability")).collect()])
    assert len(coding.cuts[0]) == 31 and tree.numNodes == len(made["left"])
    assert np.abs(ours[:, :theirs.shape[1]] - theirs).max() < 1e-6


def test_weights_count_as_repeated_rows_and_turns_change_nothing(spark, monkeypatch):
    x, y = _rows(400, 8)
    coding = FO.Coding([0, 1], [FO.cut_points(x[:, 0]), FO.cut_points(x[:, 1])], [])
    w = np.random.default_rng(3).poisson(1.0, len(y)).astype(np.uint8)
    one = FO.grow(coding.codes(x), y, coding.sizes, 2, 4, 8, np.random.default_rng(0), w)
    again = np.repeat(np.arange(len(y)), w)
    two = FO.grow(coding.codes(x[again]), y[again], coding.sizes, 2, 4, 8, np.random.default_rng(0), np.ones(len(again), np.uint8))
    monkeypatch.setattr(FO, "CHUNK", 7)
    monkeypatch.setattr(FO, "CELLS", 300)  # a node or two at a time
    three = FO.grow(coding.codes(x), y, coding.sizes, 2, 4, 8, np.random.default_rng(0), w)
    assert len(one["left"]) > 10
    for k in one:
        assert np.array_equal(one[k], two[k]) and np.array_equal(one[k], three[k])


def test_codes_of_rows_unlike_any_in_the_sample():
    coding = FO.Coding([0], [[0.5, 2.0]], [(1, 3), (4, 0)])
    x = np.array([[0.5, 0, 0, 0], [0.6, 0, 1, 0], [9.0, 0, 0, 1], [float("nan"), 1, 0, 0]])
    assert coding.codes(x).tolist() == [[0, 1, 2, 2], [3, 1, 2, 0], [0, 0, 0, 0]]
    assert FO.cut_points(np.array([1.0, 1.0])) == [] and FO.cut_points(np.array([])) == []
    made = FO.grow(coding.codes(x), np.zeros(4, int), coding.sizes, 1, 2, 3, np.random.default_rng(0))
    assert len(made["left"]) == 1  # one class: a leaf


def test_the_network_is_mllibs(spark):
    r = random.Random(2)
    rows = []
    for _ in range(640):
        a, b, k = r.gauss(0, 1), r.gauss(0, 1), r.randrange(4)
        rows.append((float((a > 0) + (b + k > 1)), Vectors.dense([a, *[float(k == j) for j in range(3)], b])))
    df = spark.createDataFrame(rows, ["label", "features"]).coalesce(1).checkpoint()
    mlp = MultilayerPerceptronClassifier(layers=[5, 8, 6, 3], seed=4, maxIter=25, blockSize=64)
    theirs, ours = mlp.fit(df), N.fit_network(df, mlp, FO.Coding([0, 4], [[], []], [(1, 3)]))
    assert np.abs(theirs.weights.toArray() - ours.weights.toArray()).max() < 1e-6
    p, q = ([x[0] for x in m.transform(df).select(vector_to_array("probability")).collect()] for m in (theirs, ours))
    assert np.abs(np.array(p) - np.array(q)).max() < 1e-6


def test_a_large_split_fits_here_and_roundtrips(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("a forest of a large split was left to MLlib")

    act = activity(spark, SF_SMALL, "visit")
    users = E.stratified_split(training_frame(act, AS_OF)).checkpoint()
    seqs = event_sequences(act).select("user_pseudo_id", F.col("first_names").alias("seq_tokens"))
    monkeypatch.setattr(M, "FEWEST_ROWS", 1)
    monkeypatch.setattr(M, "fit_forest", never)
    stack = M.train_stack(users, seqs, num_trees=9, max_depth=5, mlp_iter=8)
    assert len(stack.calibrated) == 3 and stack.forest.getNumTrees == 9
    assert all(f.getNumTrees == 9 for f, _ in stack.calibrated)
    scored = M.score(users, stack).select("user_pseudo_id", "mlp_prob", "rf_prob")
    path = tempfile.mkdtemp(prefix="ts-models-")
    M.save_stack(stack, path)
    again = M.score(users, M.load_stack(spark, path)).select("user_pseudo_id", F.col("rf_prob").alias("p"), F.col("mlp_prob").alias("q"))
    both = scored.join(again, "user_pseudo_id").collect()
    assert len(both) == users.count() and all(r["rf_prob"] == r["p"] and r["mlp_prob"] == r["q"] for r in both)
    assert all(abs(sum(r["rf_prob"]) - 1) < 1e-9 for r in both)
    labelled = M.forest_probability(M.prepare_features(users, stack), stack).select(
        "target_cluster", M._argmax(F.col("forest_prob")).alias("p")).where("not is_validation")
    hits = labelled.agg(F.avg((F.col("p") == F.col("target_cluster")).cast("double"))).first()[0]
    assert hits > E.majority_baseline(users, "target_cluster").first().accuracy


def test_validation_rows_are_dealt_to_all_tasks(spark, monkeypatch):
    from tailorspark.plans import q_models as Q

    monkeypatch.setattr(Q, "_FITTED", {})
    val = Q._validation(spark, SF_SMALL)
    assert val.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert val.count() == Q.model_inputs(spark, SF_SMALL)[0].where("is_validation").count()
