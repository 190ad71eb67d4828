"""Feature preparation and the classifier stack (M1-M12) on MLlib.

Layout of a feature vector: [numeric (log-transformed) | one-hot context |
cluster id].  The numeric block and the cluster id are standardised with
population statistics of the training split; one-hot columns are left as
they are.  Only scalar statistics (means, deviations, the chosen k) reach
the driver; all data passes through MLlib estimators.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailorspark import constants as K
from tailorspark.functions.columns import numeric_transform
from tailorspark.operators.calibration import fit_curves
from tailorspark.operators.forest import FEWEST_ROWS, MOST_ROWS, Coding, Forest, fit_coding, fit_forests
from tailorspark.operators.network import fit_network
from tailorspark.operators.partitioning import dealt_evenly, dense_index
from tailorspark.operators.sequence import SequenceModel, fit_sequence_model, sequence_probability
from tailorspark.session import materialize, stored
from tailorspark.sources.tables import seed_col

NUM = K.NUMERIC_FEATURE_COLS
#: Fits that run at the same time: while one waits for its driver step, the tasks of the others go on.
FITS_AT_ONCE = 3
#: Forests fitted at the same time (one on the whole split, one a fold), and the fewest rows that a task of a fit
#: gets while others are free: each task sends its own statistics of all tree nodes, whatever its rows are.
FORESTS_AT_ONCE, FOREST_ROWS = 4, 250_000
#: MLlib's trees take a number's split points from a sample of about so many rows, and a nominal value of at most 5
#: kinds (at 32 bins) as unordered.
SPLIT_SAMPLE, ORDERED_KINDS = 10_000, 6


def _fit_at_once(spark, fit, over) -> list:
    """``[fit(x) for x in over]``, independent fits at the same time."""
    with ThreadPool(FITS_AT_ONCE) as pool:
        return pool.map(inheritable_thread_target(spark)(fit), over, chunksize=1)


def _timed(fit):
    """What ``fit`` gives, and its seconds."""
    t0 = time.perf_counter()
    return fit(), time.perf_counter() - t0


def _in_fewer_tasks(train: DataFrame) -> DataFrame:
    """``train`` in a forest's share of the tasks, more if it is large.  A task of a forest builds, sends and merges
    statistics of every node of a level: with few rows that is most of the work, and it grows with the tasks."""
    tasks = train.sparkSession.sparkContext.defaultParallelism
    return train.coalesce(max(1, -(-tasks // FORESTS_AT_ONCE), -(-train.count() // FOREST_ROWS)))


def _slots_as_numbers(train: DataFrame) -> DataFrame:
    """``train`` with the one-hot slots of ``features`` as the numbers 0 and 1, not as unordered categories: MLlib then
    adds up the rows in half the time, and a split at 0.5 parts them as the category's only split does.

    The split point has to be found in a sample of the rows.  A slot that may have one value only there stays a
    category, said to have so many kinds that MLlib orders them; its split is the one between 0 and 1 too.
    """
    attrs = train.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    slots = attrs.get("binary", [])
    if not slots:
        return train
    ones, rows = train.agg(Summarizer.numNonZeros(F.col("features")), F.count(F.lit(1))).first()

    def sampled(i: int) -> bool:
        # ones are counted in the sample, zeros are what the sample's expected size leaves (deviation: 1 %)
        return rows <= SPLIT_SAMPLE or (ones[i] * SPLIT_SAMPLE >= 30 * rows and (rows - ones[i]) * 10 >= rows)

    number = [a for a in slots if sampled(a["idx"])]
    kinds = [{**a, "num_vals": ORDERED_KINDS} for a in slots if not sampled(a["idx"])]
    groups = {"numeric": attrs.get("numeric", []) + number, "nominal": attrs.get("nominal", []) + kinds}
    meta = {"ml_attr": {"attrs": {k: v for k, v in groups.items() if v}, "num_attrs": len(ones)}}
    return train.withColumn("features", F.col("features").alias("features", metadata=meta))


# -- M1 ------------------------------------------------------------------------
def fit_context_encoder(users: DataFrame, cols: list[str] | None = None) -> PipelineModel:
    """One-hot of context columns: categories sorted, unseen -> all zeros.

    StringIndexer keeps unseen values at index numLabels and OneHotEncoder
    drops that last slot, so an unseen value encodes to zeros.
    """
    cols = cols or K.CONTEXT_COLS
    stages = []
    for c in cols:
        stages.append(StringIndexer(inputCol=f"_ctx_{c}", outputCol=f"_idx_{c}", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
    stages.append(OneHotEncoder(inputCols=[f"_idx_{c}" for c in cols], outputCols=[f"_oh_{c}" for c in cols],
                                dropLast=True))
    return Pipeline(stages=stages).fit(context_frame(users, cols))


def context_frame(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Context as strings, missing columns and nulls -> 'unknown'."""
    cols = cols or K.CONTEXT_COLS
    return df.withColumns({f"_ctx_{c}": F.coalesce(F.col(c).cast("string"), F.lit(K.UNKNOWN))
                           if c in df.columns else F.lit(K.UNKNOWN) for c in cols})


def encode_context(df: DataFrame, encoder: PipelineModel, cols: list[str] | None = None) -> DataFrame:
    cols = cols or K.CONTEXT_COLS
    out = encoder.transform(context_frame(df, cols))
    return out.drop(*[f"_ctx_{c}" for c in cols], *[f"_idx_{c}" for c in cols])


# -- X6 + M2 -------------------------------------------------------------------
def with_numeric(df: DataFrame) -> DataFrame:
    return df.withColumns({f"_n_{c}": numeric_transform(c) for c in NUM})


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Population mean and deviation per column (deviation 0 -> 1)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0
        out[c] = (float(m), float(s) if s and s > 0 else 1.0)
    return out


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in stats.items()})


# -- M5 ------------------------------------------------------------------------
def merge_small_clusters(df: DataFrame, feature_cols: list[str], label: str = "cluster",
                         min_frac: float = K.SMALL_CLUSTER_FRACTION, min_abs: int = K.SMALL_CLUSTER_ABS,
                         out_col: str = "merged") -> DataFrame:
    """Members of clusters smaller than max(min_abs, floor(n*min_frac)) move to
    the nearest large-cluster centroid (Euclidean; ties: smaller id);
    unchanged when there are no small or no large clusters.

    Per-cluster statistics are one row per cluster.  The large centroids
    travel as one array (at most 1/min_frac clusters are large) and each row
    takes the minimum over it; no row pairs are formed.
    """
    # one row per cluster, stored once: the statistics below reuse it
    sizes = materialize(df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"),
                                              *[F.avg(c).alias(f"_c_{c}") for c in feature_cols]))
    total = sizes.agg(F.sum("_size")).scalar()
    sizes = sizes.withColumn("_small", F.col("_size") < F.greatest(F.lit(min_abs), F.floor(total * min_frac)))
    summary = sizes.agg(F.struct(
        F.collect_list(F.when(~F.col("_small"), F.struct(F.col(label).alias("c"), *[
            F.col(f"_c_{c}").alias(f"x{i}") for i, c in enumerate(feature_cols)]))).alias("large"),
        F.collect_list(F.when(F.col("_small"), F.col(label))).alias("small_ids"))).scalar()
    out = df.withColumns({"_large": summary["large"], "_small_ids": summary["small_ids"]})

    def dist(cen):
        return F.sqrt(sum((F.col(c) - cen[f"x{i}"]) ** 2 for i, c in enumerate(feature_cols)))

    nearest = F.array_min(F.transform("_large", lambda cen: F.struct(dist(cen).alias("d"), cen["c"].alias("c"))))
    move = F.array_contains("_small_ids", F.col(label)) & (F.size("_large") > 0)
    return out.withColumn(out_col, F.when(move, nearest["c"]).otherwise(F.col(label))).drop("_large", "_small_ids")


# -- M4 ------------------------------------------------------------------------
def kmeans_starts(train: DataFrame, features: str, k: int, starts: int, seed: int, max_iter: int = 20):
    """The cheapest of ``starts`` seeded fits: (model, cost, costs by start)."""
    fits = _fit_at_once(train.sparkSession, lambda i: KMeans(
        k=k, seed=seed + i, featuresCol=features, predictionCol="_k_pred", maxIter=max_iter).fit(train), range(starts))
    costs = [m.summary.trainingCost for m in fits]
    best = min(range(starts), key=lambda i: (costs[i], i))
    return fits[best], costs[best], costs


def choose_kmeans(train: DataFrame, features: str, n_rows: int, seed: int = K.SEED,
                  max_k: int = K.KMEANS_MAX_K, starts: int = K.KMEANS_STARTS, final_starts: int = K.KMEANS_FINAL_STARTS):
    """k in 2..upper-1 (upper = min(max_k, max(3, n-1))) by silhouette over all
    training rows (linear in rows); then the final model, from more starts."""
    upper = min(max_k, max(3, n_rows - 1))
    ev = ClusteringEvaluator(featuresCol=features, predictionCol="_k_pred", metricName="silhouette")
    best_k, best = 2, -1.0
    for k in range(2, upper):
        model, _, _ = kmeans_starts(train, features, k, starts, seed)
        if sum(size > 0 for size in model.summary.clusterSizes) < 2:
            continue  # one cluster has no silhouette
        score = ev.evaluate(materialize(model.transform(train)))
        if score > best:
            best_k, best = k, score
    final, _, _ = kmeans_starts(train, features, best_k, final_starts, seed, max_iter=40)
    return final, best_k, best


# -- the stack -----------------------------------------------------------------
@dataclass
class Stack:
    encoder: PipelineModel
    cluster_stats: dict
    kmeans: object
    k: int
    feature_stats: dict
    forest: object | None
    calibrated: list = field(default_factory=list)
    mlp: object | None = None
    sequence: SequenceModel | None = None
    num_classes: int = 0
    silhouette: float = -1.0
    timings: dict = field(default_factory=dict)


def _cluster_input(df: DataFrame, stack_encoder, cluster_stats) -> DataFrame:
    out = encode_context(with_numeric(df), stack_encoder)
    out = apply_scaler(out, {f"_n_{c}": v for c, v in cluster_stats.items()}, "_ks")
    asm = VectorAssembler(inputCols=[f"_n_{c}_ks" for c in NUM] + [f"_oh_{c}" for c in K.CONTEXT_COLS],
                          outputCol="_kvec", handleInvalid="keep")
    return asm.transform(out)


def prepare_features(df: DataFrame, stack: Stack) -> DataFrame:
    """M3: the model feature vector ``features`` for any user/request frame."""
    out = _cluster_input(df, stack.encoder, stack.cluster_stats)
    out = stack.kmeans.transform(out).withColumn("_cluster_id", F.col("_k_pred").cast("double"))
    scale = {f"_n_{c}": stack.feature_stats[c] for c in NUM}
    scale["_cluster_id"] = stack.feature_stats["_cluster_id"]
    out = apply_scaler(out, scale, "_fs")
    asm = VectorAssembler(inputCols=[f"_n_{c}_fs" for c in NUM] + [f"_oh_{c}" for c in K.CONTEXT_COLS]
                          + ["_cluster_id_fs"], outputCol="features", handleInvalid="keep")
    return asm.transform(out)


def fit_forest(train: DataFrame, num_trees: int, max_depth: int, seed: int, label: str = "label"):
    """M6.  Larger node batches (maxMemoryInMB) mean fewer passes over the data
    for deep trees; node ids are cached and checkpointed every 10 levels to
    the shared folder, which keeps the lineage of deep trees short."""
    train = _in_fewer_tasks(_slots_as_numbers(train))
    return RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=seed, labelCol=label,
                                  maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=10,
                                  featuresCol="features", probabilityCol="rf_probability",
                                  predictionCol="rf_prediction", rawPredictionCol="_rf_raw").fit(train)


def _in_folds(train: DataFrame, seed: int, label: str = "label") -> tuple[DataFrame, int]:
    """``train`` with ``_fold`` (stored), and the number of folds: ``min(3, smallest class)``, 0 for no calibration."""
    smallest, rows = train.groupBy(label).count().agg(F.min("count"), F.sum("count")).first()
    if smallest is None or smallest < 2:
        return train, 0
    folds = int(min(3, smallest))
    # every class is dealt out to the folds in turn, so each fold has all classes
    dealt = dense_index(train.withColumn("_h", seed_col(F.lit("fold"), F.col("user_pseudo_id"), seed=seed)),
                        ["_h", "user_pseudo_id"], [label], index_col="_pos")
    tf = dealt.withColumn("_fold", (F.col("_pos") % folds).cast("int")).drop("_h", "_pos")
    # the numbering leaves a label's rows in one task
    return materialize(dealt_evenly(tf, "user_pseudo_id", rows)), folds


def _calibrated(tf: DataFrame, forests: list, num_classes: int, label: str = "label") -> list:
    """[(forest, [(slope, offset) per class])] by each forest's scores of the fold that it was not fitted on."""
    held = []
    for f, forest in enumerate(forests):
        held.append(with_scores(tf.where(F.col("_fold") == f), forest, "p").select(
            F.col("_fold").alias("fold"), F.col(label).alias("label"), "p"))
    scores = held[0]
    for h in held[1:]:
        scores = scores.union(h)
    curves = fit_curves(stored(scores, "fold-scores"), num_classes)
    return [(forest, [curves[f, c] for c in range(num_classes)]) for f, forest in enumerate(forests)]


def fit_calibrated_forest(train: DataFrame, num_trees: int, max_depth: int, seed: int, num_classes: int,
                          label: str = "label") -> list:
    """M7: sigmoid calibration in ``folds = min(3, smallest class)`` folds.

    For each fold a forest is fitted on the other folds and scores the held-out
    one; then all curves from a class's score to its probability are fitted
    together (``calibration``).  Prediction averages the normalised fold
    outputs.  Returns [(forest, [(slope, offset) per class])] or [] when uncalibrated.
    """
    tf, folds = _in_folds(train, seed, label)
    if not folds:
        return []
    forests = _fit_at_once(train.sparkSession, lambda f: fit_forest(
        tf.where(F.col("_fold") != f), num_trees, max_depth, seed, label), range(folds))
    return _calibrated(tf, forests, num_classes, label)


def fit_large_forests(train: DataFrame, rows: int, groups: list[tuple[int, int]], width: int, num_trees: int, max_depth: int,
                      seed: int, num_classes: int, calibrate: bool = True) -> tuple[Forest, list]:
    """M6 and M7 on a large split: the forest on all rows and those of the folds grow in one job (``forest``).
    ``groups``: (first feature, slots) of the one-hot features; ``width``: features."""
    tf, folds = _in_folds(train, seed) if calibrate else (train, 0)
    tf = tf if folds else tf.withColumn("_fold", F.lit(0))
    coding = fit_coding(tf, rows, groups, width, seed)
    whole, *forests = fit_forests(tf, coding, width, num_classes, [-1, *range(folds)], num_trees, max_depth, seed)
    return whole, _calibrated(tf, forests, num_classes) if folds else []


def with_scores(df: DataFrame, forest, out_col: str) -> DataFrame:
    """``df`` with the class scores of ``forest`` (MLlib's, or a ``Forest``) as an array."""
    if isinstance(forest, Forest):
        return df.withColumn(out_col, forest.probability(df.sparkSession, "features"))
    vector, raw, top = (f"{out_col}_{x}" for x in ("vector", "raw", "top"))
    m = forest.copy({forest.probabilityCol: vector, forest.rawPredictionCol: raw, forest.predictionCol: top})
    return m.transform(df).withColumn(out_col, vector_to_array(vector)).drop(vector, raw, top)


def calibrated_probability(df: DataFrame, calibrated: list, num_classes: int) -> DataFrame:
    """Average over folds of normalised per-class sigmoids of forest scores.

    Each fold's forest writes its own output columns, so the folds are
    applied one after another on the same rows (no join back); every step is
    a small array expression.
    """
    out = df
    names = []
    for i, (forest, lrs) in enumerate(calibrated):
        a = F.array(*[F.lit(float(x)) for x, _ in lrs])
        b = F.array(*[F.lit(float(y)) for _, y in lrs])
        out = with_scores(out, forest, f"_pf{i}").withColumn(f"_s{i}", F.transform(
            f"_pf{i}", lambda p, c: 1.0 / (1.0 + F.exp(-(F.element_at(a, c + 1) * p + F.element_at(b, c + 1)))))).drop(f"_pf{i}")
        total = F.aggregate(f"_s{i}", F.lit(0.0), lambda acc, x: acc + x)
        out = out.withColumn(f"_s{i}", F.when(total > 0, F.transform(f"_s{i}", lambda x: x / total)).otherwise(
            F.array_repeat(F.lit(1.0 / num_classes), num_classes)))
        names.append(f"_s{i}")
    acc = F.col(names[0])
    for nm in names[1:]:
        acc = F.zip_with(acc, F.col(nm), lambda x, y: x + y)
    return out.withColumn("rf_prob", F.transform(acc, lambda x: x / len(names))).drop(*names)


def forest_probability(df: DataFrame, stack) -> DataFrame:
    """M6: uncalibrated scores of the forest on the whole training split."""
    return with_scores(df, stack.forest, "forest_prob")


def train_stack(users: DataFrame, seqs: DataFrame | None = None, label: str = "target_cluster",
                num_trees: int = K.FOREST_TREES, max_depth: int = K.FOREST_DEPTH,
                hidden: list[int] | None = None, mlp_iter: int = 50, calibrate: bool = True,
                seed: int = K.SEED) -> Stack | None:
    """M11 gate + M1-M9 on the training split (``is_validation`` false).

    Returns None when there are fewer than 30 users or fewer than 2 classes.
    ``seqs`` (user_pseudo_id, seq_tokens) feeds the sequence model.
    """
    gate = users.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("c")).first()
    if gate["n"] < K.TRAIN_MIN_USERS or gate["c"] < 2:
        return None
    num_classes = int(users.agg(F.max(label)).first()[0]) + 1
    # the split numbers the rows of a label together: dealt out again, every pass of every fit uses all tasks
    data = materialize(dealt_evenly(users.withColumn("label", F.col(label).cast("double")), "user_pseudo_id", gate["n"]))
    encoder = fit_context_encoder(data)
    train = data.where(~F.col("is_validation"))
    n_train = train.count()
    cluster_stats = fit_scaler(with_numeric(train), [f"_n_{c}" for c in NUM])
    cluster_stats = {c[3:]: v for c, v in cluster_stats.items()}
    t0 = time.perf_counter()
    kin = materialize(_cluster_input(train, encoder, cluster_stats).select("_kvec"))
    kmeans, k, sil = choose_kmeans(kin, "_kvec", n_train, seed)
    kmeans_time = time.perf_counter() - t0
    # feature scaler on the training split with the cluster id appended
    tmp = kmeans.transform(_cluster_input(train, encoder, cluster_stats)).withColumn(
        "_cluster_id", F.col("_k_pred").cast("double"))
    fstats = fit_scaler(tmp, [f"_n_{c}" for c in NUM] + ["_cluster_id"])
    feature_stats = {c[3:]: v for c, v in fstats.items() if c.startswith("_n_")}
    feature_stats["_cluster_id"] = fstats["_cluster_id"]
    stack = Stack(encoder, cluster_stats, kmeans, k, feature_stats, None, num_classes=num_classes, silhouette=sil)
    stack.timings["kmeans"] = kmeans_time
    feats = prepare_features(data, stack).select("user_pseudo_id", "label", "is_validation", "features")
    feats = materialize(feats)
    tr = feats.where(~F.col("is_validation"))
    slots = [len(s.labels) for s in encoder.stages[:-1]]
    d = len(NUM) + sum(slots) + 1
    layers = [d] + list(hidden or K.MLP_HIDDEN) + [num_classes]
    mlp = MultilayerPerceptronClassifier(
        layers=layers, seed=seed, maxIter=mlp_iter, blockSize=64, labelCol="label", featuresCol="features",
        probabilityCol="mlp_probability", predictionCol="mlp_prediction", rawPredictionCol="_mlp_raw")
    # all of them read the same features and none another's result
    if FEWEST_ROWS <= n_train <= MOST_ROWS:
        groups = [(len(NUM) + sum(slots[:i]), n) for i, n in enumerate(slots)]
        layout = Coding([*range(len(NUM)), d - 1], [[] for _ in range(len(NUM) + 1)], groups)
        fits = {"forest": lambda: fit_large_forests(tr, n_train, groups, d, num_trees, max_depth, seed, num_classes, calibrate),
                "mlp": lambda: fit_network(tr, mlp, layout)}
    else:
        fits = {"calibration": lambda: fit_calibrated_forest(tr, num_trees, max_depth, seed, num_classes) if calibrate else [],
                "forest": lambda: fit_forest(tr, num_trees, max_depth, seed), "mlp": lambda: mlp.fit(tr)}
    done = dict(zip(fits, _fit_at_once(users.sparkSession, lambda name: _timed(fits[name]), fits)))
    for name, (_, seconds) in done.items():
        stack.timings[name] = seconds
    stack.mlp, stack.forest = done["mlp"][0], done["forest"][0]
    if "calibration" in done:
        stack.calibrated = done["calibration"][0]
    else:
        stack.forest, stack.calibrated = stack.forest
    t0 = time.perf_counter()
    if seqs is not None:
        s = seqs.join(data.select("user_pseudo_id", "label", "is_validation"), "user_pseudo_id")
        stack.sequence = fit_sequence_model(s.where(~F.col("is_validation")), num_classes)
    stack.timings["sequence"] = time.perf_counter() - t0
    return stack


def score_tabular(df: DataFrame, stack: Stack) -> DataFrame:
    """``mlp_prob`` and ``rf_prob`` for every row; ``df`` needs the numeric and context columns."""
    out = prepare_features(df, stack)
    out = stack.mlp.transform(out).withColumn("mlp_prob", vector_to_array("mlp_probability"))
    out = out.drop("mlp_probability", "_mlp_raw", "mlp_prediction")
    if stack.calibrated:
        return calibrated_probability(out, stack.calibrated, stack.num_classes)
    return forest_probability(out, stack).withColumnRenamed("forest_prob", "rf_prob")


def score_sequence(df: DataFrame, stack: Stack, seq_col: str | None, key: str = "user_pseudo_id",
                   out_col: str = "seq_prob") -> DataFrame:
    """``out_col``: the sequence model's probabilities, null without a model or for an empty sequence."""
    if stack.sequence is None or seq_col is None:
        return df.withColumn(out_col, F.lit(None).cast("array<double>"))
    return sequence_probability(df, stack.sequence, seq_col, key, out_col)


def score(df: DataFrame, stack: Stack, seq_col: str | None = None, key: str = "user_pseudo_id") -> DataFrame:
    """Probability arrays ``mlp_prob``, ``rf_prob`` and ``seq_prob`` for every row of ``df`` (unique by ``key``)."""
    return score_sequence(score_tabular(df, stack), stack, seq_col, key)


# -- M10 -----------------------------------------------------------------------
def _argmax(arr):
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def cascade(df: DataFrame, mlp: str = "mlp_prob", rf: str | None = "rf_prob", seq: str | None = "seq_prob",
            rf_threshold: float = K.RF_THRESHOLD, seq_threshold: float = K.SEQUENCE_THRESHOLD) -> DataFrame:
    """Deep model argmax; below ``rf_threshold`` the forest's; a sequence
    confidence strictly above ``seq_threshold`` overrides.  Adds cascade_cluster,
    cascade_confidence, cascade_source.  A missing forest gives confidence 0.5."""
    m_conf = F.array_max(mlp)
    cluster = _argmax(F.col(mlp))
    conf = m_conf
    source = F.lit(K.SOURCE_DEEP)
    low = m_conf < rf_threshold
    if rf is not None:
        cluster = F.when(low, _argmax(F.col(rf))).otherwise(cluster)
        conf = F.when(low, F.coalesce(F.array_max(rf), F.lit(0.5))).otherwise(conf)
        source = F.when(low, F.lit(K.SOURCE_FOREST)).otherwise(source)
    if seq is not None:
        s_conf = F.array_max(seq)
        over = F.col(seq).isNotNull() & (F.size(seq) > 0) & (s_conf > seq_threshold)
        cluster = F.when(over, _argmax(F.col(seq))).otherwise(cluster)
        conf = F.when(over, s_conf).otherwise(conf)
        source = F.when(over, F.lit(K.SOURCE_SEQUENCE)).otherwise(source)
    return df.withColumns({"cascade_cluster": cluster, "cascade_confidence": conf, "cascade_source": source})


# -- S7 ------------------------------------------------------------------------
def _save_forest(forest, path: str) -> None:
    if isinstance(forest, Forest):
        from pyspark.sql import SparkSession

        forest.save(SparkSession.getActiveSession(), path)
    else:
        forest.write().overwrite().save(path)


def save_stack(stack: Stack, path: str) -> None:
    """Persist fitted stages; optional ones (sequence, calibration) may be absent."""
    import json

    stack.encoder.write().overwrite().save(f"{path}/encoder")
    stack.kmeans.write().overwrite().save(f"{path}/kmeans")
    _save_forest(stack.forest, f"{path}/forest")
    stack.mlp.write().overwrite().save(f"{path}/mlp")
    seq = stack.sequence
    if seq is not None:
        seq.steps.write.mode("overwrite").parquet(f"{path}/sequence_steps")
        seq.starts.write.mode("overwrite").parquet(f"{path}/sequence_starts")
    for i, (forest, lrs) in enumerate(stack.calibrated):
        _save_forest(forest, f"{path}/calibrated_{i}")
    meta = {"cluster_stats": stack.cluster_stats, "feature_stats": stack.feature_stats, "k": stack.k,
            "num_classes": stack.num_classes, "calibration": [lrs for _, lrs in stack.calibrated],
            "sequence": seq and {"shares": seq.shares, "n_steps": seq.n_steps, "smoothing": seq.smoothing},
            "silhouette": stack.silhouette, "large": isinstance(stack.forest, Forest)}
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/meta")


def load_stack(spark, path: str) -> Stack:
    import json

    from pyspark.ml.classification import MultilayerPerceptronClassificationModel, RandomForestClassificationModel as InMLlib
    from pyspark.ml.clustering import KMeansModel

    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    seq = meta["sequence"] and SequenceModel(spark.read.parquet(f"{path}/sequence_steps"),
                                             spark.read.parquet(f"{path}/sequence_starts"), **meta["sequence"])
    load = (lambda at: Forest.load(spark, at)) if meta["large"] else InMLlib.load
    cal = [(load(f"{path}/calibrated_{i}"), [tuple(x) for x in lrs])
           for i, lrs in enumerate(meta["calibration"])]
    return Stack(PipelineModel.load(f"{path}/encoder"), {k: tuple(v) for k, v in meta["cluster_stats"].items()},
                 KMeansModel.load(f"{path}/kmeans"), meta["k"],
                 {k: tuple(v) for k, v in meta["feature_stats"].items()},
                 load(f"{path}/forest"), cal,
                 MultilayerPerceptronClassificationModel.load(f"{path}/mlp"), seq, meta["num_classes"],
                 meta["silhouette"])
