"""Registered model, metric and composite queries."""

from __future__ import annotations

import functools

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tailorspark import constants as K
from tailorspark.functions.columns import array_text, business_tags, log_feature
from tailorspark.operators import evaluate as E
from tailorspark.operators import models as M
from tailorspark.operators.features import event_sequences
from tailorspark.operators.pages import flatten_document, page_document, personalize, route
from tailorspark.operators.partitioning import dealt_evenly
from tailorspark.operators.segments import segment_names, training_frame, with_segment_ids
from tailorspark.operators.sequence import END, PLACES, SMOOTHING, START, fit_sequence_model, sequence_probability
from tailorspark.plans.oracle import (
    TAGS_SQL, activity_cte, request_defaults_cte, requests_ctes, training_ctes, users_ctes, with_ctes)
from tailorspark.plans.q_coldstart import coldstart_parts, default_requests
from tailorspark.plans.q_pages import PAGE_FLAT, PAGE_SQL_COLS, page_ctes
from tailorspark.plans.registry import register
from tailorspark.session import materialize, scratch_dir, stored
from tailorspark.sources.requests import requests_as_json
from tailorspark.sources.tables import (
    AS_OF, STORED_UNTIL, activity, catalog, customer_requests, request_extra, requests, stored_activity)
from tailorspark.sources.visitors import load_visitors, save_visitors

#: Fitted stacks by the files they were fitted on (path, length and time of change).
_FITTED: dict = {}
_READ = ("events", "customer", "nation", "region", "part")


def _files(spark, sf_dir) -> tuple:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = [spark.sparkContext.applicationId, sf_dir]
    for t in _READ:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        out += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime())
                      for f in path.getFileSystem(conf).listStatus(path))
    return tuple(out)


def _training(spark, sf_dir):
    act = activity(spark, sf_dir, "visit")
    users = E.stratified_split(training_frame(act, AS_OF))
    return act, users


def _tokens(names: str):
    """Event names as tokens; an event without a name is the padding token."""
    return F.transform(names, lambda x: F.coalesce(x, F.lit("<PAD>")))


def _sequences(act):
    return event_sequences(act).select(
        "user_pseudo_id", _tokens("first_names").alias("seq_tokens"), _tokens("last_names").alias("eval_tokens"))


def model_inputs(spark, sf_dir):
    """Users with split, and the first and last 25 events per user as tokens (materialised)."""
    key = ("inputs", *_files(spark, sf_dir))
    if key not in _FITTED:
        # stored: the rollup and each slice of the sequences read it, so the events are read and joined once
        act = stored(activity(spark, sf_dir, "visit"), "activity")
        users = E.stratified_split(training_frame(act, AS_OF))
        _FITTED[key] = (materialize(users), materialize(_sequences(act)))
    return _FITTED[key]


def trained_stack(spark, sf_dir):
    """The fitted stack (None if there is too little to train on), trained once per application and input files."""
    key = ("stack", *_files(spark, sf_dir))
    if key not in _FITTED:
        users, seqs = model_inputs(spark, sf_dir)
        _FITTED[key] = M.train_stack(users, seqs.select("user_pseudo_id", "seq_tokens"))
    return _FITTED[key]


def _with_models(schema: str):
    """For queries of the fitted stack: no rows of ``schema`` where the training gate says no."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            stack = trained_stack(spark, sf_dir)
            return spark.createDataFrame([], schema) if stack is None else fn(spark, sf_dir, stack)
        return run
    return deco


def SPLIT_CTES():
    order = f"md5(concat_ws('|', '{K.SEED}', 'split', user_pseudo_id)), user_pseudo_id"
    return training_ctes() + [("split", f"""
SELECT *, row_number() OVER (PARTITION BY target_cluster ORDER BY {order})
          <= floor({K.VALIDATION_FRACTION} * count(*) OVER (PARTITION BY target_cluster) + 0.5) AS is_validation
FROM training""")]


# -- W7 -----------------------------------------------------------------------
@register("stratified_split", lambda: with_ctes(SPLIT_CTES(), """
SELECT user_pseudo_id, target_cluster, is_validation FROM split"""))
def q_stratified_split(spark, sf_dir):
    return _training(spark, sf_dir)[1].select("user_pseudo_id", "target_cluster", "is_validation")


# -- W8 -----------------------------------------------------------------------
@register("eval_sample", lambda: with_ctes(SPLIT_CTES(), f"""
SELECT user_pseudo_id, target_cluster FROM split WHERE is_validation
ORDER BY md5(concat_ws('|', '{K.SEED}', 'sample', user_pseudo_id)), user_pseudo_id LIMIT {K.EVAL_SAMPLE_SIZE}"""))
def q_eval_sample(spark, sf_dir):
    users = _training(spark, sf_dir)[1]
    return E.eval_sample(users.where("is_validation")).select("user_pseudo_id", "target_cluster")


# -- A11 ----------------------------------------------------------------------
@register("majority_baseline", lambda: with_ctes(SPLIT_CTES(), """
SELECT m.majority_class, round(avg(CAST(s.target_cluster = m.majority_class AS DOUBLE)), 6) AS accuracy,
       count(*) AS n_validation
FROM split s, (SELECT target_cluster AS majority_class FROM split WHERE NOT is_validation
               GROUP BY target_cluster ORDER BY count(*) DESC, target_cluster LIMIT 1) m
WHERE s.is_validation GROUP BY m.majority_class"""))
def q_majority_baseline(spark, sf_dir):
    users = _training(spark, sf_dir)[1]
    mb = E.majority_baseline(users, "target_cluster")
    return mb.select("majority_class", F.round("accuracy", 6).alias("accuracy"), "n_validation")


# -- A12 / A13 on a rule-based prediction ---------------------------------------
RULE_PRED_SQL = "CASE WHEN total_events >= 3 THEN target_cluster ELSE (target_cluster + 1) % 5 END"


def _rule_predictions(spark, sf_dir):
    users = training_frame(activity(spark, sf_dir, "visit"), AS_OF)
    pred = F.when(F.col("total_events") >= 3, F.col("target_cluster")).otherwise((F.col("target_cluster") + 1) % 5)
    return users.select("user_pseudo_id", F.col("target_cluster").alias("label"), pred.alias("prediction"))


def CONF_CTE():
    return training_ctes() + [("conf", f"""
SELECT target_cluster AS label, {RULE_PRED_SQL} AS prediction, count(*) AS n FROM training GROUP BY 1, 2"""), ("pc", """
SELECT cls, coalesce(tp, 0) AS tp, coalesce(sup, 0) AS support, coalesce(pr, 0) AS predicted FROM
  (SELECT label AS cls FROM conf UNION SELECT prediction FROM conf) c
  LEFT JOIN (SELECT label, sum(n) AS sup FROM conf GROUP BY label) s ON s.label = c.cls
  LEFT JOIN (SELECT prediction, sum(n) AS pr FROM conf GROUP BY prediction) p ON p.prediction = c.cls
  LEFT JOIN (SELECT label, n AS tp FROM conf WHERE label = prediction) t ON t.label = c.cls"""), ("pcm", """
SELECT cls, support,
       CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
       CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc"""), ("pcf", """
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
FROM pcm""")]


@register("classification_metrics", lambda: with_ctes(CONF_CTE(), """
SELECT round((SELECT sum(n) FILTER (WHERE label = prediction) FROM conf) / (SELECT sum(n) FROM conf), 6) AS accuracy,
       round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
       CAST((SELECT sum(n) FROM conf) AS BIGINT) AS n FROM pcf"""))
def q_classification_metrics(spark, sf_dir):
    m = E.metrics(E.confusion(_rule_predictions(spark, sf_dir)))
    return m.select(F.round("accuracy", 6).alias("accuracy"), F.round("f1_weighted", 6).alias("f1_weighted"),
                    F.col("n").cast("long").alias("n"))


@register("classification_report", lambda: with_ctes(CONF_CTE(), """
SELECT CAST(cls AS INTEGER) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM pcf"""))
def q_classification_report(spark, sf_dir):
    r = E.per_class(E.confusion(_rule_predictions(spark, sf_dir)))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


# -- M10 / A14 on deterministic probability columns ---------------------------------
def _weights(center, scale, n=5):
    w = [1.0 / (1.0 + F.abs(F.lit(c) - center) * scale) for c in range(n)]
    total = w[0] + w[1] + w[2] + w[3] + w[4]
    return F.array(*[x / total for x in w])


def _prob_frame(spark, sf_dir):
    return _prob_columns(training_frame(activity(spark, sf_dir, "visit"), AS_OF))


def _prob_columns(users, *keep):
    t = F.col("target_cluster")
    mlp = _weights(t, 1 + F.col("total_events") % 4)
    rf = _weights((t + 1) % 5, F.lit(2))
    seq = F.when(F.col("unique_pages") >= 2, _weights((t + F.col("num_cart_adds")) % 5,
                                                       1 + F.col("days_since_first_visit") % 7))
    return users.select("user_pseudo_id", *keep, mlp.alias("mlp_prob"), rf.alias("rf_prob"), seq.alias("seq_prob"))


def _weights_sql(center, scale):
    w = [f"(1.0 / (1.0 + abs({c} - ({center})) * ({scale})))" for c in range(5)]
    total = " + ".join(w)
    return [f"({x} / ({total}))" for x in w]


def _cascade_sql():
    mlp = _weights_sql("target_cluster", "1 + total_events % 4")
    rf = _weights_sql("(target_cluster + 1) % 5", "2")
    sq = _weights_sql("(target_cluster + num_cart_adds) % 5", "1 + days_since_first_visit % 7")
    return training_ctes() + [("pr", f"""
SELECT user_pseudo_id, [{', '.join(mlp)}] AS mlp, [{', '.join(rf)}] AS rf,
       CASE WHEN unique_pages >= 2 THEN [{', '.join(sq)}] END AS sq FROM training"""), ("pr2", """
SELECT *, list_max(mlp) AS mc, list_position(mlp, list_max(mlp)) - 1 AS ma,
       list_max(rf) AS rc, list_position(rf, list_max(rf)) - 1 AS ra,
       list_max(sq) AS sc, list_position(sq, list_max(sq)) - 1 AS sa FROM pr"""), ("casc", f"""
SELECT user_pseudo_id,
       CAST(CASE WHEN sq IS NOT NULL AND sc > {K.SEQUENCE_THRESHOLD} THEN sa WHEN mc < {K.RF_THRESHOLD} THEN ra
                 ELSE ma END AS INTEGER) AS cascade_cluster,
       round(CASE WHEN sq IS NOT NULL AND sc > {K.SEQUENCE_THRESHOLD} THEN sc WHEN mc < {K.RF_THRESHOLD} THEN rc
                  ELSE mc END, 6) AS cascade_confidence,
       CASE WHEN sq IS NOT NULL AND sc > {K.SEQUENCE_THRESHOLD} THEN '{K.SOURCE_SEQUENCE}'
            WHEN mc < {K.RF_THRESHOLD} THEN '{K.SOURCE_FOREST}' ELSE '{K.SOURCE_DEEP}' END AS cascade_source
FROM pr2""")]


@register("prediction_cascade", lambda: with_ctes(_cascade_sql(), "SELECT * FROM casc"))
def q_prediction_cascade(spark, sf_dir):
    c = M.cascade(_prob_frame(spark, sf_dir))
    return c.select("user_pseudo_id", "cascade_cluster", F.round("cascade_confidence", 6).alias("cascade_confidence"),
                    "cascade_source")


@register("source_breakdown", lambda: with_ctes(_cascade_sql(), """
SELECT cascade_source AS source, count(*) AS n FROM casc GROUP BY 1"""))
def q_source_breakdown(spark, sf_dir):
    return E.source_breakdown(M.cascade(_prob_frame(spark, sf_dir)), "cascade_source")


# -- M11 ----------------------------------------------------------------------
def _gate_sql():
    parts = []
    for grain in ("visit", "user"):
        parts.append(with_ctes(training_ctes(grain), f"""
SELECT '{grain}' AS grain, count(*) AS n_users, count(DISTINCT target_cluster) AS n_classes,
       count(*) >= {K.TRAIN_MIN_USERS} AND count(DISTINCT target_cluster) >= 2 AS trains FROM training"""))
    return "SELECT * FROM (" + parts[0] + ") UNION ALL SELECT * FROM (" + parts[1] + ")"


@register("training_gate", _gate_sql)
def q_training_gate(spark, sf_dir):
    out = None
    for grain in ("visit", "user"):
        u = training_frame(activity(spark, sf_dir, grain), AS_OF)
        g = u.agg(F.lit(grain).alias("grain"), F.count(F.lit(1)).alias("n_users"),
                  F.count_distinct("target_cluster").alias("n_classes"))
        g = g.withColumn("trains", (F.col("n_users") >= K.TRAIN_MIN_USERS) & (F.col("n_classes") >= 2))
        out = g if out is None else out.unionByName(g)
    return out


# -- M1 -----------------------------------------------------------------------
def _onehot_sql():
    parts = []
    offset = []
    for c in K.CONTEXT_COLS:
        off = " + ".join(offset) if offset else "0"
        parts.append(f"""SELECT user_pseudo_id, '{c}' AS feature, {c} AS value,
       CAST({off} + dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS slot FROM training""")
        offset.append(f"(SELECT count(DISTINCT {c}) FROM training)")
    return with_ctes(training_ctes(), "\nUNION ALL\n".join(parts))


@register("context_onehot", _onehot_sql)
def q_context_onehot(spark, sf_dir):
    users = training_frame(activity(spark, sf_dir, "visit"), AS_OF)
    enc = M.fit_context_encoder(users)
    sizes = [len(s.labels) for s in enc.stages[:-1]]
    out = enc.transform(M.context_frame(users))
    parts = []
    off = 0
    for c, n in zip(K.CONTEXT_COLS, sizes):
        parts.append(out.select("user_pseudo_id", F.lit(c).alias("feature"), F.col(c).alias("value"),
                                (F.col(f"_idx_{c}") + off).cast("int").alias("slot")))
        off += n
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


# -- M2 -----------------------------------------------------------------------
def _scale_sql():
    cols = []
    for c in K.NUMERIC_FEATURE_COLS:
        x = f"ln(1 + greatest(CAST({c} AS DOUBLE), 0.0))" if c in K.LOG_TRANSFORM_COLS else f"CAST({c} AS DOUBLE)"
        cols.append(f"round(({x} - avg({x}) OVER ()) / coalesce(nullif(stddev_pop({x}) OVER (), 0), 1.0), 6) AS s_{c}")
    return with_ctes(training_ctes(), "SELECT user_pseudo_id, " + ", ".join(cols) + " FROM training")


@register("selective_scale", _scale_sql)
def q_selective_scale(spark, sf_dir):
    users = M.with_numeric(training_frame(activity(spark, sf_dir, "visit"), AS_OF))
    stats = M.fit_scaler(users, [f"_n_{c}" for c in K.NUMERIC_FEATURE_COLS])
    out = M.apply_scaler(users, stats, "_s")
    return out.select("user_pseudo_id", *[F.round(f"_n_{c}_s", 6).alias(f"s_{c}") for c in K.NUMERIC_FEATURE_COLS])


# -- M5 -----------------------------------------------------------------------
@register("merge_small_clusters", lambda: with_ctes(training_ctes() + [("mf", """
SELECT user_pseudo_id, ln(1 + greatest(CAST(total_events AS DOUBLE), 0.0)) AS x0,
       ln(1 + greatest(total_revenue, 0.0)) AS x1, CAST(least(total_events, 12) AS BIGINT) AS cluster FROM training"""),
    ("ms", f"""SELECT cluster, count(*) AS size, avg(x0) AS c0, avg(x1) AS c1,
       count(*) < greatest({K.SMALL_CLUSTER_ABS}, floor((SELECT count(*) FROM mf) * {K.SMALL_CLUSTER_FRACTION}))
         AS small FROM mf GROUP BY cluster"""),
    ("near", """SELECT m.user_pseudo_id, arg_min(l.cluster, (sqrt((m.x0 - l.c0) ** 2 + (m.x1 - l.c1) ** 2), l.cluster))
         AS nc FROM mf m JOIN ms s ON s.cluster = m.cluster AND s.small, ms l WHERE NOT l.small
       GROUP BY m.user_pseudo_id""")], """
SELECT m.user_pseudo_id, m.cluster, coalesce(n.nc, m.cluster) AS merged
FROM mf m LEFT JOIN near n ON n.user_pseudo_id = m.user_pseudo_id"""))
def q_merge_small_clusters(spark, sf_dir):
    users = training_frame(activity(spark, sf_dir, "visit"), AS_OF)
    f = users.select("user_pseudo_id", log_feature("total_events").alias("x0"), log_feature("total_revenue").alias("x1"),
                     F.least(F.col("total_events"), F.lit(12)).cast("long").alias("cluster"))
    return M.merge_small_clusters(f, ["x0", "x1"], "cluster").select("user_pseudo_id", "cluster", "merged")


# -- M3 / M4 / M6-M8 (model output: rows-only check) ---------------------------
_PREDICTED = "user_pseudo_id string, label int, prediction int, confidence double"


def _validation(spark, sf_dir):
    """The validation split with its sequences, dealt to all tasks: the join leaves its few columns in one or two."""
    users, seqs = model_inputs(spark, sf_dir)
    val = users.where("is_validation")
    return dealt_evenly(val.join(seqs, "user_pseudo_id", "left"), "user_pseudo_id", val.count())


@register("feature_vectors")
@_with_models("user_pseudo_id string, features array<double>")
def q_feature_vectors(spark, sf_dir, stack):
    users, _ = model_inputs(spark, sf_dir)
    return M.prepare_features(users, stack).select("user_pseudo_id", vector_to_array("features").alias("features"))


@register("behavior_clusters")
@_with_models("user_pseudo_id string, behavior_cluster int, k int")
def q_behavior_clusters(spark, sf_dir, stack):
    users, _ = model_inputs(spark, sf_dir)
    out = M.prepare_features(users, stack)
    return out.select("user_pseudo_id", F.col("_k_pred").alias("behavior_cluster"), F.lit(stack.k).alias("k"))


def _pred_cols(df, prob):
    return df.select("user_pseudo_id", F.col("target_cluster").alias("label"),
                     M._argmax(F.col(prob)).alias("prediction"), F.array_max(prob).alias("confidence"))


@register("forest_predictions")
@_with_models(_PREDICTED)
def q_forest_predictions(spark, sf_dir, stack):
    """M6: scores of the forest fitted on the whole training split, without calibration."""
    users, _ = model_inputs(spark, sf_dir)
    out = M.forest_probability(M.prepare_features(users.where("is_validation"), stack), stack)
    return _pred_cols(out, "forest_prob")


@register("calibrated_forest")
@_with_models(_PREDICTED)
def q_calibrated_forest(spark, sf_dir, stack):
    return _pred_cols(M.score_tabular(_validation(spark, sf_dir), stack), "rf_prob")


@register("mlp_predictions")
@_with_models(_PREDICTED)
def q_mlp_predictions(spark, sf_dir, stack):
    return _pred_cols(M.score_tabular(_validation(spark, sf_dir), stack), "mlp_prob")


# -- M9 -----------------------------------------------------------------------
def _sequence_sql():
    a, n = SMOOTHING, K.SEQUENCE_MAX_LEN
    return with_ctes(SPLIT_CTES() + [("se", f"""
SELECT s.user_pseudo_id, s.target_cluster AS c, s.is_validation, a.event_ts, a.event_id,
       coalesce(a.event_name, '<PAD>') AS e,
       row_number() OVER (PARTITION BY a.user_pseudo_id ORDER BY a.event_ts, a.event_id) AS i
FROM activity a JOIN split s ON s.user_pseudo_id = a.user_pseudo_id"""), ("sn", f"""
SELECT user_pseudo_id, c, is_validation, i, count(*) OVER (PARTITION BY user_pseudo_id) AS n,
       e || '#' || CAST(row_number() OVER (PARTITION BY user_pseudo_id, e ORDER BY i) AS VARCHAR) AS t
FROM se WHERE i <= {n}"""), ("st", f"""
SELECT user_pseudo_id, c, is_validation, coalesce(lag(t) OVER (PARTITION BY user_pseudo_id ORDER BY i), '{START}') AS b, t
FROM sn UNION ALL SELECT user_pseudo_id, c, is_validation, t, '{END}' FROM sn WHERE i = n"""), ("sc", """
SELECT b, t, c, count(*) AS n FROM st WHERE NOT is_validation GROUP BY b, t, c"""), ("sb", """
SELECT b, c, sum(n) AS n FROM sc GROUP BY b, c"""), ("sz", "SELECT count(DISTINCT t) AS v FROM sc"), ("sp", """
SELECT target_cluster AS c, count(*) AS n FROM split WHERE NOT is_validation GROUP BY target_cluster"""), ("sk", "SELECT max(target_cluster) + 1 AS k FROM split"), ("sl", f"""
SELECT x.user_pseudo_id, x.c AS label, k.c,
       round(sum(ln(coalesce(sc.n, 0) + {a}) - ln(coalesce(sb.n, 0) + {a} * (SELECT v FROM sz)))
             + any_value(ln((coalesce(p.n, 0) + {a}) / ((SELECT sum(n) FROM sp) + {a} * (SELECT k FROM sk)))), {PLACES}) AS ll
FROM st x, (SELECT CAST(unnest(range(0, (SELECT k FROM sk))) AS INTEGER) AS c) k
LEFT JOIN sc ON sc.b = x.b AND sc.t = x.t AND sc.c = k.c
LEFT JOIN sb ON sb.b = x.b AND sb.c = k.c
LEFT JOIN sp p ON p.c = k.c
WHERE x.is_validation GROUP BY x.user_pseudo_id, x.c, k.c""")], """
SELECT user_pseudo_id, label, CAST(arg_min(c, (-ll, c)) AS INTEGER) AS prediction,
       round(1 / sum(exp(ll - top)), 6) AS confidence
FROM (SELECT *, max(ll) OVER (PARTITION BY user_pseudo_id) AS top FROM sl) GROUP BY user_pseudo_id, label""")


@register("sequence_predictions", _sequence_sql)
def q_sequence_predictions(spark, sf_dir):
    """M9 on the validation split, fitted on the first 25 events of the training split's visitors (no other model needed)."""
    act, users = _training(spark, sf_dir)
    users = materialize(users.select("user_pseudo_id", "target_cluster", "is_validation"))
    seqs = users.join(_sequences(act), "user_pseudo_id")
    gate = users.agg(F.count(F.lit(1)).alias("n"), F.max("target_cluster").alias("c")).first()
    model = fit_sequence_model(seqs.where(~F.col("is_validation")), (gate["c"] or 0) + 1, label="target_cluster")
    if model is None:
        return spark.createDataFrame([], _PREDICTED)
    scored = sequence_probability(seqs.where("is_validation"), model, "seq_tokens", "user_pseudo_id")
    return _pred_cols(scored.where(F.col("seq_prob").isNotNull()), "seq_prob").withColumn(
        "confidence", F.round("confidence", 6))


# -- M12 ----------------------------------------------------------------------
def _long_predictions(df, models: dict, key: str = "user_pseudo_id"):
    """One row for each user and model: ``models`` maps a name to its (prediction, source) columns."""
    cells = F.array(*[F.struct(F.lit(name).alias("model"), p.cast("int").alias("prediction"), s.cast("string").alias("source"))
                      for name, (p, s) in models.items()])
    return df.select(key, F.col("target_cluster").alias("label"), F.inline(cells)).where(F.col("prediction").isNotNull())


def _by_probability(scored) -> dict:
    none = F.lit(None)
    return {"random_forest": (M._argmax(F.col("rf_prob")), none), "deep_model": (M._argmax(F.col("mlp_prob")), none),
            "lstm": (M._argmax(F.col("seq_prob")), none),
            "deployed_pipeline": (F.col("cascade_cluster"), F.col("cascade_source"))}


def cascade_predictions(spark, sf_dir, stack):
    """(user_pseudo_id, label, model, prediction, source) on the whole validation split, scored once.

    The sequence model alone reads the first 25 events, the cascade the last 25 (as at serving time).
    """
    scored = M.score_tabular(_validation(spark, sf_dir), stack)
    scored = M.score_sequence(scored, stack, "seq_tokens")
    scored = M.score_sequence(scored, stack, "eval_tokens", out_col="eval_prob")
    return _long_predictions(M.cascade(scored, seq="eval_prob"), _by_probability(scored))


@register("cascade_evaluation")
@_with_models("model string, accuracy double, f1_weighted double, n long")
def q_cascade_evaluation(spark, sf_dir, stack):
    """Per-model and end-to-end cascade metrics on the whole validation split."""
    rows = E.evaluation(cascade_predictions(spark, sf_dir, stack)).where("scope = 'all'")
    out = rows.groupBy("model").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m)
                                      for m in ("accuracy", "f1_weighted", "n")]).withColumn("n", F.col("n").cast("long"))
    users, _ = model_inputs(spark, sf_dir)
    return E.majority_baseline(users, "target_cluster").select(
        F.lit("majority_baseline").alias("model"), "accuracy", F.lit(None).cast("double").alias("f1_weighted"),
        F.col("n_validation").alias("n")).unionByName(out)


@register("cascade_report")
@_with_models("model string, scope string, item string, metric string, value double")
def q_cascade_report(spark, sf_dir, stack):
    """The same, in full: per-class report of every model and where the cascade's predictions come from."""
    return E.evaluation(cascade_predictions(spark, sf_dir, stack))


def _report_sql():
    return with_ctes(_cascade_sql() + [("lp", f"""
SELECT t.target_cluster AS label, u.model, u.prediction, u.source FROM pr2 p JOIN training t USING (user_pseudo_id)
JOIN casc c USING (user_pseudo_id),
LATERAL (VALUES ('random_forest', p.ra, NULL), ('deep_model', p.ma, NULL), ('lstm', p.sa, NULL),
                ('deployed_pipeline', c.cascade_cluster, c.cascade_source)) AS u(model, prediction, source)
WHERE u.prediction IS NOT NULL"""), ("lc", """
SELECT m.model, m.cls, count(*) FILTER (WHERE l.label = m.cls) AS support,
       count(*) FILTER (WHERE l.prediction = m.cls) AS predicted,
       count(*) FILTER (WHERE l.label = m.cls AND l.prediction = m.cls) AS hit
FROM (SELECT model, label AS cls FROM lp UNION SELECT model, prediction FROM lp) m JOIN lp l USING (model)
GROUP BY m.model, m.cls"""), ("lf", """
SELECT *, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0.0 END AS precision,
       CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS recall FROM lc"""), ("lg", """
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM lf""")], """
SELECT model, scope, item, metric, round(value, 6) AS value FROM (
SELECT model, 'all' AS scope, '' AS item, 'accuracy' AS metric, avg(CAST(label = prediction AS DOUBLE)) AS value FROM lp GROUP BY model
UNION ALL SELECT model, 'all', '', 'n', CAST(count(*) AS DOUBLE) FROM lp GROUP BY model
UNION ALL SELECT model, 'all', '', 'f1_weighted', sum(f1 * support) / sum(support) FROM lg GROUP BY model
UNION ALL SELECT model, 'class', CAST(cls AS VARCHAR), unnest(['precision', 'recall', 'f1', 'support']),
                 unnest([precision, recall, f1, CAST(support AS DOUBLE)]) FROM lg
UNION ALL SELECT model, 'source', source, 'n', CAST(count(*) AS DOUBLE) FROM lp WHERE source IS NOT NULL GROUP BY model, source
UNION ALL SELECT l.model, 'source', l.source, 'share', count(*) / any_value(t.n) FROM lp l
  JOIN (SELECT model, count(*) AS n FROM lp GROUP BY model) t USING (model) WHERE l.source IS NOT NULL GROUP BY l.model, l.source)""")


@register("evaluation_report", _report_sql)
def q_evaluation_report(spark, sf_dir):
    """M12's report on the deterministic probability columns of the cascade query."""
    users = training_frame(activity(spark, sf_dir, "visit"), AS_OF)
    probs = M.cascade(_prob_columns(users, "target_cluster"))
    return E.evaluation(_long_predictions(probs, _by_probability(probs))).withColumn("value", F.round("value", 6))


# -- S7 -----------------------------------------------------------------------
@register("model_roundtrip")
@_with_models("user_pseudo_id string, before int, after int, forest_before int, forest_after int, equal boolean")
def q_model_roundtrip(spark, sf_dir, stack):
    """Save the fitted stack to the shared folder, load it, and score the
    validation users with both; the predictions must agree."""
    path = scratch_dir(spark, "models")
    M.save_stack(stack, path)
    val = _validation(spark, sf_dir)

    def predictions(s, name):
        scored = M.forest_probability(M.cascade(M.score(val, s, "seq_tokens")), s)
        return scored.select("user_pseudo_id", F.col("cascade_cluster").alias(name),
                             M._argmax(F.col("forest_prob")).alias(f"forest_{name}"))

    both = predictions(stack, "before").join(predictions(M.load_stack(spark, path), "after"), "user_pseudo_id")
    return both.withColumn("equal", (F.col("before") == F.col("after")) & (F.col("forest_before") == F.col("forest_after")))


# -- C3 -----------------------------------------------------------------------
def visitor_table(spark, sf_dir, names):
    """The customers' stored rows (as of ``STORED_UNTIL``), written bucketed and read back; segments by ``names``."""
    users = training_frame(stored_activity(spark, sf_dir), AS_OF)
    path = scratch_dir(spark, "visitors")
    save_visitors(with_segment_ids(users, names), path)
    return load_visitors(spark, path)


ROUTED = ["total_events", "unique_pages", "total_revenue", "days_since_first_visit", *K.CONTEXT_COLS]


def _stored_route_sql():
    known = "u.user_pseudo_id IS NOT NULL"
    cols = ",\n       ".join(f"CASE WHEN {known} THEN u.{c} ELSE r.{c} END AS {c}" for c in ROUTED)
    out = ", ".join(f"round({c}, 4) AS {c}" if c == "total_revenue" else f"CAST({c} AS BIGINT) AS {c}"
                    if c in K.NUMERIC_FEATURE_COLS else c for c in ROUTED)
    return with_ctes(requests_ctes() + [request_defaults_cte()] + [
        ("v_activity", activity_cte("user") + f" WHERE e.ts < TIMESTAMP '{STORED_UNTIL}'")] + users_ctes("v_activity") + [
        ("routed", f"""
SELECT r.request_id, CASE WHEN r.total_events > 1 THEN split_part(r.request_id, '-', 1) END AS user_pseudo_id,
       CASE WHEN {known} THEN 'stored'
            WHEN (CASE WHEN len(r.recent_sequence) > 0 THEN len(r.recent_sequence) ELSE r.total_events END) >= 3 THEN 'live'
            ELSE 'cold' END AS path,
       {cols}
FROM req r LEFT JOIN users u ON r.total_events > 1 AND u.user_pseudo_id = split_part(r.request_id, '-', 1)
  AND u.total_events >= {K.MIN_EVENTS_FOR_BEHAVIORAL}""")], f"""
SELECT request_id, user_pseudo_id, path, {out}, {TAGS_SQL} AS tags FROM routed""")


@register("stored_visitor_route", _stored_route_sql)
def q_stored_visitor_route(spark, sf_dir):
    """Requests of customers against the stored visitor table: path, and the numerics, context and tags they are served with."""
    act = stored(activity(spark, sf_dir, "visit"), "activity")
    users = training_frame(act, AS_OF, extra=request_extra())
    visitors = visitor_table(spark, sf_dir, segment_names(users))
    req = route(customer_requests(default_requests(spark, sf_dir, act, users)), True, visitors)
    tags = array_text(business_tags("total_revenue", "days_since_first_visit", "total_events"))
    return req.select("request_id", "user_pseudo_id", "path", *[
        F.round(c, 4).alias(c) if c == "total_revenue" else F.col(c).cast("long").alias(c)
        if c in K.NUMERIC_FEATURE_COLS else c for c in ROUTED], tags.alias("tags"))


@register("personalize_all")
def q_personalize_all(spark, sf_dir):
    """Every request through routing against the stored visitors, the model cascade (stored numerics and context, or the
    request's own) or the cold-start resolver, and page assembly."""
    stack = trained_stack(spark, sf_dir)
    act, users, table, defaults = coldstart_parts(spark, sf_dir, materialize=True)
    names = segment_names(users)
    visitors = visitor_table(spark, sf_dir, names)
    req = customer_requests(default_requests(spark, sf_dir, act, users))
    preds = None  # too little data for a model: every request is cold
    if stack is not None:
        req = stored(route(req, True, visitors), "routed")
        live = req.where(F.col("path") != "cold")  # scored in all tasks, however few files they were stored in
        live = dealt_evenly(live, "request_id", live.count())
        preds = M.cascade(M.score(live, stack, "recent_sequence", "request_id")).select(
            "request_id", F.col("cascade_cluster").alias("m_cluster"),
            F.col("cascade_confidence").alias("m_confidence"), F.col("cascade_source").alias("m_source"))
    pages = personalize(req, table, defaults, catalog(spark, sf_dir), names=names, users=visitors, predictions=preds)
    return flatten_document(page_document(pages)).select(*PAGE_FLAT)


# -- T2 -----------------------------------------------------------------------
@register("stream_personalize", lambda: with_ctes(page_ctes(), f"SELECT {PAGE_SQL_COLS} FROM pages"))
def q_stream_personalize(spark, sf_dir):
    """Request payloads land as JSON files; a stream scores them per batch."""
    from tailorspark.streaming.personalize_stream import run_personalize_stream

    act, users, table, defaults = coldstart_parts(spark, sf_dir, materialize=True)
    base = scratch_dir(spark, "t2")
    requests_as_json(requests(spark, sf_dir, act=act, rollup=users)).repartition(4).write.json(f"{base}/in")
    out = run_personalize_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", table, defaults,
                                 catalog(spark, sf_dir), names=segment_names(users))
    return out.select(*PAGE_FLAT)
