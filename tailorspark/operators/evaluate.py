"""Splits, samples and classification metrics.

Metrics come from one confusion table ``groupBy(label, prediction).count``
(at most k x k rows), so every number below is exact and needs one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailorspark import constants as K
from tailorspark.operators.partitioning import dense_index
from tailorspark.session import stored
from tailorspark.sources.tables import seed_col


def hash_fraction(key: str, salt: str, seed: int = K.SEED):
    """Deterministic uniform number in [0, 1) from md5(seed|salt|key)."""
    return F.conv(F.substring(seed_col(F.lit(salt), F.col(key), seed=seed), 1, 8), 16, 10).cast("double") / float(
        1 << 32)


def stratified_split(df: DataFrame, key: str = "user_pseudo_id", fraction: float = K.VALIDATION_FRACTION,
                     seed: int = K.SEED, label: str = "target_cluster") -> DataFrame:
    """``is_validation`` for exactly ``round(fraction * n)`` rows of every class.

    A class's rows are numbered in the order of a seeded hash (``dense_index``
    spreads a large class over many tasks) and the first ones are for validation.
    """
    h = seed_col(F.lit("split"), F.col(key), seed=seed)
    placed = dense_index(df.withColumn("_h", h), ["_h", key], [label], index_col="_pos", size_col="_size")
    first = F.floor(F.lit(fraction) * F.col("_size") + 0.5)
    return placed.withColumn("is_validation", F.col("_pos") < first).drop("_h", "_pos", "_size")


def eval_sample(df: DataFrame, n: int = K.EVAL_SAMPLE_SIZE, key: str = "user_pseudo_id",
                seed: int = K.SEED) -> DataFrame:
    """The ``n`` rows with the smallest md5(seed|sample|key) (a top-n; the
    limit is the sampling feature itself)."""
    h = seed_col(F.lit("sample"), F.col(key), seed=seed)
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))


def per_class(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1, support per class (labels and predictions)."""
    tp = conf.where(F.col("label") == F.col("prediction")).select(F.col("label").alias("cls"), F.col("n").alias("tp"))
    sup = conf.groupBy(F.col("label").alias("cls")).agg(F.sum("n").alias("support"))
    pred = conf.groupBy(F.col("prediction").alias("cls")).agg(F.sum("n").alias("predicted"))
    c = sup.join(pred, "cls", "full").join(tp, "cls", "left").fillna(0, ["support", "predicted", "tp"])
    precision = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return c.select(F.col("cls").cast("int").alias("label"), precision.alias("precision"), recall.alias("recall"),
                    f1.alias("f1"), F.col("support").cast("long").alias("support"))


def metrics(conf: DataFrame) -> DataFrame:
    """One row with accuracy, weighted F1 and n.

    The confusion table (at most k x k rows) is stored once, so the several
    aggregates over it never repeat the scoring that produced it.
    """
    conf = stored(conf, "confusion")
    pc = per_class(conf)
    acc = conf.agg((F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
                    / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))
    wf1 = pc.agg(F.sum(F.col("f1") * F.col("support")) / F.sum("support")).scalar()
    return acc.withColumn("f1_weighted", wf1)


def evaluation(predictions: DataFrame, model: str = "model", label: str = "label", prediction: str = "prediction",
               source: str = "source") -> DataFrame:
    """M12 (+ A12-A14): (model, scope, item, metric, value) of every model in ``predictions``.

    ``predictions``: one row for each model and user; ``source`` may be null.  One aggregation by
    grouping sets over the (model, label, prediction, source) counts, stored once; scope ``all`` has
    accuracy, f1_weighted and n, ``class`` precision, recall, f1 and support of every label or
    predicted class, ``source`` n and share of every source.
    """
    cells = predictions.groupBy(
        F.col(model).alias("model"), F.col(label).cast("int").alias("label"), F.col(prediction).cast("int").alias("predicted"),
        F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    m, c, p, s = (F.col(x) for x in ("model", "label", "predicted", "source"))
    sets = stored(cells.withColumn("hit", hit).groupingSets([[m], [m, c], [m, p], [m, s]], m, c, p, s).agg(
        F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.grouping_id().alias("by")), "evaluation")
    # grouping_id: a bit for each rolled-up column of (model, label, predicted, source)
    whole, by_label, by_prediction, by_source = (sets.where(F.col("by") == b) for b in (0b0111, 0b0011, 0b0101, 0b0110))
    sides = by_label.select("model", F.col("label").alias("cls"), F.col("n").alias("support"), "hit", F.lit(0).alias("predicted")) \
        .union(by_prediction.select("model", F.col("predicted").alias("cls"), F.lit(0), F.lit(0), F.col("n")))
    tally = sides.groupBy("model", "cls").agg(*[F.sum(x).alias(x) for x in ("support", "hit", "predicted")])
    precision = F.when(F.col("predicted") > 0, F.col("hit") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    # hit / mean of both counts: the harmonic mean of precision and recall
    f1 = F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("predicted") + F.col("support"))).otherwise(0.0)
    classes = tally.select("model", "cls", "support", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))

    def rows(df: DataFrame, scope: str, item, **metrics) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])
        return df.select("model", F.lit(scope).alias("scope"), item.cast("string").alias("item"), F.inline(pairs))

    weighted = classes.groupBy("model").agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"))
    total = whole.select(F.col("model").alias("_m"), F.col("n").alias("total"))
    shares = by_source.where("source is not null").join(total, F.col("model") == F.col("_m"))
    return rows(whole, "all", F.lit(""), accuracy=F.col("hit") / F.col("n"), n=F.col("n")) \
        .union(rows(weighted, "all", F.lit(""), f1_weighted=F.col("f1_weighted"))) \
        .union(rows(classes, "class", F.col("cls"), precision=F.col("precision"), recall=F.col("recall"), f1=F.col("f1"),
                    support=F.col("support"))) \
        .union(rows(shares, "source", F.col("source"), n=F.col("n"), share=F.col("n") / F.col("total")))


def majority_baseline(df: DataFrame, label: str = "label", split: str = "is_validation") -> DataFrame:
    """Most frequent training label (ties: smallest) and its validation accuracy."""
    maj = df.where(~F.col(split)).agg(F.mode(F.col(label), True)).scalar()
    val = df.where(F.col(split)).withColumn("majority_class", maj)
    return val.groupBy("majority_class").agg(
        F.avg((F.col(label) == F.col("majority_class")).cast("double")).alias("accuracy"),
        F.count(F.lit(1)).alias("n_validation"))


def source_breakdown(df: DataFrame, source: str = "source") -> DataFrame:
    """A14."""
    return df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
