"""M9: order-aware event-sequence classifier.

A sequence is read as a path from a start mark over its events to an end mark; an event
carries how often it has occurred so far ("purchase" for the second time is another step
than for the first).  Per class the model holds how often each step follows each other one:
smoothed first-order transition likelihoods times the class shares give the probabilities.

Fitting is grouped counts and scoring two equi-joins by step, so no vocabulary reaches the
driver: only the class shares and the number of distinct steps do.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailorspark import constants as K
from tailorspark.session import stored

START, END = "^", "$"
#: Added to every count.
SMOOTHING = 0.1
#: Places of a log likelihood that count; sums in another order differ beyond.
PLACES = 9


@dataclass
class SequenceModel:
    """``steps``: (before, after, n) and ``starts``: (before, n), n being an array of counts by class."""

    steps: DataFrame
    starts: DataFrame
    shares: list[float]
    n_steps: int
    smoothing: float = SMOOTHING


def transitions(df: DataFrame, seq_col: str, *keep: str, max_len: int = K.SEQUENCE_MAX_LEN) -> DataFrame:
    """(keep..., before, after): the steps of the first ``max_len`` events; none for an empty sequence."""
    events = df.select(*keep, F.slice(F.col(seq_col), 1, max_len).alias("_e")).where(F.size("_e") > 0)
    nth = F.transform("_e", lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(
        F.slice("_e", 1, i + 1), lambda y: y == x)).cast("string")))
    path = events.select(*keep, F.concat(F.array(F.lit(START)), nth, F.array(F.lit(END))).alias("_p"))
    pair = F.arrays_zip(F.slice("_p", 1, F.size("_p") - 1).alias("before"), F.slice("_p", 2, F.size("_p")).alias("after"))
    return path.select(*keep, F.inline(pair).alias("before", "after"))


def fit_sequence_model(seqs: DataFrame, num_classes: int, seq_col: str = "seq_tokens", label: str = "label",
                       smoothing: float = SMOOTHING) -> SequenceModel | None:
    """Counts over ``seqs`` (sequences and class numbers).  None below 20 rows or with one class."""
    sizes = {int(r["c"]): r["n"] for r in seqs.where(F.size(seq_col) > 0).groupBy(F.col(label).cast("int").alias("c"))
             .agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each class
    if sum(sizes.values()) < K.SEQUENCE_MIN_ROWS or len(sizes) < 2:
        return None

    def by_class(column):
        return F.array(*[F.sum(column(c)).cast("long") for c in range(num_classes)]).alias("n")

    of = F.col("_c")
    steps = transitions(seqs.withColumn("_c", F.col(label).cast("int")), seq_col, "_c").groupBy("before", "after").agg(
        by_class(lambda c: (of == c).cast("long")))
    steps = stored(steps, "sequence-steps")
    starts = stored(steps.groupBy("before").agg(by_class(lambda c: F.col("n")[c])), "sequence-starts")
    total = sum(sizes.values())
    shares = [(sizes.get(c, 0) + smoothing) / (total + smoothing * num_classes) for c in range(num_classes)]
    return SequenceModel(steps, starts, shares, steps.select("after").distinct().count(), smoothing)


def sequence_probability(df: DataFrame, model: SequenceModel, seq_col: str, key: str, out_col: str = "seq_prob") -> DataFrame:
    """``df`` with the class probabilities of its sequences (null for an empty one); ``key`` is unique in ``df``."""
    a, width = model.smoothing, model.smoothing * model.n_steps
    ln = [F.log(F.coalesce(F.col("_s")[c], F.lit(0)) * 1.0 + a) - F.log(F.coalesce(F.col("_t")[c], F.lit(0)) * 1.0 + width)
          for c in range(len(model.shares))]
    steps = model.steps.withColumnRenamed("n", "_s")
    starts = model.starts.withColumnRenamed("n", "_t")
    sums = transitions(df, seq_col, key).join(steps, ["before", "after"], "left").join(starts, "before", "left").groupBy(
        key).agg(F.array(*[F.round(F.sum(x) + math.log(p), PLACES) for x, p in zip(ln, model.shares)]).alias("_ll"))
    weight = F.transform("_ll", lambda x: F.exp(x - F.array_max("_ll")))
    total = F.aggregate("_w", F.lit(0.0), lambda s, x: s + x)
    probs = sums.select(key, weight.alias("_w")).select(key, F.transform("_w", lambda x: x / total).alias(out_col))
    return df.join(probs, key, "left")
