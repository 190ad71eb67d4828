"""Quality scores from pairwise preferences (Bradley-Terry).

A document's strength is a linear function of features of its form.  Every
labelled document that may be learned from is: each one with label 1 is preferred to
``PAIRS_EACH`` with label 0, and the weights maximise the likelihood of the
preferences: logistic loss on feature differences, so only the order of strengths
is learned.  Spark makes the pairs by a join and sums the derivatives of a Newton
step over them; sums and single rows are all that reaches the driver.  The score
puts the strength on a 0..1 scale by quantiles: it is ``CUT`` at the strength that
keeps as large a share as carries label 1 among all usable labels; a label's
documents are weighted by its share of them.

Defined results: null and empty texts are scored as texts without words.
Without both labels nothing is learned: every score is 0.5.  A doc_id under both
labels counts by each; of several texts under one doc_id the smallest is learned from.
A null doc_id is never learned from.  Rows repeat as they come; columns besides
doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailorspark.llm.textstats import COUNTS, measure
from tailorspark.operators.partitioning import dense_index
from tailorspark.session import discard, stored

#: Feature rows that one task numbers, and pairs per preferred document.
TASK_ROWS = 10_000
PAIRS_EACH = 8
CUT = 0.7
_STEPS, _RIDGE = 30, 1e-3


def features(texts) -> np.ndarray:
    """[text, feature]: size, and shares that do not depend on it."""
    m = dict(zip(COUNTS, measure(texts).T.astype(float)))
    words, letters = np.maximum(m["n_words"], 1), np.maximum(m["n_letters"], 1)
    chars, lines = np.maximum(m["word_chars"], 1), np.maximum(m["n_lines"], 1)

    def share(x):
        return np.sqrt(np.minimum(x, 4.0))  # small shares already tell

    cols = [
        np.log1p(m["n_words"]), np.minimum(m["n_words"], 50) / 50, share(m["n_symbols"] / words),
        share(m["n_dup_lines"] / lines), share(m["n_repeat_words"] / words), m["n_distinct_words"] / words,
        np.log1p(m["n_distinct_words"]), share(m["n_upper"] / letters), share(m["n_digits"] / chars),
        share(m["n_marks"] / words), np.minimum(m["word_chars"] / words, 20) / 10, m["n_letters"] / chars,
        (m["n_symbols"] > 0).astype(float), (2 * m["n_upper"] > m["n_letters"]).astype(float),
    ]
    return np.stack(cols, axis=1)


class Ranker:
    """Weights, the features' scale, and the scale of the score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, width: float):
        self.mean, self.scale, self.weights, self.cut, self.width = mean, scale, weights, cut, width

    def scores(self, texts) -> np.ndarray:
        x = ((features(texts) - self.mean) / self.scale) @ self.weights
        z = (x - self.cut) / self.width + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _derivatives(pairs: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all pairs of the gradient and the second derivatives of the logistic loss at ``w``."""
    k = len(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(k + k * k)
        for b in batches:
            diff = np.array(b["diff"].tolist()).reshape(-1, k)
            p = 1 / (1 + np.exp(-np.clip(diff @ w, -30, 30)))
            total += np.concatenate([diff.T @ (p - 1), ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()])
        yield pd.DataFrame({"place": range(len(total)), "value": total})

    sums = pairs.mapInPandas(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(k + k * k)
    for r in sums.collect():
        out[r["place"]] = r["value"]
    return out[:k], out[k:].reshape(k, k)


def _learn(pairs: DataFrame, n_pairs: int, k: int) -> np.ndarray:
    w = np.zeros(k)
    for _ in range(_STEPS):  # Newton's method on the logistic loss
        slope, bend = _derivatives(pairs, w)
        step = np.linalg.solve(bend / n_pairs + _RIDGE * np.eye(k), slope / n_pairs + _RIDGE * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.round(w, 7)  # sums of the tasks come in any order


def _cut(strengths: DataFrame, sizes: dict, found: dict, buckets: int) -> float:
    """Middle of the gap that separates the label 0 share of the weighted strengths from the rest."""
    total = sum(found.values())
    placed = dense_index(strengths, ["s", "quality", "doc_id"], index_col="i", buckets=buckets)
    placed = dense_index(placed, ["s", "doc_id"], ["quality"], index_col="r", buckets=buckets)
    own, other = (F.when(F.col("quality") == 1, F.lit(sizes[q] / found[q])).otherwise(F.lit(sizes[1 - q] / found[1 - q]))
                  for q in (1, 0))
    below = own * (F.col("r") + 1) + other * (F.col("i") - F.col("r"))
    placed = stored(placed.select("i", "s", below.alias("below")), "quality-cut")
    first = placed.where(F.col("below") >= sizes[0] - 1e-6).agg(F.min("i")).first()[0]
    i = total - 2 if first is None else min(first, total - 2)
    out = placed.where(F.col("i").between(i, i + 1)).agg(F.avg("s")).first()[0]
    discard(placed)
    return float(out)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = TASK_ROWS) -> Ranker | None:
    """Learn from all labelled documents where ``usable`` (a condition on doc_id) holds.

    ``rows``: feature rows that one task numbers.
    """
    labelled = labels.where(usable & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(
        F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    sizes = {r["quality"]: r["n"] for r in labelled.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    labelled, texts = labelled.distinct(), docs.select("doc_id", "text").where(usable & F.col("doc_id").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "x": list(features(b["text"].tolist()))})

    # features are what meets the labels; only texts of ids that occur again are shuffled, for the smallest of an id
    again = stored(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "quality-again")
    measured = texts.mapInPandas(run, "doc_id long, x array<double>").join(labelled, "doc_id").join(again, "doc_id", "left_anti")
    if not again.isEmpty():
        least = texts.join(again, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
        measured = measured.unionByName(least.mapInPandas(run, "doc_id long, x array<double>").join(labelled, "doc_id"))
    feats = stored(measured.select("doc_id", "quality", "x"), "quality-features")
    discard(again)
    k = features([""]).shape[1]
    x = [F.col("x")[i] for i in range(k)]
    found = {r["quality"]: r["n"] for r in feats.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(found) < 2:
        discard(feats)
        return None
    moments = feats.agg(*[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    mean, scale = np.array(moments[:k]), np.maximum(np.array(moments[k:]), 1e-9)
    buckets = -(-sum(found.values()) // rows)
    bad = dense_index(feats.where("quality = 0").select("doc_id", F.col("x").alias("y")), ["doc_id"], index_col="j",
                      buckets=buckets).drop("doc_id")
    good = feats.where("quality = 1").select("doc_id", "x", F.explode(F.sequence(F.lit(1), F.lit(PAIRS_EACH))).alias("d"))
    pairs = good.withColumn("j", F.pmod(F.xxhash64("doc_id", "d"), F.lit(found[0]))).join(bad, "j")
    pairs = stored(pairs.select(F.array(*[(c - F.col("y")[i]) / float(scale[i]) for i, c in enumerate(x)]).alias("diff")),
                   "quality-pairs")
    weights = _learn(pairs, found[1] * PAIRS_EACH, k)
    strength = sum(((c - float(mean[i])) * float(weights[i] / scale[i]) for i, c in enumerate(x)), F.lit(0.0))
    strengths = stored(feats.select("doc_id", "quality", strength.alias("s")), "quality-strengths")
    cut = _cut(strengths, sizes, found, buckets)
    width = max(strengths.agg(F.stddev_pop("s")).first()[0] / 4, 1e-9)
    discard(feats, pairs, strengths)
    return Ranker(mean, scale, weights, cut, width)


def score(docs: DataFrame, ranker: Ranker | None) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs`` (doc_id, text); a map-only pass."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = 0.5 if ranker is None else ranker.scores(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": s})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double")
