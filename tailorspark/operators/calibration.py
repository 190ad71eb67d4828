"""Sigmoid calibration of class scores (M7), all folds and classes in one aggregation a step.

Every (fold, class) has a curve 1 / (1 + exp(-(a x + b))) from the class's score to its
probability, fitted by maximum likelihood to smoothed targets: (n+ + 1) / (n+ + 2) for rows of
the class, 1 / (n- + 2) for others, so that separable scores have a finite fit.  Newton steps
need six sums over the rows; a step that makes a curve worse is halved for that curve.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, TOLERANCE = 50, 1e-8
#: Scores without any effect on the curve keep its slope finite.
RIDGE = 1e-9


def _sums(rows: DataFrame, curves: dict[tuple[int, int], tuple[float, float]], classes: int) -> dict:
    """(fold, class) -> loss, gradient and second derivatives at ``curves``; one row for each comes back."""
    table = F.create_map(*[x for (f, c), (a, b) in curves.items() for x in (
        F.lit(f * classes + c), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    at = rows.withColumn("_curve", table[F.col("fold") * classes + F.col("cls")])
    z = F.col("_curve.a") * F.col("x") + F.col("_curve.b")
    t = F.col("t")
    # ln(1 + e^z) - t z, without overflow
    at = at.select("fold", "cls", "x", t, z.alias("z")).withColumn("p", 1.0 / (1.0 + F.exp(-F.col("z"))))
    loss = F.greatest(F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - t * F.col("z")
    w, d, x = F.col("p") * (1 - F.col("p")), F.col("p") - t, F.col("x")
    found = at.groupBy("fold", "cls").agg(F.sum(loss), F.sum(d * x), F.sum(d), F.sum(w * x * x), F.sum(w * x), F.sum(w))
    return {(r[0], r[1]): tuple(r)[2:] for r in found.collect()}


def fit_curves(scores: DataFrame, classes: int) -> dict[tuple[int, int], tuple[float, float]]:
    """(fold, class) -> (a, b).  ``scores``: fold, label and ``p``, the array of class scores.

    A class without rows in a fold has probability 0 there.
    """
    sizes = {(r["fold"], r["label"]): r["n"] for r in scores.groupBy(
        "fold", F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()}
    folds = {f for f, _ in sizes}
    total = {f: sum(n for (g, _), n in sizes.items() if g == f) for f in folds}
    out = {(f, c): (0.0, -30.0) for f in folds for c in range(classes)}
    open_ = {k: (0.0, math.log((sizes[k] + 1) / (total[k[0]] - sizes[k] + 1))) for k in out if k in sizes}
    target = {k: ((sizes[k] + 1) / (sizes[k] + 2), 1 / (total[k[0]] - sizes[k] + 2)) for k in open_}
    if not open_:
        return out
    targets = F.create_map(*[x for (f, c), (hit, miss) in target.items() for x in (
        F.lit(f * classes + c), F.struct(F.lit(hit).alias("hit"), F.lit(miss).alias("miss")))])
    rows = scores.select("fold", F.col("label").cast("int").alias("label"), F.posexplode("p").alias("cls", "x"))
    rows = rows.withColumn("_t", targets[F.col("fold") * classes + F.col("cls")]).where(F.col("_t").isNotNull())
    rows = rows.select("fold", "cls", "x", F.when(F.col("label") == F.col("cls"), F.col("_t.hit")).otherwise(
        F.col("_t.miss")).alias("t"))
    best = _sums(rows, open_, classes)
    step = dict.fromkeys(open_, 1.0)
    for _ in range(STEPS):
        tried = {}
        for k, (a, b) in open_.items():
            _, ga, gb, haa, hab, hbb = best[k]
            haa, hbb = haa + RIDGE, hbb + RIDGE
            det = haa * hbb - hab * hab
            tried[k] = (a - step[k] * (hbb * ga - hab * gb) / det, b - step[k] * (haa * gb - hab * ga) / det)
        found = _sums(rows, tried, classes)
        settled = []
        for k, new in tried.items():
            gain = best[k][0] - found[k][0]
            if gain >= 0:
                open_[k], best[k], step[k] = new, found[k], 1.0
            else:
                step[k] /= 2
            if abs(gain) <= TOLERANCE * (1 + abs(best[k][0])) or step[k] < 1e-6:
                settled.append(k)
        for k in settled:
            out[k] = open_.pop(k)
        if not open_:
            break
    return out | open_
