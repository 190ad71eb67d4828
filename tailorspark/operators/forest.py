"""Random forests on large training splits (M6, M7), beside MLlib's on small ones.

MLlib deals the rows to tasks, and every task builds, sends and merges statistics of all nodes
of a level.  Here a row becomes one code a column (a number's bin, the slot of a one-hot group),
10 to 25 bytes in all; every task gets all coded rows and grows whole trees of its own, so that no
statistics travel and all forests of a stack grow in one job.  A tree is grown as MLlib grows it:
Poisson bootstrap, numbers cut at 31 quantiles of a sample, a seeded choice of sqrt(d) features
for each node, the split of highest Gini gain, no further than ``depth`` or a pure node, and
leaves that predict the same class joined afterwards.

What a task holds grows with the rows (their codes, and 10 bytes each for the tree at hand), so
``MOST_ROWS`` bounds it; more rows are left to MLlib.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailorspark.session import stored

#: Forests are grown here from so many rows to so many: below, MLlib takes seconds; beyond, a task could not hold them.
FEWEST_ROWS, MOST_ROWS = 50_000, 20_000_000
BINS, SAMPLE = 32, 10_000
#: Rows that a step works on at once (its arrays stay in the processor's cache), and cells of a table of statistics.
CHUNK, CELLS = 1 << 17, 1 << 22
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no path to this package
_TREE = "forest int, tree int, col binary, low binary, span binary, left binary, p binary"


@dataclass
class Coding:
    """One code a column: the bin of feature ``numbers[i]`` among ``cuts[i]``; the slot that is set of the one-hot group
    (first feature, slots), or the number of slots if none is."""

    numbers: list[int]
    cuts: list[list[float]]
    groups: list[tuple[int, int]]

    @property
    def sizes(self) -> list[int]:
        """Codes of each column, the numbers first."""
        return [len(c) + 1 for c in self.cuts] + [n + 1 for _, n in self.groups]

    @property
    def dtype(self):
        return np.dtype("u1" if max(self.sizes) < 255 else "u2")

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(columns, rows) of the feature vectors ``x``."""
        out = np.empty((len(self.sizes), len(x)), self.dtype)
        for i, (j, cuts) in enumerate(zip(self.numbers, self.cuts)):
            out[i] = np.searchsorted(np.asarray(cuts, float), x[:, j])  # a value at a cut belongs below it
        for i, (first, n) in enumerate(self.groups, len(self.numbers)):
            slots = x[:, first:first + n] > 0.5
            out[i] = np.where(slots.any(axis=1), slots.argmax(axis=1), n) if n else 0
        return out


def cut_points(values: np.ndarray, bins: int = BINS) -> list[float]:
    """Where MLlib cuts a number: between its values if they are few, else near the quantiles of ``values``."""
    found, n = np.unique(values[~np.isnan(values)], return_counts=True)
    middle = (found[:-1] + found[1:]) / 2
    if len(middle) < bins:
        return middle.tolist()
    cuts, stride, seen = [], n.sum() / bins, int(n[0])
    target = stride
    for i in range(1, len(found)):
        before, seen = seen, seen + int(n[i])
        if abs(before - target) < abs(seen - target):
            cuts.append(float(middle[i - 1]))
            target += stride
    return cuts


def fit_coding(train: DataFrame, rows: int, groups: list[tuple[int, int]], features: int, seed: int) -> Coding:
    """The coding of ``train``'s ``features``: ``groups`` are one-hot, all others are numbers."""
    slots = {i for first, n in groups for i in range(first, first + n)}
    numbers = [i for i in range(features) if i not in slots]
    x = vector_to_array("features")
    sample = train.select(F.array(*[F.get(x, F.lit(i)) for i in numbers]).alias("x")).sample(
        fraction=min(1.0, SAMPLE / max(1, rows)), seed=seed)
    found = np.array([r["x"] for r in sample.collect()], float).reshape(-1, len(numbers))  # some SAMPLE rows
    return Coding(numbers, [cut_points(found[:, i]) for i in range(len(numbers))], groups)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


# -- growing -------------------------------------------------------------------
def _statistics(cells, size, classes, rows, node, w, taken) -> np.ndarray:
    """(taken nodes, codes, classes) weights of the rows, which come in the order of their nodes.
    ``cells``: code and class of all rows as one number."""
    n = int(taken.sum())
    start = (np.cumsum(taken) - 1) * (size * classes)
    out = np.zeros(n * size * classes)
    for a in range(0, len(rows), CHUNK):
        at, nodes, weight = rows[a:a + CHUNK], node[a:a + CHUNK], w[a:a + CHUNK]
        if n < len(taken):
            some = np.flatnonzero(taken.take(nodes))
            if not len(some):
                continue
            at, nodes, weight = at.take(some), nodes.take(some), weight.take(some)
        low = int(start[nodes[0]])
        key = start.take(nodes)
        key += cells.take(at)
        key -= low
        part = np.bincount(key, weight)
        out[low:low + len(part)] += part
    return out.reshape(-1, size, classes)


def _best_splits(cells, top, sizes, numbers, classes, rows, node, w, totals, picked):
    """(column, low, span, weights of the right side) of each node's best split; column -1 where none gains.

    A code goes right if it lies in [low, low + span)."""
    n = len(totals)
    weight = totals.sum(axis=1)
    best = (totals ** 2).sum(axis=1) / weight * (1 + 1e-12)  # what a split has to exceed: no gain, no split
    col, low, span, right = np.full(n, -1), np.zeros(n, int), np.zeros(n, int), np.zeros((n, classes))
    first = 0
    for c, size in enumerate(sizes):
        number = c < numbers
        wanted = picked[:, first:first + (1 if number else size - 1)]
        first += wanted.shape[1]
        taken = wanted.any(axis=1)
        if size < 2 or not taken.any():
            continue
        at = np.flatnonzero(taken)
        h = _statistics(cells[c], size, classes, rows, node, w, taken)
        t, all_ = totals[at][:, None], weight[at][:, None]
        if number:
            over = t - np.cumsum(h, axis=1)[:, :-1]
        else:
            over = h[:, :-1]
        under = t - over
        r = over.sum(axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            score = (over ** 2).sum(axis=2) / r + (under ** 2).sum(axis=2) / (all_ - r)
        score[(r < 1) | (all_ - r < 1)] = -1
        if not number:
            score[~wanted[at]] = -1
        k = score.argmax(axis=1)
        value = score[np.arange(len(at)), k]
        better = value > best[at]
        to, k, inside = at[better], k[better], over[better, k[better]]
        best[to], col[to], right[to] = value[better], c, inside
        low[to], span[to] = (k + 1, top - k - 1) if number else (k, 1)
    return col, low, span, right


def with_classes(codes: np.ndarray, y: np.ndarray, sizes: list[int], classes: int) -> np.ndarray:
    """(columns, rows): code and class as one number."""
    out = codes.astype(np.min_scalar_type(max(sizes) * classes))
    out *= out.dtype.type(classes)
    out += y.astype(out.dtype)
    return out


def grow(codes: np.ndarray, y: np.ndarray, sizes: list[int], numbers: int, classes: int, depth: int,
         rng: np.random.Generator, w: np.ndarray | None = None, cells: np.ndarray | None = None) -> dict:
    """One tree over ``codes`` (columns, rows) and labels ``y``; ``w``: weights of the rows, else a Poisson draw.
    ``cells``: ``with_classes`` of them, if it is at hand."""
    w = rng.poisson(1.0, len(y)).astype(np.uint8) if w is None else w
    cells = with_classes(codes, y, sizes, classes) if cells is None else cells
    rows = np.flatnonzero(w).astype(np.int32)
    w = w[rows]
    features = sum(1 if c < numbers else s - 1 for c, s in enumerate(sizes))
    per_node = math.ceil(math.sqrt(features))
    node = np.zeros(len(rows), np.int32)  # place among the nodes that may split
    totals = np.bincount(y[rows], w, classes)[None]
    opened = np.array([bool(len(rows)) and totals.max() < totals.sum()])
    levels = []
    flat, top = codes.ravel(), 1 << (8 * codes.dtype.itemsize)
    for level in range(depth + 1):
        made = {"totals": totals, **{k: np.zeros(len(totals), int) for k in ("low", "span")}, "col": np.full(len(totals), -1)}
        levels.append(made)
        if level == depth or not opened.any():
            break
        t = totals[opened]
        picked = np.zeros((len(t), features), bool)
        np.put_along_axis(picked, np.argpartition(rng.random((len(t), features)), per_node - 1, axis=1)[:, :per_node], True, 1)
        # nodes in turns whose statistics stay small; the rows of a turn lie together
        turn = max(1, CELLS // (max(sizes) * classes))
        edges = np.searchsorted(node, np.arange(0, len(t) + turn, turn).clip(max=len(t)))
        parts = []
        for i, a in enumerate(range(0, len(t), turn)):
            own = slice(edges[i], edges[i + 1])
            parts.append(_best_splits(cells, top, sizes, numbers, classes, rows[own], node[own] - np.int32(a), w[own],
                                      t[a:a + turn], picked[a:a + turn]))
        col, low, span, right = (np.concatenate(x) for x in zip(*parts))
        at = np.flatnonzero(opened)
        made["col"][at], made["low"][at], made["span"][at] = col, low, span
        split = col >= 0
        if not split.any():
            break
        totals = np.stack([t[split] - right[split], right[split]], axis=1).reshape(-1, classes)
        opened = totals.max(axis=1) < totals.sum(axis=1)
        if level + 1 == depth:
            opened[:] = False
            continue
        # the rows of each node that may split, in the order of those
        place = np.where(opened, np.cumsum(opened) - 1, len(opened)).astype(np.int32)
        under = np.full(2 * len(split), len(opened), np.int32)
        under[np.repeat(split, 2)] = place
        start, low, span = np.maximum(col, 0) * codes.shape[1], low.astype(codes.dtype), span.astype(codes.dtype)
        to = np.empty(len(rows), np.int32)
        for a in range(0, len(rows), CHUNK):
            of = node[a:a + CHUNK]
            at = start.take(of)
            at += rows[a:a + CHUNK]
            goes = flat.take(at) - low.take(of) < span.take(of)
            to[a:a + CHUNK] = under.take(2 * of + goes)
        order = np.argsort(to.astype(np.uint16) if len(opened) < 65_536 else to, kind="stable")
        order = order[:np.count_nonzero(to < len(opened))]
        rows, node, w = rows.take(order), to.take(order), w.take(order)
    return _flat(levels, codes.dtype)


def _flat(levels: list[dict], dtype) -> dict:
    """The nodes level by level as arrays, without splits whose leaves predict the same; a leaf's ``left`` is itself, and
    ``p`` has the class shares of the leaves alone, in their order."""
    for above, below in zip(levels[-2::-1], levels[:0:-1]):
        split = np.flatnonzero(above["col"] >= 0)
        leaf, says = below["col"] < 0, below["totals"].argmax(axis=1)
        same = leaf[0::2] & leaf[1::2] & (says[0::2] == says[1::2])
        above["col"][split[same]] = -2  # its children still lie in the level below
    kept, first, out = np.ones(1, bool), 0, []
    for level, made in enumerate(levels):
        col = made["col"]
        n, there = int(kept.sum()), col[kept] >= 0
        left = np.arange(first, first + n)
        left[there] = first + n + 2 * np.arange(int(there.sum()))
        p = made["totals"][kept][~there]
        out.append((np.maximum(col[kept], 0).astype("u2"), np.where(there, made["low"][kept], 0).astype("u2"),
                    np.where(there, made["span"][kept], 0).astype("u2"), left.astype("i4"),
                    (p / np.maximum(p.sum(axis=1, keepdims=True), 1)).astype("f4")))
        had = (col >= 0) | (col == -2)
        kept, first = np.repeat((kept & (col >= 0))[had], 2), first + n
        if not kept.any():
            break
    return dict(zip(("col", "low", "span", "left", "p"), (np.concatenate(x) for x in zip(*out))))


def _coded(coding: Coding, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, b in enumerate(batches):
            x = coding.codes(matrix(b.column("x"), width))
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([i], pa.int32()), "codes": [x.tobytes()],
                "y": [b.column("label").to_numpy(zero_copy_only=False).astype("u2").tobytes()],
                "fold": [b.column("fold").to_numpy(zero_copy_only=False).astype("i1").tobytes()]})
    return run


def _grown(coding: Coding, classes: int, plans: list[tuple[int, int]], trees: int, depth: int, seed: int, tasks: int):
    """Grows the trees whose number is the task's, modulo ``tasks``, over all rows.  ``plans``: (seed, fold left out or -1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for b in batches:
            blocks += b.to_pylist()
        if not blocks:
            return
        blocks.sort(key=lambda r: (r["part"], r["block"]))  # the draws follow the rows
        mine = blocks[0]["task"]
        y = np.concatenate([np.frombuffer(r["y"], "u2") for r in blocks])
        fold = np.concatenate([np.frombuffer(r["fold"], "i1") for r in blocks])
        codes = np.concatenate([np.frombuffer(r["codes"], coding.dtype).reshape(len(coding.sizes), -1) for r in blocks], axis=1)
        blocks.clear()
        held = None
        for number in range(mine, trees * len(plans), tasks):
            forest, tree = divmod(number, trees)
            own, without = plans[forest]
            if held is None or held[0] != forest:
                use = fold != without
                held = (forest, *((codes, y) if use.all() else (np.ascontiguousarray(codes[:, use]), y[use])))
                held = (*held, with_classes(*held[1:], coding.sizes, classes))
            made = grow(held[1], held[2], coding.sizes, len(coding.numbers), classes, depth,
                        np.random.default_rng([own, forest, tree]), cells=held[3])
            yield pa.RecordBatch.from_pydict({"forest": pa.array([forest], pa.int32()), "tree": pa.array([tree], pa.int32()),
                                              **{k: [v.tobytes()] for k, v in made.items()}})
    return run


def fit_forests(train: DataFrame, coding: Coding, width: int, classes: int, folds: list[int], trees: int, depth: int,
                seed: int) -> list[Forest]:
    """A forest for each of ``folds``, fitted on the rows of other folds (``_fold``; -1: on all rows)."""
    spark = train.sparkSession
    tasks = min(trees * len(folds), 2 * spark.sparkContext.defaultParallelism)
    rows = train.select("label", F.col("_fold").alias("fold"), vector_to_array("features").alias("x"))
    coded = stored(rows.mapInArrow(_coded(coding, width), "part int, block int, codes binary, y binary, fold binary"), "coded")
    dealt = coded.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).repartitionById(tasks, F.col("task"))
    grown = stored(dealt.mapInArrow(_grown(coding, classes, [(seed, f) for f in folds], trees, depth, seed, tasks), _TREE), "trees")
    return [Forest.of(grown.where(F.col("forest") == i), coding, width, classes) for i in range(len(folds))]


# -- the model -----------------------------------------------------------------
class Forest:
    """A fitted forest: the nodes of all trees in one array each, ``starts`` their roots."""

    def __init__(self, trees: list[dict], coding: Coding, width: int, classes: int):
        self.trees, self.coding, self.width, self.classes = trees, coding, width, classes
        self._sent = None

    @classmethod
    def of(cls, rows: DataFrame, coding: Coding, width: int, classes: int) -> Forest:
        """From rows of ``_TREE``; the nodes are bounded by trees and depth."""
        def tree(r):
            return {"col": np.frombuffer(r["col"], "u2"), "low": np.frombuffer(r["low"], "u2"),
                    "span": np.frombuffer(r["span"], "u2"), "left": np.frombuffer(r["left"], "i4"),
                    "p": np.frombuffer(r["p"], "f4").reshape(-1, classes)}
        return cls([tree(r) for r in sorted(rows.collect(), key=lambda r: r["tree"])], coding, width, classes)

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def score(self, x: np.ndarray) -> np.ndarray:
        """(rows, classes): the mean of the trees' class shares."""
        n = len(x)
        codes = self.coding.codes(x).astype("u2").ravel()
        place, out = np.arange(n), np.zeros((n, self.classes))
        for t in self.trees:
            node, col, low, span, left = np.zeros(n, np.int32), t["col"].astype(np.int64) * n, t["low"], t["span"], t["left"]
            while True:
                to = left[node] + (codes[col[node] + place] - low[node] < span[node])
                if np.array_equal(to, node):  # at leaves all
                    break
                node = to
            leaf = np.cumsum(left == np.arange(len(left))) - 1
            out += t["p"][leaf[node]]
        return out / max(1, len(self.trees))

    def probability(self, spark, features: str) -> Column:
        """array<double> of ``score`` for the vectors in column ``features``."""
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(self.trees)
        sent, coding, width, classes = self._sent, self.coding, self.width, self.classes

        def score(vectors: pa.Array) -> pa.Array:
            p = Forest(sent.value, coding, width, classes).score(matrix(vectors, width))
            return pa.ListArray.from_arrays(np.arange(0, p.size + 1, classes, dtype="i4"), p.ravel())

        return F.arrow_udf(score, "array<double>")(vector_to_array(features))

    def save(self, spark, path: str) -> None:
        rows = [(0, i, *(t[k].tobytes() for k in ("col", "low", "span", "left", "p"))) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, _TREE).write.mode("overwrite").parquet(f"{path}/trees")
        c = self.coding
        said = json.dumps({"coding": [c.numbers, c.cuts, c.groups], "width": self.width, "classes": self.classes})
        spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/coding")

    @classmethod
    def load(cls, spark, path: str) -> Forest:
        said = json.loads(spark.read.text(f"{path}/coding").first()[0])
        numbers, cuts, groups = said["coding"]
        return cls.of(spark.read.parquet(f"{path}/trees"), Coding(numbers, cuts, [tuple(g) for g in groups]), said["width"],
                      said["classes"])
