"""Fit of the deep model (M8) on large training splits: MLlib's network, loss, start and optimizer.

MLlib multiplies blocks of 64 rows in the JVM.  Here a row is stored once as its numbers and one
code a one-hot group (some 50 bytes); each step's loss and gradient are matrix products over
``BLOCK`` rows in numpy, one row of sums comes back from a task.  The optimizer is L-BFGS with the
line search of MLlib's, from the weights that MLlib starts with, and the result is MLlib's model.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.common import _java2py, _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailorspark.operators.forest import Coding, matrix
from tailorspark.session import stored

#: Rows multiplied at once, and the steps that the optimizer remembers.
BLOCK, MEMORY = 256, 10
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no path to this package


def _unrolled(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(outputs by inputs, bias) of each layer, as MLlib lays them out (columns first)."""
    out, at = [], 0
    for n_in, n_out in zip(layers, layers[1:]):
        w = weights[at:at + n_in * n_out].reshape(n_in, n_out).T
        out.append((w, weights[at + n_in * n_out:at + n_in * n_out + n_out]))
        at += n_in * n_out + n_out
    return out


def loss_and_gradient(x: np.ndarray, y: np.ndarray, weights: np.ndarray, layers: list[int]) -> tuple[float, np.ndarray]:
    """Sums over the rows of the cross entropy and of its gradient: sigmoid hidden units, softmax on top."""
    parts = _unrolled(weights, layers)
    seen = [x]
    for i, (w, b) in enumerate(parts):
        z = seen[-1] @ w.T + b
        if i + 1 < len(parts):
            np.negative(z, out=z)
            with np.errstate(over="ignore"):
                np.exp(z, out=z)
            z += 1
            seen.append(np.reciprocal(z, out=z))
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    total = p.sum(axis=1, keepdims=True)
    at = np.arange(len(y))
    loss = float((np.log(total[:, 0]) - z[at, y]).sum())
    delta = p / total
    delta[at, y] -= 1
    sums = []
    for i in range(len(parts) - 1, -1, -1):
        sums += [delta.sum(axis=0), (seen[i].T @ delta).ravel()]
        if i:
            delta = delta @ parts[i][0]
            delta *= seen[i] * (1 - seen[i])
    return loss, np.concatenate(sums[::-1])


def minimize(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """L-BFGS with a strong Wolfe line search, and the end conditions that MLlib's optimizer has."""
    value, grad = f(x)
    first, values, memory, failed = value, [value], [], False
    for step in range(steps):
        if np.linalg.norm(grad) <= max(tolerance * abs(value), 1e-8):
            break
        direction, back = -grad, []
        for s, d, r in reversed(memory):
            back.append(r * (s @ direction))
            direction = direction - back[-1] * d
        if memory:
            s, d, _ = memory[-1]
            direction = direction * ((s @ d) / (d @ d))
        for (s, d, r), a in zip(memory, reversed(back)):
            direction = direction + (a - r * (d @ direction)) * s
        found = _search(f, x, value, grad, direction, 1.0 if step else 1.0 / np.linalg.norm(direction))
        if found is None:
            if failed:
                break
            failed, memory = True, []  # once more, downhill
            continue
        new, value, new_grad = found
        s, d = new - x, new_grad - grad
        x, grad = new, new_grad
        if s @ d > 0:
            memory = [*memory, (s, d, 1.0 / (s @ d))][-MEMORY:]
        if abs(value - max(values)) <= tolerance * abs(first) and len(values) >= 2:
            break
        values = [*values, value][-20:]
    return x


def _search(f, x, value, grad, direction, t):
    """(point, value, gradient) along ``direction`` that meets the strong Wolfe conditions, None if none is found."""
    slope = grad @ direction

    def at(t):
        v, g = f(x + t * direction)
        return t, v, g @ direction, g

    def enough(c):
        return x + c[0] * direction, c[1], c[3]

    def zoom(low, high):
        for _ in range(10):
            a, b = (low, high) if low[0] <= high[0] else (high, low)
            d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
            d2 = np.sqrt(max(0.0, d1 * d1 - a[2] * b[2]))
            t = b[0] - (b[0] - a[0]) * (b[2] + d2 - d1) / (b[2] - a[2] + 2 * d2)
            width = b[0] - a[0]
            c = at(min(max(t, a[0] + 0.1 * width), a[0] + 0.9 * width))
            if c[1] > value + 1e-4 * c[0] * slope or c[1] >= low[1]:
                high = c
                continue
            if abs(c[2]) <= 0.9 * abs(slope):
                return enough(c)
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
        return None

    low = (0.0, value, slope, grad)
    for i in range(10):
        c = at(t)
        if not np.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return enough(c)
        if c[2] >= 0:
            return zoom(c, low)
        low, t = c, t * 1.5
    return None


def _packed(coding: Coding, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = matrix(b.column("x"), width), b.num_rows
            yield pa.RecordBatch.from_pydict({
                "n": pa.array([n], pa.int32()), "numbers": [x[:, coding.numbers].tobytes()],
                "slots": [coding.codes(x)[len(coding.numbers):].astype("u2").tobytes()],
                "y": [b.column("label").to_numpy(zero_copy_only=False).astype("u2").tobytes()]})
    return run


def _summed(coding: Coding, weights: np.ndarray, layers: list[int]):
    """Over the packed rows of a task: their number, loss and gradient."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, loss, gradient = 0, 0.0, np.zeros(len(weights))
        for batch in batches:
            for r in batch.to_pylist():
                n, y = r["n"], np.frombuffer(r["y"], "u2")
                numbers = np.frombuffer(r["numbers"]).reshape(n, -1)
                slots = np.frombuffer(r["slots"], "u2").reshape(-1, n)
                for a in range(0, n, BLOCK):
                    some = slice(a, min(n, a + BLOCK))
                    x = np.zeros((some.stop - a, layers[0]))
                    x[:, coding.numbers] = numbers[some]
                    for (first, size), code in zip(coding.groups, slots):
                        at = np.flatnonzero(code[some] < size)
                        x[at, first + code[some][at].astype(int)] = 1.0
                    part, sums = loss_and_gradient(x, y[some], weights, layers)
                    loss, gradient = loss + part, gradient + sums
                rows += n
        if rows:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64()), "loss": [loss], "gradient": [gradient.tobytes()]})
    return run


def fit_network(train: DataFrame, mlp, coding: Coding):
    """``mlp`` (a MultilayerPerceptronClassifier) fitted on ``train``; only the ``coding``'s layout is used."""
    spark = train.sparkSession
    layers = [int(n) for n in mlp.getLayers()]
    sizes = spark.sparkContext._gateway.new_array(spark._jvm.int, len(layers))
    for i, n in enumerate(layers):
        sizes[i] = n
    ann = spark._jvm.org.apache.spark.ml.ann.FeedForwardTopology.multiLayerPerceptron(sizes, True)
    start = _java2py(spark.sparkContext, ann.model(mlp.getSeed()).weights()).toArray()
    packed = stored(train.select(mlp.getLabelCol(), vector_to_array(mlp.getFeaturesCol()).alias("x")).withColumnRenamed(
        mlp.getLabelCol(), "label").mapInArrow(_packed(coding, layers[0]), "n int, numbers binary, slots binary, y binary"), "packed")

    def mean(weights: np.ndarray) -> tuple[float, np.ndarray]:
        found = packed.mapInArrow(_summed(coding, weights, layers), "rows long, loss double, gradient binary").collect()
        rows = sum(r["rows"] for r in found)
        return sum(r["loss"] for r in found) / rows, sum(np.frombuffer(r["gradient"]) for r in found) / rows

    weights = minimize(mean, start, mlp.getMaxIter(), mlp.getTol())
    made = spark._jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel(
        mlp.uid, _py2java(spark.sparkContext, DenseVector(weights)))
    return mlp._copyValues(mlp._create_model(made))
