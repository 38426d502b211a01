"""Training of the classifier head on ready features.

Multinomial logistic regression with class balancing and label smoothing. The
built-in estimator knows hard labels only; smoothing would take one weighted copy
of a row per class. Here each step is one pass over the cached rows in which every
task adds up its own gradient, so a row stays one row however many classes exist.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.functions import fixed
from tagloom.functions.vectors import _to_matrix, doubles
from tagloom.operators.evaluation import class_weights, vocabulary_names
from tagloom.operators.ranking import class_index, class_vocabulary
from tagloom.operators.scoring import LinearScorer
from tagloom.operators.sizing import settle

FAN_IN = 64  # tasks that merge the partial sums
MEMORY = 8  # past steps used to shape the next one
Add = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _total(rows: DataFrame, add: Add, n_parts: int) -> np.ndarray:
    """Sum of ``add(x, y, weight)`` over all batches: one vector per task, merged
    by ``FAN_IN`` tasks, then by one; a single vector, of the model's size, reaches the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                v = add(_to_matrix(b.column(0))[1], b.column(1).to_numpy(), b.column(2).to_numpy())
                total = v if total is None else total + v
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], type=pa.binary())], names=["v"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(0):
                v = np.frombuffer(v.as_buffer())
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], type=pa.binary())], names=["v"])

    parts = rows.mapInArrow(partial, "v binary")
    if n_parts > FAN_IN:
        spread = parts.withColumn("k", F.spark_partition_id() % FAN_IN)
        parts = spread.repartition(FAN_IN, "k").select("v").mapInArrow(merge, "v binary")
    if n_parts > 1:
        parts = parts.repartition(1).mapInArrow(merge, "v binary")
    return np.frombuffer(parts.first()["v"])


def _moments(x, y, w) -> np.ndarray:
    return np.concatenate([[w.sum()], w @ x, w @ (x * x)])


def _step(theta: np.ndarray, centre: np.ndarray, spread: np.ndarray, eps: float) -> Add:
    """Loss and gradient of one batch: [loss, d loss / d theta]."""
    classes = len(theta)

    def add(x, y, w) -> np.ndarray:
        x = (x - centre) / spread
        z = x @ theta[:, :-1].T + theta[:, -1]
        top = z.max(axis=1, keepdims=True)
        e = np.exp(z - top)
        norm = e.sum(axis=1, keepdims=True)
        at = np.arange(len(y)), y
        loss = (w * (top[:, 0] + np.log(norm[:, 0]) - (1 - eps) * z[at] - eps * z.mean(axis=1))).sum()
        r = e / norm - eps / classes
        r[at] -= 1 - eps
        r *= w[:, None]
        return np.concatenate([[loss], np.hstack([r.T @ x, r.sum(axis=0)[:, None]]).ravel()])

    return add


def _direction(g: np.ndarray, past: list) -> np.ndarray:
    """Limited-memory quasi-Newton direction from past (step, change) pairs."""
    q, alphas = g.copy(), []
    for s, y in reversed(past):
        a = (s @ q) / (s @ y)
        q -= a * y
        alphas.append(a)
    if past:
        s, y = past[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(past, reversed(alphas)):
        q += s * (a - (y @ q) / (s @ y))
    return -q


def _minimise(value: Callable, theta: np.ndarray, max_iter: int, tol: float) -> tuple[np.ndarray, bool]:
    """(best point, whether it is one: no better step exists). Each call of ``value`` is one distributed pass."""
    f, g = value(theta)
    past: list = []
    for _ in range(max_iter):
        d, rate = _direction(g, past), 1.0 if past else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        slope = g @ d
        if -slope <= 1e-14:
            return theta, True
        while True:
            new = theta + rate * d
            f_new, g_new = value(new)
            if f_new <= f + 1e-4 * rate * slope or rate < 1e-8:
                break
            rate /= 2
        if f_new > f:
            return theta, True
        s, y = new - theta, g_new - g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-MEMORY:]
        done = f - f_new <= tol * max(abs(f), 1.0)
        theta, f, g = new, f_new, g_new
        if done:
            return theta, True
    return theta, False


@dataclass
class Problem:
    """The rows of a training set, cached, and what every step needs to know of them: names of the classes, number of
    features, their weighted centre and spread, the sum of weights."""

    rows: DataFrame
    names: list[str]
    width: int
    centre: np.ndarray
    spread: np.ndarray
    weight: float
    eps: float
    n_parts: int

    def value(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and its gradient at weights (of scaled features) and biases, one row per class; one distributed pass."""
        t = _total(self.rows, _step(theta, self.centre, self.spread, self.eps), self.n_parts) / self.weight
        return t[0], t[1:].reshape(theta.shape)


@contextmanager
def _problem(df: DataFrame, features: str, label: str, eps: float, balanced: bool) -> Iterator[Problem]:
    vocab = settle(class_vocabulary(df, label))
    names = [str(n) for n in vocabulary_names(vocab)]
    indexed = class_index(df.filter(F.col(features).isNotNull()).select(features, label), label, vocab)
    weighted = class_weights(indexed, label) if balanced else indexed.withColumn("weight", F.lit(1.0))
    rows = weighted.select(
        doubles(F.col(features)).alias("x"), F.col("class_idx").cast("int").alias("y"), "weight").persist()
    try:
        n_parts = rows.rdd.getNumPartitions()
        m = _total(rows, _moments, n_parts)
        weight, width = m[0], (len(m) - 1) // 2
        centre = m[1:width + 1] / weight
        spread = np.sqrt(np.maximum(m[width + 1:] / weight - centre**2, 0.0))
        spread[spread < 1e-12] = 1.0
        yield Problem(rows, names, width, centre, spread, weight, eps, n_parts)
    finally:
        rows.unpersist()


def first_gradient(
    df: DataFrame, features: str, label: str, eps: float = fixed.LABEL_SMOOTHING, balanced: bool = True,
) -> DataFrame:
    """(class_name, feature, gradient): the slope of the loss at zero weights, per class and scaled feature; feature -1 is the bias.

    Large values tell which features separate which classes before any training; there the gradient has a closed form."""
    with _problem(df, features, label, eps, balanced) as problem:
        _, slope = problem.value(np.zeros((len(problem.names), problem.width + 1)))
    rows = [(n, j if j < problem.width else -1, float(slope[i, j])) for i, n in enumerate(problem.names) for j in range(problem.width + 1)]
    return df.sparkSession.createDataFrame(rows, "class_name string, feature int, gradient double")


def fit_head(
    df: DataFrame, features: str, label: str, eps: float = fixed.LABEL_SMOOTHING,
    reg: float = fixed.WEIGHT_DECAY, balanced: bool = True, max_iter: int = 30, tol: float = 1e-6,
    start: LinearScorer | None = None,
) -> LinearScorer:
    """Head with the least mean smoothed cross entropy plus ``reg/2`` times the
    squared weights (of features scaled to unit variance; the bias is free).

    ``start`` warm-starts from another head: classes it knows take its weights, new
    classes begin at zero. ``converged`` of the result is false if ``max_iter`` ended the search."""
    with _problem(df, features, label, eps, balanced) as problem:
        names, width, centre, spread = problem.names, problem.width, problem.centre, problem.spread

        def value(flat):
            theta = flat.reshape(len(names), width + 1)
            loss, slope = problem.value(theta)
            grad = slope + reg * np.hstack([theta[:, :-1], np.zeros((len(names), 1))])
            return loss + reg / 2 * (theta[:, :-1] ** 2).sum(), grad.ravel()

        theta = np.zeros((len(names), width + 1))
        if start is not None:
            known = {n: i for i, n in enumerate(start.names)}
            w, b = np.asarray(start.weights, dtype=float), np.asarray(start.bias, dtype=float)
            if w.shape[1] != width:
                raise ValueError(f"start has {w.shape[1]} features, the rows have {width}")
            for k, n in enumerate(names):
                if n in known:
                    theta[k, :-1], theta[k, -1] = w[known[n]] * spread, b[known[n]] + w[known[n]] @ centre
        best, converged = _minimise(value, theta.ravel(), max_iter, tol)
        theta = best.reshape(theta.shape)
    weights = theta[:, :-1] / spread
    return LinearScorer(names, weights.tolist(), (theta[:, -1] - weights @ centre).tolist(), converged)
