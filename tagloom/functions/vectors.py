"""Vector and probability functions.

Column functions are built from higher-order functions and run in the JVM; they
suit short arrays. Anything that multiplies a vector with a matrix goes through
an Arrow function (``matrix_softmax``, ``gate_softmax``) which hands numpy a
whole batch without copying row by row.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from tagloom.functions import fixed

_DOUBLES = "array<double>"


def doubles(vec: Column) -> Column:
    return vec.cast(_DOUBLES)


def array_total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return array_total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2_normalise(vec: Column) -> Column:
    """Vector of length one; the length is summed in double."""
    v = doubles(vec)
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)
    # the norm rides along in a struct so that it is computed once per row
    boxed = F.transform(F.array(F.struct(v.alias("v"), F.sqrt(squares).alias("n"))),
                        lambda s: F.transform(s["v"], lambda x: x / s["n"]))
    return boxed[0]


def softmax(logits: Column, scale: float = 1.0) -> Column:
    """Softmax of ``scale * logits``; the largest logit is subtracted first."""
    z = doubles(logits)
    shifted = F.transform(
        F.array(F.struct(z.alias("z"), F.array_max(z).alias("m"))),
        lambda s: F.transform(s["z"], lambda x: F.exp((x - s["m"]) * F.lit(float(scale)))),
    )[0]
    return F.transform(
        F.array(F.struct(shifted.alias("e"), array_total(shifted).alias("t"))),
        lambda s: F.transform(s["e"], lambda x: x / s["t"]),
    )[0]


def argmax(vec: Column) -> Column:
    """0-based position of the largest value; the lowest position wins a tie."""
    return (F.array_position(vec, F.array_max(vec)) - 1).cast("int")


def smoothed_cross_entropy(logits: Column, label: Column, eps: float = fixed.LABEL_SMOOTHING) -> Column:
    """``(1-eps)(-log p_y) + eps/K sum_k(-log p_k)``; ``eps=0`` is plain cross entropy."""
    z = doubles(logits)
    boxed = F.array(F.struct(z.alias("z"), F.array_max(z).alias("m"), label.cast("int").alias("y")))

    def loss(s):
        log_norm = s["m"] + F.log(F.aggregate(s["z"], F.lit(0.0), lambda acc, x: acc + F.exp(x - s["m"])))
        hit = log_norm - F.element_at(s["z"], s["y"] + 1)
        if eps == 0:
            return hit
        spread = log_norm - array_total(s["z"]) / F.size(s["z"])
        return F.lit(1.0 - eps) * hit + F.lit(float(eps)) * spread

    return F.transform(boxed, loss)[0]


def channel_normalise(values: Column, preset=fixed.IMAGENET_NORM) -> Column:
    """``(x/255 - mean) / std`` per interleaved channel."""
    mean, std = (_literal_array(p) for p in preset)
    n = len(preset[0])
    return F.transform(
        doubles(values),
        lambda x, i: (x / F.lit(255.0) - F.get(mean, i % n)) / F.get(std, i % n),
    )


def channel_restore(values: Column, preset=fixed.HALF_NORM) -> Column:
    """Inverse of :func:`channel_normalise` up to the factor 255."""
    mean, std = (_literal_array(p) for p in preset)
    n = len(preset[0])
    return F.transform(doubles(values), lambda x, i: x * F.get(std, i % n) + F.get(mean, i % n))


def _literal_array(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def median_bits(coefficients: Column) -> Column:
    """'1' where a coefficient is above the median of the array, '0' elsewhere."""
    boxed = F.array(F.struct(coefficients.alias("c"), F.sort_array(doubles(coefficients)).alias("s")))

    def bits(b):
        n = F.size(b["s"])
        low, high = F.get(b["s"], F.floor((n - 1) / 2).cast("int")), F.get(b["s"], F.floor(n / 2).cast("int"))
        middle = (low + high) / 2
        return F.array_join(
            F.transform(b["c"], lambda x: F.when(x.cast("double") > middle, "1").otherwise("0")), "")

    return F.transform(boxed, bits)[0]


# --- Arrow kernels ---------------------------------------------------------

def _to_matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """(mask of present rows, their vectors as one matrix)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    present = np.asarray(pc.is_valid(column).to_numpy(zero_copy_only=False), dtype=bool)
    kept = column.drop_null() if not present.all() else column
    rows = int(present.sum())
    flat = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return present, flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def _to_lists(matrix: np.ndarray, present: np.ndarray):
    """Arrow list column with a NULL wherever ``present`` is false."""
    return pa.ListArray.from_arrays(_offsets(present, matrix.shape[1]), pa.array(matrix.ravel(), type=pa.float64()))


def _offsets(present: np.ndarray, width: int):
    """List offsets; a NULL offset makes its row NULL."""
    ends = np.concatenate([[0], np.cumsum(np.where(present, width, 0))]).astype(np.int32)
    return pa.array(ends, type=pa.int32(), mask=np.concatenate([~present, [False]]))


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _softmax_rows(z: np.ndarray) -> np.ndarray:
    if z.size == 0:
        return z
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def matrix_softmax(features: Column, weights, bias=None, scale: float = 1.0, unit: bool = False) -> Column:
    """``softmax(scale * features . weightsT + bias)`` as array<double>.

    ``unit`` makes features and weight rows length one first. The weights are one
    model, shipped once per worker; rows with NULL features come back as NULL and
    are not scored."""
    w = np.asarray(weights, dtype=np.float64)
    w = _unit(w) if unit else w
    b = np.zeros(len(w)) if bias is None else np.asarray(bias, dtype=np.float64)

    @F.arrow_udf(_DOUBLES)
    def kernel(vec: pa.Array) -> pa.Array:
        present, x = _to_matrix(vec)
        if not present.any():
            return _to_lists(np.zeros((0, len(w))), present)
        x = _unit(x) if unit else x
        return _to_lists(_softmax_rows(scale * (x @ w.T) + b), present)

    return kernel(features)


BLOCK_ROWS = 256  # rows whose probabilities of all classes are held at once
_PAIR = pa.struct([("idx", pa.int32()), ("p", pa.float64())])
_MODELS: dict = {}  # models of this Python worker
MODELS_KEPT = 8


def _best(p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the k largest per row, the lower position first on a tie; ``p`` is overwritten."""
    at = np.arange(len(p))
    idx = np.empty((len(p), k), dtype=np.int32)
    val = np.empty((len(p), k))
    for j in range(k):
        idx[:, j] = p.argmax(axis=1)
        val[:, j] = p[at, idx[:, j]]
        p[at, idx[:, j]] = -np.inf
    return idx, val


def matrix_top(features: Column, weights, k: int, bias=None, scale: float = 1.0, unit: bool = False) -> Column:
    """array<struct<idx, p>>: the ``k`` most likely classes of :func:`matrix_softmax`.

    Product, softmax and ranking go block by block, so that a worker holds ``BLOCK_ROWS`` rows of
    probabilities however many classes there are."""
    w = np.asarray(weights, dtype=np.float64)
    w = _unit(w) if unit else w
    b = np.zeros(len(w)) if bias is None else np.asarray(bias, dtype=np.float64)
    width = min(k, len(w))

    @F.arrow_udf("array<struct<idx:int,p:double>>")
    def kernel(vec: pa.Array) -> pa.Array:
        present, x = _to_matrix(vec)
        idx, val = np.empty((len(x), width), dtype=np.int32), np.empty((len(x), width))
        for a in range(0, len(x), BLOCK_ROWS):
            rows = slice(a, a + BLOCK_ROWS)
            block = _unit(x[rows]) if unit else x[rows]
            idx[rows], val[rows] = _best(_softmax_rows(scale * (block @ w.T) + b), width)
        pairs = pa.StructArray.from_arrays([pa.array(idx.ravel()), pa.array(val.ravel())], fields=list(_PAIR))
        return pa.ListArray.from_arrays(_offsets(present, width), pairs)

    return kernel(features)


def loaded(key: str, make: Callable):
    """The model of ``key``, made once per Python worker as long as few models are in use."""
    if key not in _MODELS:
        if len(_MODELS) >= MODELS_KEPT:
            _MODELS.clear()
        _MODELS[key] = make()
    return _MODELS[key]


def model_probs(features: Column, make_predict: Callable, width: int, batch_size: int) -> Column:
    """array<double> from any model; rows with NULL features get NULL and do not reach it."""
    key = uuid.uuid4().hex

    @F.arrow_udf(_DOUBLES)
    def kernel(vec: pa.Array) -> pa.Array:
        present, x = _to_matrix(vec)
        if not present.any():
            return _to_lists(np.zeros((0, 0)), present)
        if x.shape[1] != width:
            raise ValueError(f"the model takes {width} features, the rows have {x.shape[1]}")
        predict = loaded(key, make_predict)
        out = [np.asarray(predict(x[a:a + batch_size]), dtype=np.float64) for a in range(0, len(x), batch_size)]
        return _to_lists(np.concatenate(out), present)

    return kernel(features)


def ranked_pairs(probs: Column, k: int) -> Column:
    """array<struct<idx, p>>: the k largest values, the lower position first on a
    tie. Chained behind another Arrow function it runs in the same Python pass, so
    only k pairs per row go back to the JVM."""
    kind = pa.struct([("idx", pa.int32()), ("p", pa.float64())])

    @F.arrow_udf("array<struct<idx:int,p:double>>")
    def kernel(vec: pa.Array) -> pa.Array:
        present, p = _to_matrix(vec)
        width = min(k, p.shape[1])
        order = np.argsort(-p, axis=1, kind="stable")[:, :width]
        pairs = pa.StructArray.from_arrays(
            [pa.array(order.ravel(), type=pa.int32()),
             pa.array(np.take_along_axis(p, order, axis=1).ravel(), type=pa.float64())], fields=list(kind))
        return pa.ListArray.from_arrays(_offsets(present, width), pairs)

    return kernel(probs)


def gate_softmax(features: Column, target: Column, shared, scale: float = fixed.SIMILARITY_SCALE) -> Column:
    """Softmax over slot 0 = the row's own target and slots 1.. = the shared vectors."""
    d = _unit(np.asarray(shared, dtype=np.float64))

    @F.arrow_udf(_DOUBLES)
    def kernel(vec: pa.Array, own: pa.Array) -> pa.Array:
        both = np.asarray(pc.and_(pc.is_valid(vec), pc.is_valid(own)).to_numpy(zero_copy_only=False), dtype=bool)
        if not both.any():
            return _to_lists(np.zeros((0, len(d) + 1)), both)
        if not both.all():
            vec, own = vec.filter(pa.array(both)), own.filter(pa.array(both))
        x, t = _unit(_to_matrix(vec)[1]), _unit(_to_matrix(own)[1])
        z = np.concatenate([(x * t).sum(axis=1, keepdims=True), x @ d.T], axis=1)
        return _to_lists(_softmax_rows(scale * z), both)

    return kernel(features, target)


@lru_cache(maxsize=256)
def lanczos_weights(size_in: int, size_out: int) -> np.ndarray:
    """Rows of a Lanczos (a=3) resampling matrix with antialiasing."""
    ratio = size_in / size_out
    stretch = max(ratio, 1.0)
    support = 3.0 * stretch
    out = np.zeros((size_out, size_in))
    for i in range(size_out):
        centre = (i + 0.5) * ratio
        lo, hi = max(int(centre - support + 0.5), 0), min(int(centre + support + 0.5), size_in)
        x = (np.arange(lo, hi) + 0.5 - centre) / stretch
        w = np.where(np.abs(x) < 3.0, np.sinc(x) * np.sinc(x / 3.0), 0.0)
        out[i, lo:hi] = w / w.sum()
    return out


@lru_cache(maxsize=8)
def dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n)[:, None]
    return 2.0 * np.cos(math.pi * k * (2 * np.arange(n)[None, :] + 1) / (2 * n))
