"""Whitening of embeddings by Jacobi-Davidson: the covariance is met only as a product and never formed.

A product of the covariance with a few vectors is one distributed pass over the centred fit list. A search space gives Ritz pairs
(Rayleigh-Ritz); each unconverged pair asks a correction equation, projected off the pairs at hand, that an inner MINRES solves
roughly with such passes; the corrections widen the space. Pairs whose residual is down to rounding are locked and projected out.
The equations of all pairs advance together, so a pass serves a block of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tagloom.llm.batches import written

#: Components returned at most, and further pairs that are searched along so that the last ones converge.
MOST, GUARD = 16, 4
#: MINRES steps of a correction at most, and the share of its residual that is good enough.
STEPS, ROUGH = 8, 0.05
#: Vectors of a search space at most; beyond, it starts again from its best Ritz vectors.
SPACE = 120
#: A pair is locked if its residual is at most so large, as a share of the largest eigenvalue.
ROUNDING = 256 * np.finfo(float).eps
#: Eigenvalues below this share of the largest are zero: their direction has no spread to scale.
FLAT = 1e-12
#: Entries are clipped here, so that their grid value is a whole number in double precision.
LIMIT = float(1 << 52)
#: Numbers of a block of the fit list.
BLOCK = 1 << 20
SEED = 11

Product = Callable[[np.ndarray], np.ndarray]


def minres(apply: Product, b: np.ndarray, steps: int = STEPS, rough: float = ROUGH) -> np.ndarray:
    """Columns x with apply(x) near b, each by MINRES of its own; one call of ``apply`` per step serves all columns."""
    size = np.linalg.norm(b, axis=0)
    eta, beta = size.copy(), size.copy()
    before, v = np.zeros_like(b), b / np.where(size > 0, size, 1)
    w_far, w_near, x = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    cos_far, cos_near = np.ones_like(size), np.ones_like(size)
    sin_far, sin_near = np.zeros_like(size), np.zeros_like(size)
    going = size > 0
    for _ in range(steps):
        if not going.any():
            break
        p = apply(v)
        along = (v * p).sum(axis=0)
        ahead = p - v * along - before * beta
        next_beta = np.linalg.norm(ahead, axis=0)
        # the new column of the tridiagonal matrix, turned by the last two rotations and by its own
        diagonal = cos_near * along - cos_far * sin_near * beta
        length = np.hypot(diagonal, next_beta)
        upper, top = sin_near * along + cos_far * cos_near * beta, sin_far * beta
        going &= length > 1e-300
        safe = np.where(going, length, 1)
        w = (v - w_far * top - w_near * upper) / safe
        cos_far, sin_far = cos_near, sin_near
        cos_near, sin_near = diagonal / safe, next_beta / safe
        x += np.where(going, cos_near * eta, 0) * w
        eta = np.where(going, -sin_near * eta, eta)
        w_far, w_near, before, beta = w_near, w, v, next_beta
        v = ahead / np.where(next_beta > 0, next_beta, 1)
        going &= (np.abs(eta) > rough * size) & (next_beta > 0)
    return x


def _beside(new: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``new`` add to the orthonormal ``spaces``."""
    for _ in range(2):
        sizes = np.linalg.norm(new, axis=0)
        new = new[:, sizes > 0] / sizes[sizes > 0]
        for s in spaces:
            new = new - s @ (s.T @ new)
        left, spread, _ = np.linalg.svd(new, full_matrices=False)
        new = left[:, spread > 1e-10]
    return new


def eigenpairs(product: Product, d: int, most: int = MOST, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``most`` largest eigenvalues, falling, of a symmetric operator on d numbers that has none below zero, their unit
    vectors (columns) and the largest residual as a share of the largest eigenvalue."""
    k = min(most, d)
    width = min(d, k + GUARD)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    space, image = np.zeros((d, 0)), np.zeros((d, 0))
    new = np.random.default_rng([SEED, d]).standard_normal((d, width))
    for _ in range(rounds):
        new = _beside(new, locked, space)
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, product(new)])
        h = space.T @ image
        theta, turn = np.linalg.eigh((h + h.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        residual = image[:, :width] - space[:, :width] * theta[:width]
        residual -= locked @ (locked.T @ residual)
        sizes, largest = np.linalg.norm(residual, axis=0), max([*theta[:1], *values[:1]])
        good = sizes <= ROUNDING * max(largest, 0.0)
        # the whole space: Ritz pairs are exact, residuals are the rounding of their products
        whole = space.shape[1] + locked.shape[1] == d or not new.shape[1]
        done = min(k - len(values), len(good) if whole or good.all() else int(good.argmin()))
        locked, values = np.hstack([locked, space[:, :done]]), np.append(values, theta[:done])
        if len(values) == k:
            break
        keep = slice(done, done + 2 * width if space.shape[1] + width > SPACE else None)
        theta, residual, good = theta[done:], residual[:, done:], good[done:]
        space, image = space[:, keep], image[:, keep]
        open_, near = np.flatnonzero(~good), np.hstack([locked, space[:, :residual.shape[1]]])

        def off(t: np.ndarray) -> np.ndarray:
            return t - near @ (near.T @ t)

        shift = theta[open_]
        new = minres(lambda t: off(product(off(t)) - t * shift), off(-residual[:, open_]))
    else:
        raise RuntimeError(f"only {len(values)} of {k} eigenpairs in {rounds} rounds")
    # once more within the locked space, with fresh products
    basis = _beside(locked)
    image = product(basis)
    h = basis.T @ image
    theta, turn = np.linalg.eigh((h + h.T) / 2)
    values, vectors, image = theta[::-1], basis @ turn[:, ::-1], image @ turn[:, ::-1]
    worst = np.linalg.norm(image - vectors * values, axis=0).max() if k else 0.0
    return values, vectors, float(worst / values[0]) if k and values[0] > 0 else 0.0


def grid_rows(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """vec_id and x, the entries on the grid floor(64 * c) + 1000000, of the rows whose vector is whole: not null, no null and no
    non-finite entry. Entries beyond LIMIT / 64 are taken as if they were there."""
    c = F.col(f"`{embedding}`").cast("array<double>")
    good = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    x = F.transform(c, lambda e: F.floor(F.least(F.greatest(e * 64, F.lit(-LIMIT)), F.lit(LIMIT))) + F.lit(1_000_000).cast("long"))
    return vectors.where(c.isNotNull() & good).select("vec_id", x.alias("x"))


def _matrix(column) -> np.ndarray:
    """An Arrow column of lists of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), -1)


def fit_blocks(rows: DataFrame, d: int) -> DataFrame:
    """n, block, sums: each distinct x once, many in a row, as whole numbers of 8 bytes, with their number and sums."""
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("block", T.BinaryType()),
                           T.StructField("sums", T.ArrayType(T.DecimalType(38, 0)))])
    arrow, at_once = to_arrow_schema(schema), max(1, BLOCK // d)

    def run(batches):
        from decimal import Decimal

        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                x = _matrix(batch.column(0).slice(start, at_once))
                sums = x.sum(axis=0) if np.abs(x).max(initial=0) * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
                yield pa.RecordBatch.from_arrays([
                    pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary()),
                    pa.array([[Decimal(int(s)) for s in sums]], arrow.field("sums").type)], schema=arrow)

    return rows.select("x").distinct().mapInArrow(run, schema)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: 64-bit numbers where they suffice, whole numbers of any size elsewhere."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squared(deviation: np.ndarray) -> list[int]:
    """Per row the exact sum of squares."""
    if deviation.dtype != object and deviation.shape[1] * int(np.abs(deviation).max(initial=0)) ** 2 < 1 << 63:
        return (deviation * deviation).sum(axis=1).tolist()
    return [int(s) for s in (deviation.astype(object) ** 2).sum(axis=1)]


class FitList:
    """The distinct vectors of one dimension, written in blocks, with their number and exact sums."""

    def __init__(self, rows: DataFrame, d: int):
        self.d = d
        self.blocks = written(fit_blocks(rows, d), "whitening-fit")
        self.n = self.blocks.agg(F.sum("n")).first()[0]
        found = self.blocks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
        self.sums = [int(r["s"]) for r in sorted(found, key=lambda r: r["pos"])]

    def total(self, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of the matrices that ``kernel`` makes of the blocks' deviations: tasks add up their own, rows of the sums meet by
        number, so only one matrix reaches the driver however many tasks there are."""
        n, sums, d = self.n, self.sums, self.d

        def run(batches):
            whole = None
            for batch in batches:
                for block in batch.column(0):
                    made = kernel(deviations(np.frombuffer(block.as_buffer(), np.int64).reshape(-1, d), n, sums))
                    whole = made if whole is None else whole + made
            if whole is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(whole)), pa.int32()), pa.array(list(whole), pa.list_(pa.float64()))], names=["i", "v"])

        width = kernel(np.zeros((0, d), np.int64)).shape[1]
        parts = self.blocks.select("block").mapInArrow(run, "i int, v array<double>")
        rows = parts.groupBy("i").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(width)]).collect()
        return np.array([tuple(r)[1:] for r in sorted(rows, key=lambda r: r["i"])])

    def product(self, t: np.ndarray) -> np.ndarray:
        """Covariance times t: the centred rows times t, then their transpose times that."""
        n = self.n

        def kernel(deviation):
            centred = deviation.astype(float) / n
            return centred.T @ (centred @ t)

        return self.total(kernel) / n

    def trace(self) -> float:
        """Trace of the covariance, from the exact squares."""
        n = self.n
        return float(self.total(lambda dev: np.array([[math.fsum(s / n / n for s in _squared(dev))]]))[0, 0]) / n

    def identity_error(self, scaled: np.ndarray) -> float:
        """Largest entry, less the identity, of the covariance of the projections on the columns of ``scaled``."""
        n, k = self.n, scaled.shape[1]

        def kernel(deviation):
            w = deviation.astype(float) / n @ scaled
            return np.vstack([w.sum(axis=0), w.T @ w])

        both = self.total(kernel) / n
        return float(np.abs(both[1:] - np.outer(both[0], both[0]) - np.eye(k)).max())


def _whitened(rows: DataFrame, fit: FitList, most: int) -> DataFrame | None:
    """The rows of one dimension; None if no direction has any spread."""
    values, vectors, residual = eigenpairs(fit.product, fit.d, most)
    keep = values > FLAT * max(values.max(initial=0.0), 0.0)
    values, vectors = values[keep], vectors[:, keep]
    if not len(values):
        return None
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    scaled, trace = vectors / np.sqrt(values), fit.trace()
    n, sums = fit.n, fit.sums
    schema = T.StructType([rows.schema["vec_id"], T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    arrow, at_once = to_arrow_schema(schema), max(1, BLOCK // fit.d)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                dev = deviations(_matrix(part.column(1)), n, sums)
                squares = [s if s < 1 << 63 else None for s in _squared(dev)]
                w = dev.astype(float) / n @ scaled
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(squares, pa.int64()), pa.array(list(w), arrow.field("w").type)], schema=arrow)

    share = F.array(*[F.lit(float(e / trace)) for e in values])
    return rows.mapInArrow(run, schema).select(
        "vec_id", F.lit(n).cast("long").alias("n"), "deviation", F.posexplode("w").alias("at", "whitened"),
        F.lit(fit.identity_error(scaled)).alias("identity_error"), F.lit(residual).alias("residual")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), "identity_error", "residual")


def whiten(vectors: DataFrame, embedding: str = "embedding", most: int = MOST) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error, residual.

    Rows whose vector is null or holds a null or non-finite entry go; every other row stays, rows that repeat an id or a vector
    too. The fit list holds each distinct vector on the grid once. Components whose eigenvalue is zero (up to FLAT) are
    left out, so an empty table, empty vectors and a single distinct vector give no rows. Equal eigenvalues: any basis of their
    space. Vectors of different lengths are whitened apart, each length with its own fit list. A deviation beyond 64 bits is null.
    Other columns are not read. Vectors do not move: a pass over the fit list returns one matrix of dimension x block.
    """
    rows = written(grid_rows(vectors, embedding), "whitening-rows").where(F.size("x") > 0)
    lengths = [r[0] for r in rows.select(F.size("x")).distinct().collect()]
    parts = []
    for d in sorted(lengths):
        some = rows.where(F.size("x") == d)
        if (part := _whitened(some, FitList(some, d), most)) is not None:
            parts.append(part)
    if not parts:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, "
                                                     "explained double, identity_error double, residual double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
