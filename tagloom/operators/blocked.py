"""Models that do not fit in a worker: classes in blocks, partial answers that merge.

The vectors are numbered in order and dealt in blocks of bounded bytes. Per block one narrow pass over the items adds
what the block says to what is known so far: the best classes, the largest logit and the sum of exponentials relative to it. Both merge in any order
of blocks, so the answer is that of the whole model. The items are written once per block and never shuffled; driver
and workers hold one block at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.functions import fixed
from tagloom.functions.vectors import BLOCK_ROWS, _best, _offsets, _to_lists, _to_matrix, _unit, doubles, softmax
from tagloom.operators.ranking import number_in_order
from tagloom.operators.sizing import settle

BLOCK_BYTES = 32 << 20  # of one block's vectors in double precision


def numbered_vectors(vectors: DataFrame, order: Sequence[str], vec: str) -> DataFrame:
    """``vectors`` with __at, their place in ``order``; written."""
    return settle(number_in_order(vectors.withColumn(vec, doubles(F.col(vec))), list(order), "__at"))


def vector_blocks(model: DataFrame, vec: str, block_bytes: int | None = None) -> Iterator[tuple[int, list]]:
    """(place of its first row, rows) of each block, in order; a block's vectors take ``block_bytes`` at most, one vector at least."""
    count, width = model.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    per_block = max(1, (BLOCK_BYTES if block_bytes is None else block_bytes) // (8 * max(1, width or 1)))
    for start in range(0, count, per_block):
        yield start, model.where(F.col("__at").between(start, start + per_block - 1)).orderBy("__at").collect()


def _merged(z: np.ndarray, m: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest logit and sum of exponentials relative to it, after the logits ``z`` are added to (m, s)."""
    new = np.maximum(m, z.max(axis=1))
    scale = np.where(np.isneginf(m), 0.0, np.exp(np.where(np.isneginf(m), 0.0, m - new)))
    return new, s * scale + np.exp(z - new[:, None]).sum(axis=1)


_TOP = "struct<idx:array<bigint>,z:array<double>,m:double,s:double>"


def _top_step(weights: np.ndarray, start: int, k: int, scale: float):
    """Adds a block's classes to the best ``k`` and the softmax's denominator."""
    w = _unit(weights)

    @F.arrow_udf(_TOP)
    def kernel(vec: pa.Array, state: pa.Array) -> pa.Array:
        present, x = _to_matrix(vec)
        n = len(x)
        if state.null_count == len(state):
            idx, best = np.zeros((n, 0), np.int64), np.zeros((n, 0))
            m, s = np.full(n, -np.inf), np.zeros(n)
        else:
            kept = state.filter(pa.array(present))
            idx, best = (kept.field(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for c in ("idx", "z"))
            m, s = (kept.field(c).to_numpy(zero_copy_only=False) for c in ("m", "s"))
        width = min(k, idx.shape[1] + len(w))
        out_idx, out_z, out_m, out_s = np.empty((n, width), np.int64), np.empty((n, width)), np.empty(n), np.empty(n)
        for a in range(0, n, BLOCK_ROWS):
            r = slice(a, a + BLOCK_ROWS)
            z = scale * (_unit(x[r]) @ w.T)
            out_m[r], out_s[r] = _merged(z, m[r], s[r])
            # earlier classes come first, so the lower class still wins a tie
            both = np.concatenate([best[r], z], axis=1)
            names = np.concatenate([idx[r], np.broadcast_to(start + np.arange(len(w)), z.shape)], axis=1)
            at, out_z[r] = _best(both, width)
            out_idx[r] = np.take_along_axis(names, at.astype(np.int64), axis=1)
        lists = [pa.ListArray.from_arrays(_offsets(present, width), pa.array(v.ravel())) for v in (out_idx, out_z)]
        numbers = []
        for v in (out_m, out_s):
            whole = np.zeros(len(present))
            whole[present] = v
            numbers.append(pa.array(whole, mask=~present))
        return pa.StructArray.from_arrays([*lists, *numbers], names=["idx", "z", "m", "s"], mask=pa.array(~present))

    return kernel


@dataclass
class BlockedScorer:
    """softmax(scale * cosine similarity to one vector per class) for any number of classes; ``model`` is (__at, name, vec).

    A batch scorer: it writes the items between blocks. The best classes come by :meth:`best`; called like other scorers it
    gives all probabilities, which then must fit in a row."""

    model: DataFrame
    scale: float = fixed.SIMILARITY_SCALE
    block_bytes: int | None = None

    def best(self, df: DataFrame, features: str, k: int, out: str) -> DataFrame:
        state, kept = df.withColumn("__state", F.lit(None).cast(_TOP)), df.columns
        for start, rows in vector_blocks(self.model, "vec", self.block_bytes):
            step = _top_step(np.array([r["vec"] for r in rows], float), start, k, self.scale)
            # each block names its own classes; a name that drops out of the best goes with its class
            names = F.from_json(F.lit(json.dumps([r["name"] for r in rows])), "array<string>")
            state = state.withColumn("__new", step(F.col(features), F.col("__state")))
            none = F.expr("cast(map() as map<bigint,string>)")
            old = F.coalesce(F.col("__names"), none) if "__names" in state.columns else none
            named = F.transform(F.col("__new.idx"), lambda i: F.when(i < start, F.element_at(old, i)).otherwise(F.get(names, (i - start).cast("int"))))
            state = settle(state.select(*[F.col(f"`{c}`") for c in kept], F.col("__new").alias("__state"),
                                        F.map_from_arrays(F.col("__new.idx"), named).alias("__names")))
        if "__names" not in state.columns:
            return df.withColumn(out, F.lit(None).cast("array<struct<name:string,confidence:double>>"))
        s = F.col("__state")
        pairs = F.arrays_zip(s["idx"].alias("idx"), s["z"].alias("z"))
        answers = F.transform(pairs, lambda p: F.struct(
            F.element_at(F.col("__names"), p["idx"]).alias("name"), (F.exp(p["z"] - s["m"]) / s["s"] * 100).alias("confidence")))
        return state.withColumn(out, answers).drop("__state", "__names")

    def __call__(self, df: DataFrame, features: str, out: str) -> DataFrame:
        state, kept = df.withColumn("__z", F.lit(None).cast("array<double>")), df.columns
        for _, rows in vector_blocks(self.model, "vec", self.block_bytes):
            block = _logits(np.array([r["vec"] for r in rows], float), self.scale)(F.col(features))
            state = settle(state.select(*[F.col(f"`{c}`") for c in kept], F.when(F.col("__z").isNull(), block).otherwise(F.concat("__z", block)).alias("__z")))
        return state.withColumn(out, softmax(F.col("__z"))).drop("__z")


def _logits(weights: np.ndarray, scale: float):
    w = _unit(weights)

    @F.arrow_udf("array<double>")
    def kernel(vec: pa.Array) -> pa.Array:
        present, x = _to_matrix(vec)
        return _to_lists(scale * (_unit(x) @ w.T) if len(x) else np.zeros((0, len(w))), present)

    return kernel


def _shared_step(weights: np.ndarray, scale: float):
    """Largest logit over a block of shared vectors and the sum of exponentials relative to it."""
    w = _unit(weights)

    @F.arrow_udf("struct<m:double,s:double>")
    def kernel(vec: pa.Array, m: pa.Array, s: pa.Array) -> pa.Array:
        present, x = _to_matrix(vec)
        out = []
        old_m = m.filter(pa.array(present)).to_numpy(zero_copy_only=False)
        old_s = s.filter(pa.array(present)).to_numpy(zero_copy_only=False)
        new_m, new_s = np.empty(len(x)), np.empty(len(x))
        for a in range(0, len(x), BLOCK_ROWS):
            r = slice(a, a + BLOCK_ROWS)
            new_m[r], new_s[r] = _merged(scale * (_unit(x[r]) @ w.T), old_m[r], old_s[r])
        for v in (new_m, new_s):
            whole = np.zeros(len(present))
            whole[present] = v
            out.append(pa.array(whole, mask=~present))
        return pa.StructArray.from_arrays(out, names=["m", "s"], mask=pa.array(~present))

    return kernel


def shared_sums(df: DataFrame, vec: str, shared: DataFrame, kind: str, prefix: str, scale: float, block_bytes: int | None = None) -> DataFrame:
    """``df`` with <prefix>_m and <prefix>_s: largest logit of the row's vector with the ``shared`` vectors (slot, kind, vec) of a kind, and the
    sum of their exponentials relative to it; -inf and 0 if there are none, NULL without a vector."""
    some = numbered_vectors(shared.where(F.col("kind") == kind).select("slot", F.col("vec").alias("__shared")), ["slot"], "__shared")
    has = F.col(vec).isNotNull()
    m, s = f"{prefix}_m", f"{prefix}_s"
    state = df.withColumn(m, F.when(has, F.lit(float("-inf")))).withColumn(s, F.when(has, F.lit(0.0)))
    for _, rows in vector_blocks(some, "__shared", block_bytes):
        step = _shared_step(np.array([r["__shared"] for r in rows], float), scale)
        new = state.withColumn("__new", step(F.col(vec), F.col(m), F.col(s)))
        state = settle(new.withColumn(m, F.col("__new.m")).withColumn(s, F.col("__new.s")).drop("__new"))
    return state
