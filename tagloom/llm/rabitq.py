"""Near-duplicate vectors by randomised-rotation binary codes.

A vector is turned by random rotations; the signs are its code, and the share of the vector that the code keeps is stored as a
correction factor. With it the product of a code and another, turned vector is an unbiased estimate of the two vectors'
inner product, with a known spread. Vectors meet if a band of their codes is equal. Only codes travel there: the number of bits
in which two codes differ, with its spread at the threshold, rules most pairs out. For the rest the vectors are fetched, estimates and their
confidence bounds decide which pairs are computed exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tagloom.llm.batches import written
from tagloom.llm.components import components

THRESHOLD = 0.9
#: Chance that a pair exactly at the threshold meets in some table; vectors of other pairs in a bucket, on average.
RECALL, CROWD = 0.98, 64
#: Half width of the confidence interval, in spreads.
SPREADS = 4.5
#: Rows that are compared at once; larger buckets are dealt in blocks and compared block by block. Buckets up to SMALL go pair by pair.
BLOCK, SMALL = 1024, 32
SEED = 20


def plan_bands(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a band and number of bands for n vectors. Bands grow with log n, so that chance meetings per vector
    do not; the number of bands keeps the recall."""
    bits = min(40, max(4, round(math.log2(max(n, 1) / CROWD))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log1p(-same)))


class Rotations:
    """The turned vectors and codes of one plan, for any dimension."""

    def __init__(self, bits: int, bands: int):
        self.bits, self.bands, self.made = bits, bands, {}

    def matrix(self, d: int) -> np.ndarray:
        """Rotations below one another, enough for all bands and the code."""
        if d not in self.made:
            rng = np.random.default_rng([SEED, d])
            count = max(1, math.ceil(self.bits * self.bands / d))
            self.made[d] = np.concatenate([np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(count)]).astype(np.float32)
        return self.made[d]

    def encode(self, unit: np.ndarray):
        """Code bits (all rotations), correction factor of the first rotation, band values."""
        turned = unit @ self.matrix(unit.shape[1]).T
        signs = turned > 0
        d = unit.shape[1]
        factor = np.abs(turned[:, :d]).sum(axis=1) / math.sqrt(d)
        used = signs[:, : self.bits * self.bands].reshape(len(unit), self.bands, self.bits)
        return np.packbits(signs, axis=1), factor, used @ (1 << np.arange(self.bits, dtype=np.int64))

    def same_bands(self, a: np.ndarray, b: np.ndarray, d: int) -> np.ndarray:
        """For pairs of packed codes, the first band in which they are equal."""
        n = self.bits * self.bands
        differ = np.unpackbits(a ^ b, axis=1, count=self.matrix(d).shape[0])[:, :n].reshape(len(a), self.bands, self.bits)
        return (~differ.any(axis=2)).argmax(axis=1)


def estimate_and_bound(turned: np.ndarray, signs: np.ndarray, factor: np.ndarray):
    """Estimates of the inner products of turned unit vectors (rows) with coded ones (columns), and the half width
    of their confidence interval per column."""
    d = turned.shape[1]
    estimate = (turned @ signs.T) / (math.sqrt(d) * factor)
    return estimate, _bound(factor, d)


def _bound(factor: np.ndarray, d: int) -> np.ndarray:
    return SPREADS * np.sqrt(np.maximum(0, 1 - factor ** 2)) / factor / math.sqrt(max(1, d - 1))


def _vectors(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, flat values (null: NaN) and which rows are usable."""
    lists = column.cast(pa.list_(pa.float64()))
    lengths = np.array([x if x is not None else 0 for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    usable = lengths > 0
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    squares = np.concatenate([[0.0], np.cumsum(np.where(np.isfinite(flat), flat != 0, False))])
    usable &= (bad[ends] == bad[ends - lengths]) & (squares[ends] > squares[ends - lengths])
    return ends, flat, usable


def packed_vectors(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """vec_id and vector: the components in double precision, as bytes; null for a vector that links with nothing."""
    plain = vectors.select("vec_id", F.col(embedding).cast("array<double>").alias("embedding"))
    schema = T.StructType([plain.schema[0], T.StructField("vector", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            ends, flat, usable = _vectors(batch.column(1))
            cut = np.concatenate([[0], ends])
            flat = flat + 0.0  # -0.0 and 0.0 are one value
            data = [flat[a:b].astype("<f8").tobytes() if u else None for a, b, u in zip(cut[:-1], cut[1:], usable)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], schema=arrow)

    return plain.mapInArrow(run, schema)


def _unit(data: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(data), "<f8").reshape(len(data), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def coded(nodes: DataFrame, bits: int, bands: int) -> DataFrame:
    """node, size (bytes of the vector), code, factor and band values of every node; the vector stays behind."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("code", T.BinaryType()),
                           T.StructField("factor", T.DoubleType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        rotations = Rotations(bits, bands)
        for batch in batches:
            data = batch.column(1).to_pylist()
            code, factor, values = [None] * len(data), np.zeros(len(data)), [None] * len(data)
            for size in {len(x) for x in data}:
                rows = [i for i, x in enumerate(data) if len(x) == size]
                c, f, v = rotations.encode(_unit([data[i] for i in rows]))
                factor[rows] = f
                for k, i in enumerate(rows):
                    code[i], values[i] = c[k].tobytes(), v[k]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) for x in data], pa.int32()), pa.array(code, pa.binary()), pa.array(factor),
                pa.array(values, pa.list_(pa.int64()))], schema=arrow)

    return nodes.select("node", "vector").mapInArrow(run, schema)


class Buckets:
    """Pairs within buckets of one dimension."""

    def __init__(self, bits: int, bands: int, threshold: float):
        self.rotations, self.threshold = Rotations(bits, bands), threshold

    def _rows(self, rows: pa.Table) -> dict:
        code = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(rows), -1)
        return {"d": rows["size"][0].as_py() // 8, "code": code,
                **{c: rows[c].to_numpy() for c in ("node", "band", "block", "low", "high")}}

    def _own(self, x: dict, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of candidate pairs, those that this bucket has to look at: one of each of its two blocks, or both of the one, and equal
        in no earlier band."""
        wide = x["block"][i] + x["block"][j] == x["low"][i] + x["high"][i]
        wide &= (x["block"][i] != x["block"][j]) | (x["low"][i] == x["high"][i])
        i, j = i[wide], j[wide]
        first = self.rotations.same_bands(x["code"][i], x["code"][j], x["d"]) == x["band"][i]
        return i[first], j[first]

    def candidates(self, x: dict, group: np.ndarray, few, many):
        """Pairs i < j of rows of one group that pass a test: ``few`` on index arrays, ``many`` on two slices (a matrix of truth)."""
        n = len(group)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(starts, n))
        small = np.repeat(sizes <= SMALL, sizes)
        for step in range(1, int(sizes[sizes <= SMALL].max(initial=0))):
            i = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
            for a in range(0, len(i), 1 << 17):
                p, q = i[a:a + (1 << 17)], i[a:a + (1 << 17)] + step
                need = few(p, q)
                yield self._own(x, p[need], q[need])
        for s, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            for a in range(s, s + size, BLOCK):
                b = slice(a, min(a + BLOCK, s + size))
                for c in range(a, s + size, BLOCK):
                    e = slice(c, min(c + BLOCK, s + size))
                    p, q = np.nonzero(many(b, e))
                    p, q = p + a, q + c
                    for k in range(0, len(p), 1 << 17):
                        u, v = p[k:k + (1 << 17)], q[k:k + (1 << 17)]
                        yield self._own(x, u[u < v], v[u < v])


class Undecided(Buckets):
    """What codes alone leave open: nodes with a partner whose code differs in no more bits than chance allows at the threshold."""

    def most_bits(self, total: int) -> float:
        """Signs of two vectors at the threshold differ with chance angle / pi each."""
        p = math.acos(self.threshold) / math.pi
        return total * p + SPREADS * math.sqrt(total * p * (1 - p))

    def __call__(self, rows: pa.Table, group: np.ndarray) -> np.ndarray:
        x, marked = self._rows(rows), np.zeros(len(rows), bool)
        total = self.rotations.matrix(x["d"]).shape[0]
        most = self.most_bits(total)
        signs = np.unpackbits(x["code"], axis=1, count=total).astype(np.float32) * 2 - 1

        def few(p, q):
            return np.bitwise_count(x["code"][p] ^ x["code"][q]).sum(axis=1) <= most

        def many(b, e):
            return (total - signs[b] @ signs[e].T) / 2 <= most

        for i, j in self.candidates(x, group, few, many):
            marked[i] = marked[j] = True
        return marked


class Compare(Buckets):
    """Links within buckets: what each node gains and edges that connect what is linked. Estimates from the turned vector of one side and the
    code and factor of the other, with their bounds, decide which pairs are computed exactly."""

    def __call__(self, rows: pa.Table, group: np.ndarray):
        """rows of whole groups, one dimension; group: the group of each row, ascending."""
        x, n = self._rows(rows), len(group)
        d, unit, factor = x["d"], _unit(rows["vector"].to_pylist()), rows["factor"].to_numpy()
        turned = unit.astype(np.float32) @ self.rotations.matrix(d)[:d].T
        signs = np.unpackbits(x["code"], axis=1, count=d).astype(np.float32) * 2 - 1
        copies = rows["copies"].to_numpy()

        def few(p, q):
            e = np.einsum("pd,pd->p", turned[p], signs[q]) / (math.sqrt(d) * factor[q])
            return e + _bound(factor[q], d) >= self.threshold

        def many(b, e):
            estimate, bound = estimate_and_bound(turned[b], signs[e], factor[e])
            return estimate + bound >= self.threshold

        left, right = [], []
        for i, j in self.candidates(x, group, few, many):
            exact = np.einsum("pd,pd->p", unit[i], unit[j]) >= self.threshold
            left.append(i[exact])
            right.append(j[exact])
        i, j = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in (left, right))
        gain = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        root = np.arange(n)
        while len(i):  # smallest row that is reached, within the groups
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, root[i])
            new = new[new]
            if (new == root).all():
                break
            root = new
        own = np.flatnonzero(gain > 0)
        hung = np.flatnonzero(root != np.arange(n))
        return x["node"][own], gain[own].astype(np.int64), x["node"][hung], x["node"][root[hung]]


KEYS = ["size", "band", "value", "low", "high"]


def _bucketwise(met: DataFrame, schema: T.StructType, make) -> DataFrame:
    """Bring the rows of a bucket (or of two of its blocks) together and hand whole buckets of one dimension to the function that
    ``make`` gives; it takes (rows, group of each row) and returns columns."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        work = make()

        def result(rows: pa.Table):
            k = [rows[c].to_numpy() for c in KEYS]
            change = np.zeros(len(rows), bool)
            for c in k:
                change[1:] |= c[1:] != c[:-1]
            group = np.cumsum(change)
            cut = np.flatnonzero(np.append(True, k[0][1:] != k[0][:-1]))
            for a, b in zip(cut, np.append(cut[1:], len(rows))):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(work(rows.slice(a, b - a), group[a:b]), arrow)], schema=arrow)

        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            last = np.ones(len(held), bool)
            for c in KEYS:
                v = held[c].to_numpy()
                last &= v == v[-1]
            done = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if done:
                yield from result(held.slice(0, done))
                held = held.slice(done).combine_chunks()
        if held is not None and len(held):
            yield from result(held)

    return met.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(run, schema)


def undecided(met: DataFrame, bits: int, bands: int, threshold: float) -> DataFrame:
    """KEYS, block and node of the rows of buckets that have a partner there which their codes leave open."""
    kept = [*KEYS, "block", "node"]

    def make():
        buckets = Undecided(bits, bands, threshold)

        def work(rows, group):
            at = np.flatnonzero(buckets(rows, group))
            return [rows[c].to_numpy()[at] for c in kept]

        return work

    return _bucketwise(met, T.StructType([met.schema[c] for c in kept]), make)


def compared(met: DataFrame, bits: int, bands: int, threshold: float) -> DataFrame:
    """Per task and node of a bucket: other, null with the links gained, or a node that it is connected to."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("links", T.LongType()), T.StructField("other", T.LongType())])

    def make():
        compare = Compare(bits, bands, threshold)

        def work(rows, group):
            own, gain, hung, root = compare(rows, group)
            return (np.concatenate([own, hung]), [*gain.tolist(), *[None] * len(hung)], [*[None] * len(own), *root.tolist()])

        return work

    return _bucketwise(met, schema, make)


def _named(rows: DataFrame) -> DataFrame:
    """``rows`` with usable, row (a number of its own) and node, a number of 64 bits for each distinct vector. Vectors that share a hash (their second hashes tell) are
    numbered by another one."""
    from tagloom.operators.sizing import lookup_join

    rows = rows.withColumns({"usable": F.col("vector").isNotNull(), "row": F.monotonically_increasing_id(), "node": node_hash(F.col("vector"))})
    rows = written(rows, "vectors")
    second = F.xxhash64(F.lit(1), "vector")
    clashes = rows.where("usable").groupBy("node").agg(F.min(second).alias("a"), F.max(second).alias("b")).where("a < b")
    clashes = written(clashes.select("node", F.lit(True).alias("clash")), "clashes")
    if clashes.isEmpty():
        return rows
    other = F.xxhash64(F.lit(2), "vector")
    return written(lookup_join(rows, clashes, ["node"]).withColumn("node", F.when(F.col("clash"), other).otherwise(F.col("node"))).drop("clash"), "vectors")


def node_hash(vector) -> Column:
    return F.xxhash64(vector)


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector.

    Links are pairs with cosine >= threshold in double precision; none below is reported, one at the threshold
    is found with chance ``recall``, closer ones nearly always. Null, zero and non-finite vectors link with nothing; vectors of
    different lengths do not link. Equal vectors are one node with a number of copies (distinct ids), linked without being
    compared; a row that repeats an id counts once. A null id takes part but counts for no link. An empty table gives no rows; other
    columns are not read. Nodes meet in buckets as codes of a few bytes; vectors come only to those that the codes leave
    open, once per bucket. Buckets of any size are dealt in blocks, tasks pass on one sum and one edge per node, never pairs.
    """
    from tagloom.operators.sizing import lookup_join

    rows = _named(packed_vectors(vectors))
    # one row stands for the equal vectors of a node; numbers are grouped, vectors stay where they are
    grouped = rows.where("usable").groupBy("node").agg(
        F.count_distinct("vec_id").alias("copies"), F.min("vec_id").alias("least"), F.min("row").alias("row"))
    grouped = written(grouped.withColumnRenamed("node", "n"), "grouped")
    nodes = written(lookup_join(rows, grouped, ["row"], how="inner").select("node", "vector", "copies", "least"), "nodes")
    bits, bands = plan_bands(nodes.count(), threshold, recall)
    codes = written(coded(nodes, bits, bands), "codes")
    met = codes.select("node", "size", "code", F.posexplode("bands").alias("band", "value"))
    crowds = met.groupBy("size", "band", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    met = lookup_join(met, written(crowds, "crowds"), ["size", "band", "value"])
    blocks = F.coalesce(F.ceil(F.col("n") / F.lit(BLOCK)), F.lit(1)).cast("long")
    met = met.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), blocks)).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = met.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("n", "other")
    open_ = written(undecided(met, bits, bands, threshold), "open")
    known = codes.select("node", "code", "factor").withColumnRenamed("node", "c")
    held = nodes.select("node", "vector", "copies").withColumnRenamed("node", "v")
    full = open_.join(known, F.col("node") == F.col("c")).join(held, F.col("node") == F.col("v")).drop("c", "v")
    found = written(compared(full, bits, bands, threshold), "links")
    links = found.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.where("other IS NOT NULL"), "node", "other").withColumnRenamed("node", "g")
    placed = nodes.drop("vector").join(groups, F.col("node") == F.col("g"), "left").select(
        "node", "copies", "least", F.coalesce("component", "node").alias("component"))
    placed = written(placed, "placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "c")
    known = placed.join(least, F.col("component") == F.col("c")).join(links.withColumnRenamed("node", "l"), F.col("node") == F.col("l"), "left")
    known = known.select(F.col("node").alias("n"), "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("others"))
    known = written(known, "known")
    linked = F.col("n").isNotNull()
    out = rows.select("vec_id", "node", "usable").join(known, (F.col("node") == F.col("n")) & F.col("usable"), "left")
    return out.select(
        "vec_id", F.when(linked, F.greatest("others", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(linked, F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
