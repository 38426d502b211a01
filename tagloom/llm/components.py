"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagloom.llm.batches import written


def _least(pairs: DataFrame) -> DataFrame:
    """Per node u the smallest of itself and its neighbours v; written, so that the join after it reads two
    plain inputs and Spark can split the partition of a hub."""
    return written(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least").withColumnRenamed("u", "w")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: the smallest node that can be reached, for every node of an edge.

    Alternates two steps on the edges until nothing changes: hang every larger neighbour of a node on
    the smallest node next to it, then do the same with its smaller neighbours and itself. Paths shrink by
    a factor per round; a hub's neighbours are summed on the map side and its joins are plain sort-merge
    joins. Nulls and loops are left out, repeated edges count once, no edges give no rows.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct(), "large")
        least = _least(large)
        small = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "edges")
        # a fixed point has one edge per node, to its root; the sum of hashes tells whether the edges changed
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
