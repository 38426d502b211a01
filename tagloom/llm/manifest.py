"""Merkle manifest of a set of documents: one root for all, a subroot per source, a proof per document.

Leaves of a source stand in order of their ids and are dealt in superblocks of FAN^LEVELS. A first pass reduces each superblock to its
top; tops are the leaves of the next tier, up to the subroot, and subroots go on to the root in the same way. Then the exchange
runs downwards: a tier's nodes are cogrouped by superblock with the outer nodes that this superblock needs (its path from the
top to the root), and one applyInPandas finishes the local reduction, joins the proofs and folds them.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tagloom.llm.batches import written

#: Children of a node, and levels that a superblock holds.
FAN, LEVELS = 16, 3
#: Key under which the subroots meet.
TOP = "root"
#: The siblings of a node level by level: its place in its run, and the others of the run.
PATH = "array<struct<at:int,others:array<string>>>"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(c: Column) -> Column:
    """A value with its length in bytes before it, so that values cannot run into one another; a null is a dash."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, (doc_id, source, lang, n_chars, text))).cast("binary"), 256)


def lowered(text: Column) -> Column:
    """The tampered text: A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """key (of the source: in the order null, then by bytes), doc_id, leaf and, where ``tampered`` holds, the leaf of the tampered row."""
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf(*rest, lowered(F.col("text"))))
    return docs.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("key"), "doc_id",
                       leaf(*rest, F.col("text")).alias("leaf"), changed.alias("changed"))


def reduce_levels(nodes: list[str], group_size: int, levels: int) -> list[list[str]]:
    """The levels of a superblock from its leaves to its top: all ``levels`` if its group has more superblocks, else as many as it takes."""
    out = [nodes]
    while len(out) <= levels and FAN ** (len(out) - 1) < group_size:
        below = out[-1]
        out.append([digest(below[i:i + FAN]) for i in range(0, len(below), FAN)])
    return out


def local_path(tree: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    """Per level of a superblock the place of node i in its run and the others of the run."""
    path = []
    for below in tree[:-1]:
        start = i - i % FAN
        run = below[start:start + FAN]
        path.append((i - start, run[:i - start] + run[i - start + 1:]))
        i //= FAN
    return path


def fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a node and its siblings give."""
    for at, others in path:
        node = digest([*others[:at], node, *others[at:]])
    return node


def placed(nodes: DataFrame, order: list[str], levels: int) -> DataFrame:
    """``nodes`` with pos, their place in ``order`` within their key from 0 on, size (nodes of the key) and block. Equal rows are told
    apart by where they stand in the input, so that a pile of them is spread over tasks."""
    from tagloom.operators.ranking import rank_within
    from tagloom.operators.sizing import lookup_join

    sizes = written(nodes.groupBy("key").agg(F.count(F.lit(1)).alias("size")), "manifest-sizes")
    tie = F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id())
    ranked = rank_within(nodes.withColumn("tie", tie), ["key"], [*order, "tie"], "pos").drop("tie")
    ranked = lookup_join(ranked.withColumn("pos", F.col("pos") - 1), sizes, ["key"], how="inner")
    return written(ranked.withColumn("block", F.floor(F.col("pos") / FAN ** levels)), "manifest-placed")


def tops(nodes: DataFrame, levels: int) -> DataFrame:
    """key, block, node: each superblock reduced to its top."""
    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        top = reduce_levels(pdf["node"].tolist(), int(pdf["size"].iloc[0]), levels)[-1][0]
        return pd.DataFrame({"key": pdf["key"].iloc[:1], "block": pdf["block"].iloc[:1], "node": [top]})

    few = nodes.select("key", "block", "pos", "size", F.col("node"))
    return written(few.groupBy("key", "block").applyInPandas(reduce, "key string, block long, node string"), "manifest-tops")


def tiers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes of each tier: ``nodes``, their superblocks' tops and so on until every key has one superblock; then its one top."""
    out = [nodes]
    while True:
        above = tops(out[-1], levels)
        if above.where("block > 0").isEmpty():
            return [*out, above.select("key", "node")]
        sizes = out[-1].select("key", "block", F.ceil(F.col("size") / FAN ** levels).alias("size"))
        sizes = sizes.groupBy("key").agg(F.max("size").alias("size")).withColumnRenamed("key", "k")
        next_ = above.join(sizes, F.col("key") == F.col("k")).select(
            "key", F.col("block").alias("pos"), "node", "size", F.floor(F.col("block") / FAN ** levels).alias("block"))
        out.append(written(next_, "manifest-tier"))


def _path_of(value) -> list[tuple[int, list[str]]]:
    return [(int(s["at"]), list(s["others"])) for s in value]


def descend(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """key, pos, path: the whole path of every node to the root, given the outer path of its superblock (key, block, path)."""
    def exchange(inner: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos")
        if inner.empty:
            return pd.DataFrame({"key": [], "pos": [], "path": []})
        tree = reduce_levels(inner["node"].tolist(), int(inner["size"].iloc[0]), levels)
        far = _path_of(around["path"].iloc[0])
        paths = [[{"at": at, "others": others} for at, others in local_path(tree, i) + far] for i in range(len(inner))]
        return pd.DataFrame({"key": inner["key"], "pos": inner["pos"], "path": paths})

    few = nodes.select("key", "block", "pos", "size", "node")
    return written(few.groupBy("key", "block").cogroup(outer.groupBy("key", "block")).applyInPandas(
        exchange, f"key string, pos long, path {PATH}"), "manifest-paths")


def _outer_paths(tier_nodes: list[DataFrame], first: DataFrame, levels: int) -> DataFrame:
    """Outer path of every superblock of the lowest tier, by exchanges from the highest tier down. ``first``: key, path of each key's top."""
    outer = first.select("key", F.lit(0).cast("long").alias("block"), "path")
    for nodes in reversed(tier_nodes[1:]):
        outer = descend(nodes, outer, levels).select("key", F.col("pos").alias("block"), "path")
    return outer


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of doc_id, source, lang, n_chars and text. ``tampered`` says which rows had their text lowered after
    the manifest was made; their folded_root starts from the changed leaf. Null texts, ids and sources have a leaf like others; a null
    source is a source of its own, the first. Ids are in rising order, null first; rows that repeat an id follow the digest of their leaf, and
    equal rows get different proofs, in no set order. An empty table gives no rows, one document alone is the root itself (its proof is
    empty). Texts are read once and do not move: a row of the exchange is an id and two digests. A task holds one superblock,
    of 16^levels leaves, however many documents a source has.
    """
    rows = written(leaves(docs, tampered), "manifest-leaves")
    if rows.isEmpty():
        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, "
                                                     "folded_root string, verified boolean")
    low = placed(rows.withColumnRenamed("leaf", "node"), ["doc_id", "node"], levels)
    lower = tiers(low, levels)
    subroots = lower[-1]
    high = placed(subroots.select(F.lit(TOP).alias("key"), F.col("key").alias("source_key"), "node"), ["source_key"], levels)
    upper = tiers(high, levels)
    root = upper[-1].first()["node"]  # one row
    none = high.sparkSession.range(1).select(F.lit(TOP).alias("key"), F.expr(f"cast(array() as {PATH})").alias("path"))
    over = descend(high, _outer_paths(upper[:-1], none, levels), levels).withColumnsRenamed({"key": "k", "pos": "p"})
    named = high.join(over, (F.col("key") == F.col("k")) & (F.col("pos") == F.col("p"))).select(
        F.col("source_key").alias("key"), F.col("node").alias("subroot"), "path")
    named = written(named, "manifest-subroots")
    outer = _outer_paths(lower[:-1], named.select("key", "path"), levels)
    outer = outer.join(named.select(F.col("key").alias("k"), "subroot"), F.col("key") == F.col("k")).drop("k")
    # ids travel as text: pandas has no whole numbers beside nulls
    low = low.withColumn("doc_id", F.col("doc_id").cast("string"))

    def finish(inner: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("pos")
        nodes = inner["node"].tolist()
        tree = reduce_levels(nodes, int(inner["size"].iloc[0]), levels)
        far, subroot = _path_of(around["path"].iloc[0]), around["subroot"].iloc[0]
        beyond = [x for _, others in far for x in others]
        proofs, folded = [], []
        for i, (node, changed) in enumerate(zip(nodes, inner["changed"])):
            near = local_path(tree, i)
            proofs.append(digest([x for _, others in near for x in others] + beyond))
            folded.append(fold(changed if isinstance(changed, str) else node, near + far))
        return pd.DataFrame({"doc_id": inner["doc_id"], "leaf": nodes, "subroot": subroot, "root": root, "proof_sha256": proofs,
                             "folded_root": folded, "verified": [f == root for f in folded]})

    out = low.groupBy("key", "block").cogroup(outer.groupBy("key", "block"))
    out = out.applyInPandas(
        finish, "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast(rows.schema["doc_id"].dataType))
