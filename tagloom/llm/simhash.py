"""SimHash near-duplicates; candidates are pruned by chains of consecutive segments (pigeonring)."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tagloom.llm.batches import map_texts, written
from tagloom.llm.components import components

#: Words of a shingle, seed of its hash, bits that linked fingerprints may differ in.
SHINGLE, SEED, DISTANCE = 3, 42, 2
#: The ring: bit ranges of the segments, low bit first.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets of more fingerprints are linked through one-bit variants, smaller ones pair by pair.
PAIRWISE = 64


def fingerprint(text: str | None) -> int:
    """64 bits as a signed number; a bit is set if it is set in over half the shingle hashes."""
    ws = text.encode().lower().split() if text else []
    if not ws:
        return 0
    join = b" ".join
    grams = map(join, zip(*(ws[i:] for i in range(SHINGLE)))) if len(ws) >= SHINGLE else [join(ws)]
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, max(1, len(ws) - SHINGLE + 1))
    bits = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 14):
        part = np.unpackbits(hashes[a:a + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: dict[str, Column], text: str = "text") -> DataFrame:
    """``keep`` and the column fp: the fingerprint of each whole text (null and wordless: 0)."""
    return map_texts(docs, keep, F.col(text), [T.StructField("fp", T.LongType())],
                     lambda: lambda texts: {"fp": [fingerprint(t) for t in texts]})


def _segment(fp: Column, k: int) -> Column:
    at, n = SEGMENTS[k % len(SEGMENTS)]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))


def _differences(x: Column, y: Column, k: int) -> Column:
    return F.bit_count(_segment(x, k).bitwiseXOR(_segment(y, k)))


def chain_holds(x: Column, y: Column, k: int) -> Column:
    """Whether the chain from segment k on stays within budget: after l segments at most l * DISTANCE / 3
    differences. By the pigeonring principle every linked pair has such a k."""
    m = len(SEGMENTS)
    total, fine = F.lit(0), F.lit(True)
    for step in range(m):
        total = total + _differences(x, y, k + step)
        fine = fine & (total * m <= (step + 1) * DISTANCE)
    return fine


def chain_keys(fp: Column) -> Column:
    """Keys (ring, value) under which linked fingerprints meet. A chain of two segments has no difference in the first and at most
    one in the second, so one half of the second is equal too: the key is the first segment and that half."""
    keys = []
    for k in range(len(SEGMENTS)):
        n = SEGMENTS[(k + 1) % len(SEGMENTS)][1]
        low = n // 2
        for half in range(2):
            second = _segment(fp, k + 1)
            part = second.bitwiseAND(F.lit((1 << low) - 1)) if half == 0 else F.shiftright(second, low)
            value = F.shiftleft(_segment(fp, k), 12).bitwiseOR(part)
            keys.append(F.struct(F.lit(2 * k + half).alias("ring"), value.cast("long").alias("value")))
    return F.array(*keys)


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` within DISTANCE bits of each other, directly or by way of others.

    Fingerprints meet in buckets of equal chain keys. In a small bucket pairs are tested: first the chain, then the full
    distance. In a large one each fingerprint names itself and its one-bit variants; those with a name in common differ in
    two bits at most, and any two that do have one, so each name ties its fingerprints to the smallest: as many rows as
    fingerprints times bits, whatever the bucket's size.
    """
    keyed = fps.select("fp", F.explode(chain_keys(F.col("fp"))).alias("k")).select("fp", "k.ring", "k.value")
    sizes = written(keyed.groupBy("ring", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    met = written(keyed.join(sizes.withColumnsRenamed({"ring": "r", "value": "v"}),
                             (F.col("ring") == F.col("r")) & (F.col("value") == F.col("v"))).select("ring", "value", "n", "fp"), "met")
    few = met.where(F.col("n") <= PAIRWISE)
    x, y = few.select("ring", "value", F.col("fp").alias("a")), few.select(F.col("ring").alias("r"), F.col("value").alias("v"), F.col("fp").alias("b"))
    pairs = x.join(y, (F.col("ring") == F.col("r")) & (F.col("value") == F.col("v")) & (F.col("a") < F.col("b")))
    a, b = F.col("a"), F.col("b")
    first = F.lit(False)
    for k in range(len(SEGMENTS)):
        first = first | ((F.shiftright(F.col("ring"), 1) == k) & chain_holds(a, b, k))
    near = pairs.where(first & (F.bit_count(a.bitwiseXOR(b)) <= DISTANCE)).select("a", "b")
    many = met.where(F.col("n") > PAIRWISE).select("fp").distinct()
    names = F.concat(F.array(F.col("fp")), *[F.array(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i)))) for i in range(64)])
    named = many.select("fp", F.explode(names).alias("name"))
    least = named.groupBy("name").agg(F.min("fp").alias("b"), F.max("fp").alias("a")).where("a <> b")
    # two fingerprints of a name: an edge; more: the others join theirs
    more = named.join(least.select(F.col("name").alias("m"), "b"), F.col("name") == F.col("m")).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return near.unionByName(more).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id reachable by links, itself included, and group, the
    signed number of the group.

    Null and wordless texts have fingerprint zero and link like any other. Documents without an id get the component of
    their group, null if none of it has an id; repeated ids each get a row. An empty table gives an empty one. Equal fingerprints
    are one node, so exact copies cost a row per task. Text is read once, in a narrow pass, whole however long it is.
    """
    made = written(fingerprints(docs, {"doc_id": F.col("doc_id")}), "fingerprints")
    nodes = written(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(link_fingerprints(nodes.select("fp")), "a", "b")
    placed = nodes.join(found, nodes["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("group"))
    placed = written(placed, "groups")
    first = placed.groupBy("group").agg(F.min("least").alias("component_id")).withColumnRenamed("group", "g")
    byfp = written(placed.join(first, F.col("group") == F.col("g")).select(F.col("fp").alias("f"), "group", "component_id"), "members")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return made.join(byfp, F.col("fp") == F.col("f")).select("doc_id", hexed.alias("fingerprint"), "component_id", "group")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns; of a group without ids one row.

    An id that no other row has names the survivor. If rows repeat the id, or have none, the survivor is named by id and fingerprint (of
    those in the group the smallest); of rows equal in both one stays, the first by text, null texts last.
    """
    from tagloom.operators.sizing import lookup_join

    groups = written(simhash_groups(docs), "simhash-groups")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = groups.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(stays).alias("stay"))
    ids = written(ids.where("stay > 0"), "stays")
    once = ids.where("n = 1").select(F.col("doc_id").alias("__once"))
    alone = docs.join(once.hint("merge"), docs["doc_id"] == F.col("__once"), "left_semi")
    named = groups.where(stays).select("doc_id", "fingerprint", "group")
    repeated = lookup_join(named.where(F.col("doc_id").isNotNull()), ids.where("n > 1").select("doc_id"), ["doc_id"], how="left_semi")
    several = (repeated.unionByName(named.where(F.col("doc_id").isNull()))
               .groupBy(F.col("group").alias("__g")).agg(F.min("doc_id").alias("__id"), F.min("fingerprint").alias("__f")))
    several = written(several, "several")
    if several.isEmpty():
        return alone
    name = "__row"
    while name in docs.columns:
        name += "_"
    rows = fingerprints(docs, {name: F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "__id": F.col("doc_id")})
    rows = rows.withColumn("__f", F.lpad(F.lower(F.hex("fp")), 16, "0"))
    kept = lookup_join(rows, several, ["__id", "__f"], how="inner", null_safe=True)
    text = F.col(name)["text"]
    # the order is never null: min_by passes rows over whose order is
    one = kept.groupBy("__g").agg(F.min_by(name, F.struct(text.isNull(), text)).alias(name))
    return alone.unionByName(one.select(*[F.col(name)[c].alias(c) for c in docs.columns]))
