import random

import plain
import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import simhash
from tagloom.llm.components import components


def fp(text):
    ws = plain.split((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not ws:
        return 0
    grams = [" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps):
    """Smallest id reachable over links of at most two bits."""
    comp = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= 2 and comp[j] < comp[i]:
                    comp[i] = comp[j]
                    changed = True
    return comp


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.simhash_groups(docs).collect()}
    fps = [(r["doc_id"], fp(r["text"])) for r in docs.select("doc_id", "text").collect()]
    want = groups(fps)
    assert len(got) == len(fps)
    for i, f in fps:
        assert got[i]["fingerprint"] == f"{f:016x}" and got[i]["component_id"] == want[i]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


@pytest.mark.parametrize("pairwise", [0, 3, 64])
def test_links_of_dense_and_sparse_fingerprints(spark, monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(300)}
    base = r.getrandbits(64)
    for _ in range(120):  # a dense group and chains of near ones
        x = base
        for b in r.sample(range(64), r.randint(0, 3)):
            x ^= 1 << b
        fps.add(x)
    for x in list(fps)[:60]:
        fps.add(x ^ 1 << r.randrange(64) ^ 1 << r.randrange(64))
    fps = list(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["node"]: r["component"] for r in components(simhash.link_fingerprints(df), "a", "b").collect()}
    want = groups(list(enumerate(fps)))
    by = {}
    for i, x in enumerate(signed):
        by.setdefault(want[i], []).append(x)
    for members in by.values():
        assert {got.get(x, x) for x in members} == {min(members)}


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(500, x) for x in range(501, 900)] + [(7, 7), (None, 3), (1000, 1001), (1000, 1001)]
    r.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(500, 900), 500), 1000: 1000, 1001: 1000}


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(5, None, "a"), (4, "", "b"), (3, "same words here now", "c"), (3, "same words here now", "c"), (None, "same words here now", "d"),
            (None, "nobody knows this one text", "e"), (None, "nobody knows this one text", "e"), (9, "Same WORDS here now", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("component_id", F.lit(1))
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(df).collect()), key=str)
    assert got == sorted([(5, 4), (4, 4), (3, 3), (3, 3), (None, 3), (9, 3), (None, None), (None, None)], key=str)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"], r["fp"]) for r in kept.collect()) == [(False, 3, "c"), (False, 4, "b"), (True, None, "e")]
    assert simhash.simhash_groups(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_repeated_ids_with_null_and_with_different_texts(spark):
    a, b, c = "one text about cats on mats", "quite another text of dogs in fogs", "a third one with nothing in common"

    def kept(*rows):
        df = spark.createDataFrame(list(rows), "doc_id long, text string, extra int")
        return sorted(((r["doc_id"], r["text"], r["extra"]) for r in simhash.keep_one(df).collect()), key=str)

    # (a) null texts under repeated ids, and without ids
    assert kept((1, None, 7), (1, None, 7), (2, "", 8)) == [(1, None, 7)]
    assert kept((None, None, 7), (None, None, 7)) == [(None, None, 7)]
    assert kept((1, None, 7), (1, "", 8), (1, None, 7)) == [(1, "", 8)]
    # (b) an id that stands for one group only
    assert kept((5, a, 1), (5, b, 2), (3, b, 3)) == [(3, b, 3), (5, a, 1)]
    assert kept((5, a, 1), (5, a, 1), (5, b, 2), (3, b, 3), (None, c, 4), (None, c, 4), (None, a, 5)) == [(3, b, 3), (5, a, 1), (None, c, 4)]
    # (c) an id that stands for two groups, once and twice
    assert kept((5, a, 1), (5, b, 2), (5, b, 2)) == [(5, a, 1), (5, b, 2)]


def test_very_long_texts_have_whole_fingerprints(spark):
    r = random.Random(9)
    long = " ".join(f"w{r.randrange(9000)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " tail"), (3, "y" * 1_000_000), (4, " ".join(reversed(long.split())))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["fingerprint"] for x in simhash.simhash_groups(df).collect()}
    assert got == {i: f"{fp(t):016x}" for i, t in rows}
