import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from tagloom.llm import manifest as m

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_leaf(doc_id, text, lang, source, n_chars):
    return h(enc(doc_id), enc(source), enc(lang), enc(n_chars), enc(text))


def tree(nodes):
    """Root of a list and, per node, (place, others) level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, a in enumerate(at):
            start = a // 16 * 16
            run = level[start:start + 16]
            paths[i].append((a - start, run[:a - start] + run[a - start + 1:]))
            at[i] = a // 16
        level = [h(*level[i:i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def plain_manifest(rows, tampered):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[3], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    leaves = {s: sorted(((r[0] is not None, r[0] or 0, plain_leaf(*r), r) for r in by_source[s]), key=lambda x: x[:3]) for s in order}
    trees = {s: tree([x[2] for x in leaves[s]]) for s in order}
    root, outer = tree([trees[s][0] for s in order])
    out = []
    for s, far in zip(order, outer):
        for (_, _, leaf, r), near in zip(leaves[s], trees[s][1]):
            path = near + far
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]) if r[1] is not None else None
            node = plain_leaf(r[0], text, *r[2:]) if tampered(r[0]) else leaf
            for a, others in path:
                node = h(*others[:a], node, *others[a:])
            out.append((r[0], leaf, trees[s][0], root, h(*[x for _, o in path for x in o]), node, node == root))
    return sorted(out, key=str)


def got(df, tampered=True, levels=m.LEVELS):
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0 if tampered else None
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))
                   for r in m.manifest(df, hit, levels).collect()), key=str)


def fifth(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def rows_of(sizes):
    count = itertools.count()
    return [(i, f"Text {i} Ä" * (i % 4), "en" if i % 3 else None, s, i % 11 or None)
            for s, n in sizes.items() for i in itertools.islice(count, n)]


@pytest.mark.parametrize("levels, sizes", [
    (3, {"a": 1, "b": 16, "c": 17, "d": 256, "é": 257, None: 40, "": 3, "-": 2, "=": 5}),
    (1, {"a": 1, "b": 15, "c": 16, "d": 17, "e": 255, "f": 256, "g": 257, None: 300, **{f"s{i}": 2 for i in range(20)}}),
    (2, {"hot": 700, **{f"s{i}": 1 for i in range(300)}}),
])
def test_against_brute_force(spark, levels, sizes):
    """Superblocks of 16, 256 and 4096 leaves: the tree does not depend on how it is dealt."""
    rows = rows_of(sizes)
    df = spark.createDataFrame(rows, COLUMNS).orderBy(F.xxhash64("doc_id")).withColumn("key", F.lit(1)).withColumn("node", F.lit("x"))
    assert got(df, levels=levels) == plain_manifest(rows, fifth)


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    result = got(df)
    assert result == plain_manifest(rows, fifth)
    assert 0 < sum(not r[-1] for r in result) < len(result)


def test_one_document_and_none(spark):
    df = spark.createDataFrame([(7, "ABC", "en", "s", 3)], COLUMNS)
    leaf = plain_leaf(7, "ABC", "en", "s", 3)
    assert got(df, tampered=False) == [(7, leaf, leaf, leaf, h(), leaf, True)]
    assert got(df.limit(0)) == []


def test_repeated_rows_nulls_and_long_texts(spark):
    """Equal rows are leaves of their own; null ids come first; only a text that holds capitals changes."""
    rows = [(None, None, None, None, None)] * 3 + [(1, "x", "en", "s", 1)] * 20 + [(1, "Y", "en", "s", 1), (None, "Z", None, "s", None)]
    rows += [(2, "W" * 300_000, "en", "s", 300_000), (3, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, COLUMNS)
    assert got(df) == plain_manifest(rows, fifth)
    everything = m.manifest(df, F.lit(True)).collect()
    assert [r["verified"] for r in everything if r["doc_id"] == 2] == [False]
    assert all(r["verified"] for r in everything if r["doc_id"] is None and r["leaf"] == plain_leaf(None, None, None, None, None))


def test_large_ids_survive_beside_null_ids(spark):
    rows = [(None, "a", "en", "s", 1), (2**62 + 1, "b", "en", "s", 1), (-5, "c", "en", "s", 1)]
    assert got(spark.createDataFrame(rows, COLUMNS)) == plain_manifest(rows, fifth)


def test_values_cannot_run_into_one_another(spark):
    a, b = ((1, "2:ab", "x", None, 1), (1, "ab", "x", "2:", 1))
    assert plain_leaf(*a) != plain_leaf(*b)
    leaves = [r["leaf"] for r in m.leaves(spark.createDataFrame([a, b], COLUMNS)).collect()]
    assert leaves == [plain_leaf(*a), plain_leaf(*b)]
