from collections import Counter

from pyspark.sql import functions as F

from tagloom.llm.mixing import mix, mix_plan


def water(sizes):
    """Targets by the rule itself: share by weight, stop at three times the size, share the excess again."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, rest, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 3 * sizes[s]}
        for s in full or open_:
            target[s] = 3.0 * sizes[s] if full else share * weight[s]
        rest -= sum(target[s] for s in full)
        if not full:
            break
        open_ -= full
    return target


def check(rows, near):
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    target = water(dict(sizes))
    taken = Counter()
    for r in rows:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, r["target"]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= near(s)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mix_plan(docs)
    rows = plan.join(docs.select("doc_id", "source"), "doc_id").collect()
    largest = Counter()
    for r in rows:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    check(rows, lambda s: largest[s] / 2 + 1e-6)
    again = {r["doc_id"]: r["taken"] for r in mix_plan(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    copies = Counter(r["doc_id"] for r in mix(docs).collect())
    assert all(copies[r["doc_id"]] * r["size"] == r["taken"] for r in rows)


def test_edges(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, None, "s0", 1), (101, "", None, 1), (None, "one two", None, 1), (102, "a b", "s9", 1), (102, "a b", "s9", 1), (103, None, "empty", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, place int")
    got = mix_plan(df).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["size"] for r in got if r["doc_id"] in (100, 101, 103)} == {100: 0, 101: 0, 103: 0}
    assert len({r["taken"] for r in got if r["doc_id"] == 102}) == 1
    assert mix(df).columns == df.columns
    empty = df.limit(0)
    assert mix_plan(empty).count() == 0 and mix(empty).count() == 0
    alone = df.filter("doc_id < 60 AND source = 's1'")
    assert alone.count() == mix(alone).count()


def test_hot_source(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x y z").alias("text"),
                                  F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    rows = mix_plan(df).join(df.select("doc_id", "source"), "doc_id").collect()
    check(rows, lambda s: 3)


def test_very_long_text_is_counted_whole(spark):
    rows = [(1, "ab " * 700_000, "s"), (2, "x" * 3_000_000, "s"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r["doc_id"]: r["size"] for r in mix_plan(df).collect()} == {1: 700_000, 2: 1, 3: 0}
    assert sorted(r["doc_id"] for r in mix(df).collect()) == [1, 2]
