"""Rows outside the expected: null and repeated ids, unknown classes, unreadable input."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from tagloom.functions import text
from tagloom.operators import catalogue, evaluation, gate, images, labels, ranking, sampling, scoring, sizing
from tagloom.operators.head import fit_head
from tagloom.plans.training import prepare
from tagloom.sources import writers


def test_splits_end_on_null_ids(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("id"), (F.col("id") % 3).alias("c"))
    for out in (sampling.random_split_exact(df, "id"), sampling.stratified_split(df, "c", "id"),
                sampling.random_split_exact(df.withColumn("id", F.lit(None).cast("long")), "id")):
        assert out.count() == 2000
    again = sampling.random_split_exact(df, "id")
    assert again.filter("id IS NULL").select("split").distinct().count() == 1


def test_split_sizes_stay_exact_for_unique_ids(spark):
    df = spark.range(1000).withColumn("id", F.when(F.col("id") > 0, F.col("id")))
    sizes = {r["split"]: r["n"] for r in sampling.random_split_exact(df, "id", 0.8).groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {"train": 800, "val": 200}


def test_quota_of_empty_classes(spark):
    items = spark.createDataFrame([("a", "x"), ("a", "seed_y")], "c string, f string")
    classes = spark.createDataFrame([("a",), ("b",)], "c string")
    got = {r["c"]: (r["existing"], r["per_query"]) for r in labels.plan_quota(items, "c", "f", per_class=40, classes=classes).collect()}
    assert got == {"a": (1, 39 // 8 + 1), "b": (0, 40 // 8 + 1)}


def test_deep_documents_give_no_leaves(spark):
    deep = "[" * 200_000 + "]" * 200_000
    df = spark.createDataFrame([(1, deep), (2, '{"a": "http://h/x.png"}'), (3, "{")], "id int, j string")
    assert [tuple(r) for r in catalogue.harvest_urls(df, "id", "j").collect()] == [(2, 0, "http://h/x.png")]


def test_unparsable_urls_are_not_blocked(spark):
    urls = [("http://[porn/x.png",), ("http://porn/x.png",), ("http://[porn]/x.png",)]
    df = spark.createDataFrame(urls, "u string")
    assert [r[0] for r in df.select(text.is_blocked(F.col("u"), ["porn"])).collect()] == [False, True, True]


def test_first_wins_treats_nulls_alike_on_both_paths(spark):
    df = spark.createDataFrame([("g", "f", None), ("g", "f", "b")], "g string, f string, o string")
    assert [r["o"] for r in ranking.dedup_first(df, ["g"], "f", "o").collect()] == ["b"]
    assert [r["o"] for r in ranking.dedup_first(df.withColumn("x", F.lit(1)), ["g"], "f", "o").collect()] == ["b"]


def test_null_labels_keep_their_rows(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "label string")
    assert sorted(((r["label"], r["class_idx"]) for r in ranking.class_index(df, "label").collect()), key=str) == [("a", 0), ("b", 1), (None, None)]


def test_mapping_is_json_with_repeated_names(spark, tmp_path):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "name string, value string")
    writers.write_mapping(df, str(tmp_path / "m"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()]
    assert json.loads("".join(lines)) == {"a": "2", "b": "3"}
    with pytest.raises(Exception, match="NULL"):
        writers.write_mapping(spark.createDataFrame([(None, "1")], "name string, value string"), str(tmp_path / "n"))


def test_class_without_prompt_has_its_own_decision(spark):
    items = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("z", "y", [1.0, 0.0]), ("a", "n", None)], "c string, f string, v array<double>")
    prompts = spark.createDataFrame([("a", 0, "target", [1.0, 0.0]), ("a", 1, "generic", [0.0, 1.0])],
                                    "class_name string, slot int, kind string, vec array<double>")
    got = {r["f"]: r["decision"] for r in gate.relevance_gate(items, prompts, "c", "v", "f").collect()}
    assert got == {"x": "keep", "y": "no_prompt", "n": "unreadable"}


def test_classes_outside_the_vocabulary_are_counted(spark):
    cm = spark.createDataFrame([("a", "a", 4), ("a", "x", 1), ("y", "x", 2), (None, "b", 1), ("b", None, 2)], "true string, pred string, n bigint")
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "class_idx bigint, class_name string")
    wide = {r["class_name"]: (r["class_idx"], r["a"], r["b"], r["other"]) for r in evaluation.confusion_wide(cm, vocab, "other").collect()}
    assert wide == {"a": (0, 4, 0, 1), "b": (1, 0, 0, 2), "other": (2, 0, 1, 2)}
    per = {r["class_name"]: (r["test_samples"], r["correct"]) for r in evaluation.per_class_accuracy(cm, vocab, "other").collect()}
    assert per == {"a": (5, 4), "b": (2, 0), "other": (3, 0)}
    assert evaluation.top1_accuracy(cm).first()["total"] == 10
    for report in (evaluation.confusion_wide, evaluation.per_class_accuracy):
        with pytest.raises(Exception, match="not in the vocabulary"):
            report(cm, vocab).collect()


def test_repeated_lookup_keys_do_not_multiply_rows(spark):
    facts = spark.createDataFrame([("k", 1), ("z", 2)], "k string, i int")
    table = spark.createDataFrame([("k", "a"), ("k", "b")], "k string, v string")
    assert sorted(map(tuple, labels.lookup_default(facts, table, ["k"], "v", F.lit("-")).select("i", "v").collect())) == [(1, "b"), (2, "-")]
    names = table.select(F.col("k").alias("alias"), F.col("v").alias("canonical"))
    assert sorted(r["k"] for r in labels.canonicalise(facts, "k", names).collect()) == ["b", "z"]


def test_equal_rows_of_a_hot_key_spread_over_salts(spark):
    facts = spark.range(0, 4000, 1, 200).select(F.lit("hot").alias("k"), F.lit(1).alias("x"))
    table = spark.createDataFrame([("hot", 7)], "k string, v int")
    joined = sizing.lookup_join(facts, table, ["k"], max_rows=0)
    assert joined.agg(F.sum("v")).first()[0] == 28000 and joined.columns == ["k", "x", "v"]
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), F.col("k"), F.col("x")), F.lit(sizing.SALTS))
    assert facts.select(salt.alias("s")).distinct().count() >= sizing.SALTS - 2


def test_copies_of_images_keep_other_columns_exactly(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(1, big, [1, None]), (2, None, None)], "id long, b long, l array<long>").withColumn(
        "image", F.struct(F.lit("o").alias("origin"), F.lit(2).alias("height"), F.lit(2).alias("width"), F.lit(1).alias("nChannels"),
                          F.lit(0).alias("mode"), F.unhex(F.lit("01020304")).alias("data")))
    got = images.augment(df, "id", variants=2).collect()
    assert sorted((r["id"], r["b"], r["l"], r["variant"]) for r in got if r["id"] == 1) == [(1, big, [1, None], 0), (1, big, [1, None], 1)]
    assert [r["b"] for r in got if r["id"] == 2] == [None, None] and all(len(r["image"]["data"]) == 12 for r in got)


def test_wide_vocabulary_is_scored_in_blocks(spark):
    rng = np.random.default_rng(5)
    w = rng.normal(size=(200_000, 3))
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(300, None)], "id int, v array<double>")
    scorer = scoring.LinearScorer([f"n{i}" for i in range(len(w))], w, np.zeros(len(w)))
    got = {r["id"]: r["predictions"] for r in scoring.score(df, scorer, "v", k=2).collect()}
    assert got[300] is None
    for i in (0, 255, 256, 299):
        best = np.argsort(-(w @ x[i]), kind="stable")[:2]
        assert [p["name"] for p in got[i]] == [f"n{k}" for k in best]


def test_batch_scorer_is_one_pass(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 4 > 0, F.array(F.col("id").cast("double"), F.lit(1.0))).alias("v"))
    model = scoring.make_scorer("batch", names=["a", "b"], make_predict=lambda: lambda x: np.stack([x[:, 0], x[:, 1]], 1), width=2, batch_size=7)
    out = scoring.score(df, model, "v", k=1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Union" not in plan and plan.count("Range (") == 1
    got = {r["id"]: r["predictions"] for r in out.collect()}
    assert len(got) == 40 and got[0] is None and got[5][0]["name"] == "a" and got[1][0]["confidence"] == 100.0


def test_prepare_writes_keys_only(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).cast("string").alias("label"), F.array(F.rand(1)).alias("vec"))
    out = prepare(df, "label", "id")
    assert out.keys.columns == ["label", "id"] and "vec" in out.items.columns
    weighted = out.weighted_draws()
    n = {r["class_name"]: r["n"] for r in out.train_counts.collect()}
    assert weighted.count() == sum(n.values())
    assert all(r["weight"] == 1.0 / n[r["label"]] for r in weighted.collect())


def test_head_says_whether_it_converged(spark):
    df = spark.range(60).select((F.col("id") % 2).cast("string").alias("y"), F.array((F.col("id") % 2) + F.rand(3), F.rand(4)).alias("x"))
    assert not fit_head(df, "x", "y", max_iter=1, tol=0.0).converged
    assert fit_head(df, "x", "y", max_iter=60, tol=1e-3).converged


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_lookup_beyond_the_limits_is_never_broadcast(spark, capsys, tmp_path, how):
    """Neither the repeated lookup nor the facts, though Spark takes both for small: a file of 20 rows."""
    spark.range(20).select((F.col("id") % 4).alias("k"), "id").write.parquet(str(tmp_path / "facts"))
    spark.range(3).withColumnRenamed("id", "k").write.parquet(str(tmp_path / "lookup"))
    facts, lookup = spark.read.parquet(str(tmp_path / "facts")), spark.read.parquet(str(tmp_path / "lookup"))
    joined = sizing.lookup_join(facts, lookup, ["k"], how=how, max_rows=2)
    plan = plan_of(joined, capsys)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert joined.count() == {"inner": 15, "left": 20, "left_semi": 15, "left_anti": 5}[how]
    assert "BroadcastHashJoin" in plan_of(sizing.lookup_join(facts, lookup, ["k"], how=how, max_rows=3), capsys)


def test_the_catalogue_broadcasts_no_orders(spark, capsys, monkeypatch):
    from tagloom.queries.datasets import catalogue as items

    monkeypatch.setattr(sizing, "BROADCAST_ROWS", 10)
    plan = plan_of(items(spark, SF), capsys)
    assert "SortMergeJoin [l_orderkey" in plan and "SortMergeJoin [dex" in plan
    assert not [x for x in plan.split("\n") if "BroadcastHashJoin [" in x and ("l_orderkey" in x or "dex" in x)]


def test_long_documents_of_a_batch_are_read_one_at_a_time():
    import tracemalloc

    import pyarrow as pa

    deep = "[" * 200_000 + "]" * 200_000
    docs = pa.array([None, '{"a":"x","v":{"b":"y"}}', *[deep] * 50, '{"c":"z"}', "no json"], pa.string())
    tracemalloc.start()
    got = catalogue._walked(docs, frozenset(["v"])).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [[], ["x"], *[[]] * 50, ["z"], []]
    assert peak < 4_000_000  # 50 documents are 20 MB
