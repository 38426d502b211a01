"""First-wins, caps and ranks, with one group that holds most of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tagloom.operators import ranking, sizing


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    data = [(("hot" if rng.random() < 0.6 else f"g{rng.randint(0, 40)}"), i, rng.randint(0, 50), f"f{rng.random():.12f}")
            for i in range(4000)]
    return data, spark.createDataFrame(data, "g string, id int, fp int, name string").repartition(7).persist()


def by_group(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return out


def test_rank_within(spark, skewed):
    data, df = skewed
    want = sorted((r[1], i + 1) for rs in by_group(data).values() for i, r in enumerate(sorted(rs, key=lambda r: r[3])))
    got = ranking.rank_within(df, ["g"], ["name"], "rank")
    assert sorted((r["id"], r["rank"]) for r in got.collect()) == want


def test_number_in_order(spark, skewed):
    data, df = skewed
    want = {r[1]: i + 5 for i, r in enumerate(sorted(data, key=lambda r: r[3]))}
    got = ranking.number_in_order(df, ["name"], "no", start=5)
    assert {r["id"]: r["no"] for r in got.collect()} == want


@pytest.mark.parametrize("cap", [0, 1, 7, 900, 1001, 2000])
def test_cap(spark, skewed, cap):
    data, df = skewed
    want = sorted(r[1] for rs in by_group(data).values() for r in sorted(rs, key=lambda r: r[3])[: cap or None])
    assert sorted(r["id"] for r in ranking.cap_per_group(df, ["g"], ["name"], cap).collect()) == want


def test_null_group_is_a_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, id int")
    got = ranking.rank_within(df, ["g"], ["id"], "r")
    assert rows(got.select("id", "r")) == [(1, 1), (2, 2), (3, 1)]


def test_dedup_first(spark, skewed):
    data, df = skewed
    best = {}
    for g, i, fp, name in data:
        key = (g, fp)
        best[key] = min(best.get(key, (name, i)), (name, i))
    got = ranking.dedup_first(df, ["g"], "fp", "name")
    assert sorted(r["id"] for r in got.collect()) == sorted(i for _, i in best.values())
    assert rows(ranking.dedup_first(got, ["g"], "fp", "name")) == rows(got)
    slim = ranking.dedup_first(df.select("g", "fp", "name"), ["g"], "fp", "name")
    assert rows(slim) == rows(got.select("g", "fp", "name"))


def test_dedup_order_and_unreadable(spark):
    data = [("a", "seed_00.png", "h"), ("a", "card_1.png", "h"), ("a", "000001.jpg", "h"), ("b", "seed_00.png", "h"),
            ("a", "x.png", None)]
    df = spark.createDataFrame(data, "c string, f string, h string").withColumn("n", F.lit(1))
    got = ranking.dedup_first(df, ["c"], "h", "f").select("c", "f")
    assert rows(got) == [("a", "000001.jpg"), ("b", "seed_00.png")]


@pytest.mark.parametrize("n", [3, 400])
def test_first_n_passing(spark, skewed, n):
    data, df = skewed
    want = []
    for rs in by_group(data).values():
        seen = sorted(rs, key=lambda r: r[3])[: 3 * n]
        want += [r[1] for r in seen if r[2] > 25][:n]
    got = ranking.first_n_passing(df, ["g"], ["name"], n, F.col("fp") > 25)
    assert sorted(r["id"] for r in got.collect()) == sorted(want)


def test_ordered_distinct(spark, skewed):
    data, df = skewed
    want = []
    for g, rs in by_group(data).items():
        first = {}
        for r in sorted(rs, key=lambda r: r[1]):
            first.setdefault(r[2], len(first))
        want += [(g, v, p) for v, p in first.items()]
    got = ranking.ordered_distinct(df.select("g", "fp", F.col("id").alias("pos")), ["g"], "fp", "pos")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_class_index(spark):
    df = spark.createDataFrame([("b",), ("B",), ("é",), ("a",), ("b",), ("Z",)], "l string")
    vocab = ranking.class_vocabulary(df, "l")
    assert [r["class_name"] for r in sorted(vocab.collect(), key=lambda r: r["class_idx"])] == sorted({"b", "B", "é", "a", "Z"})
    assert {r["l"]: r["class_idx"] for r in ranking.class_index(df, "l").collect()} == {"B": 0, "Z": 1, "a": 2, "b": 3, "é": 4}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_lookup_join_paths_agree(spark, skewed, how, null_safe):
    _, df = skewed
    facts = df.withColumn("g", F.when(F.col("g") != "g3", F.col("g")))
    table = facts.select("g").distinct().filter("g IS NULL OR g IN ('hot', 'g1', 'g2')").withColumn("v", F.length("g"))
    small = sizing.lookup_join(facts, table, ["g"], how, null_safe=null_safe)
    large = sizing.lookup_join(facts, table, ["g"], how, max_rows=0, null_safe=null_safe)
    assert rows(small) == rows(large)
    assert small.columns == large.columns


def test_lookup_join_plans(spark, skewed):
    _, df = skewed
    table = df.select("g").distinct().withColumn("v", F.lit(1))
    def plan(d):
        return d._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(sizing.lookup_join(df, table, ["g"]))
    assert "__salt" in sizing.lookup_join(df, table, ["g"], max_rows=0)._jdf.queryExecution().optimizedPlan().toString()


def test_small_caps_are_trimmed_before_the_shuffle(spark, skewed):
    _, df = skewed
    plan = ranking.cap_per_group(df, ["g"], ["name"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4 and "Partial" in plan
