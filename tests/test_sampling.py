import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tagloom.functions import fixed
from tagloom.operators import sampling
from tagloom.operators.evaluation import class_counts, class_weights
from tagloom.operators.ranking import class_vocabulary
from tagloom.plans.training import prepare, second_phase


def md5(*parts):
    return hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()


def uniform(*parts):
    return int(md5(*parts)[:13], 16) / 16**13


SIZES = {"one": 1, "two": 2, "three": 3, "four": 4, "f15": 15, "f25": 25, "f35": 35, "hot": 3000}


@pytest.fixture(scope="module")
def items(spark):
    data, i = [], 0
    for name, n in SIZES.items():
        for _ in range(n):
            data.append((i, name))
            i += 1
    return data, spark.createDataFrame(data, "id long, label string")


# class size -> rows of (test, val)
HELD = {1: (0, 0), 2: (0, 0), 3: (1, 0), 4: (1, 1), 15: (2, 2), 25: (2, 2), 35: (4, 4), 3000: (300, 300)}


def expected_split(data, seed):
    groups = collections.defaultdict(list)
    for i, label in data:
        groups[label].append(i)
    out = {}
    for ids in groups.values():
        test, val = HELD[len(ids)]
        kinds = ["test"] * test + ["val"] * val + ["train"] * (len(ids) - test - val)
        out.update(zip(sorted(ids, key=lambda i: (md5(seed, i), i)), kinds))
    return out


@pytest.mark.parametrize("parts", [1, 16])
def test_stratified(spark, items, parts):
    data, df = items
    got = sampling.stratified_split(df.orderBy(F.xxhash64("id")).repartition(parts), "label", "id")
    assert got.columns == ["id", "label", "split"]
    assert {r["id"]: r["split"] for r in got.collect()} == expected_split(data, 42)


def test_stratified_sizes(spark, items):
    got = sampling.stratified_split(items[1], "label", "id").groupBy("label", "split").count().collect()
    sizes = {(r["label"], r["split"]): r["count"] for r in got}
    assert sizes[("one", "train")] == 1 and sizes[("two", "train")] == 2
    assert sizes[("three", "test")] == 1 and ("three", "val") not in sizes
    assert sizes[("four", "test")] == 1 and sizes[("four", "val")] == 1
    assert sizes[("f25", "test")] == 2 and sizes[("f35", "val")] == 4 and sizes[("f15", "test")] == 2


@pytest.mark.parametrize("sigmas", [0.01, 1, 1000])
def test_stratified_null_label_and_interval_widths(spark, items, monkeypatch, sigmas):
    """Intervals that miss the cut are widened; intervals that hold all rows work too."""
    data, df = items
    monkeypatch.setattr(sampling, "SIGMAS", sigmas)
    got = sampling.stratified_split(df.withColumn("label", F.when(F.col("label") != "hot", F.col("label"))), "label", "id")
    want = expected_split([(i, None if x == "hot" else x) for i, x in data], 42)
    assert {r["id"]: r["split"] for r in got.collect()} == want


def test_split_does_not_shuffle_the_items(spark, items):
    plan = sampling.stratified_split(items[1], "label", "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize("n", [0, 1, 4, 999])
def test_plain_split(spark, n):
    df = spark.range(n).toDF("id")
    got = {r["id"]: r["split"] for r in sampling.random_split_exact(df, "id").collect()}
    order = sorted(range(n), key=lambda i: (md5(42, i), i))
    assert got == {i: "train" if k < int(0.8 * n) else "val" for k, i in enumerate(order)}


def expected_draws(data, draws, seed=42):
    groups = collections.defaultdict(list)
    for i, label in data:
        groups[label].append(i)
    names = sorted(groups)
    for ids in groups.values():
        ids.sort(key=lambda i: (md5(f"{seed}:row", i), i))
    out = []
    for d in draws:
        label = names[int(uniform(f"{seed}:class", d) * len(names))]
        ids = groups[label]
        out.append((d, label, ids[int(uniform(f"{seed}:pick", d) * len(ids))]))
    return sorted(out)


@pytest.mark.parametrize("copies", [10_000, 50])
def test_resample(spark, items, monkeypatch, copies):
    """With few copies per task the row of the smallest class is spread over salts."""
    data, df = items
    monkeypatch.setattr(sampling, "TARGET_COPIES", copies)
    got = sampling.balanced_resample(df, "label", "id")
    assert rows(got) == sorted(expected_draws(data, [i for i, _ in data]), key=lambda r: tuple((False, str(x)) for x in r))


def test_resample_given_size_is_balanced(spark, items):
    data, df = items
    got = sampling.balanced_resample(df, "label", "id", n=20_000).groupBy("label").count().collect()
    assert len(got) == len(SIZES)
    assert all(abs(r["count"] - 2500) < 250 for r in got)


def test_weights_and_counts(spark, items):
    _, df = items
    got = class_weights(df, "label").groupBy("label").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r["w"] - 1) < 1e-9 for r in got)
    vocab = class_vocabulary(df, "label")
    counts = class_counts(df.filter("label <> 'hot'"), "label", vocab)
    assert {r["class_name"]: r["n"] for r in counts.collect()} == {**SIZES, "hot": 0}


def test_recipes(spark):
    df = spark.range(4000).toDF("id")
    got = sampling.draw_recipes(df, "id", variants=2).collect()
    assert len(got) == 8000
    assert rows(sampling.draw_recipes(df.repartition(13), "id", variants=2)) == sorted(
        (tuple(r) for r in got), key=lambda r: tuple((x is None, str(x)) for x in r))
    share = collections.Counter(r["style"] for r in got)
    assert abs(share["none"] / 8000 - 0.1) < 0.02
    assert all(abs(share[s] / 8000 - 0.3) < 0.03 for s in fixed.SKETCH_STYLES)
    lows = {r["lo"] for r in got if r["style"] == "edge"}
    gaps = {r["hi"] - r["lo"] for r in got if r["style"] == "edge"}
    assert (min(lows), max(lows)) == (40, 100) and (min(gaps), max(gaps)) == (40, 120)
    assert {r["block"] for r in got if r["style"] == "threshold"} == {7, 9, 11, 15, 21}
    assert {r["c"] for r in got if r["style"] == "threshold"} == set(range(2, 10))
    assert all(8 <= r["blur_radius"] <= 28 and 0.35 <= r["alpha"] <= 0.75 for r in got if r["style"] == "pencil")
    assert all(r["blur_radius"] is None for r in got if r["style"] != "pencil")
    assert all(r["post_blur"] is None for r in got if r["style"] == "none")
    soft = [r["post_blur"] for r in got if r["post_blur"] is not None]
    assert abs(len(soft) / (8000 - share["none"]) - 0.3) < 0.03 and min(soft) >= 0.5 and max(soft) <= 1.5


@pytest.mark.parametrize("p, styles", [(0.0, {"none"}), (1.0, {"pencil"})])
def test_recipe_bounds(spark, p, styles):
    got = sampling.draw_recipes(spark.range(300).toDF("id"), "id", p=p, styles=("pencil",))
    assert {r["style"] for r in got.collect()} == styles


def test_preview(spark):
    order = sorted(range(500), key=lambda i: (md5(42, i), i))
    got = sampling.preview(spark.range(500).toDF("id"), "id", n=5)
    assert rows(got) == sorted([(order[k * 32], k) for k in range(5)], key=lambda r: tuple((False, str(x)) for x in r))
    assert sampling.preview(spark.range(40).toDF("id"), "id", n=5).count() == 2


def test_prepare_and_second_phase(spark, items):
    data, df = items
    out = prepare(df, "label", "id")
    split = expected_split(data, 42)
    train = [(i, x) for i, x in data if split[i] == "train"]
    assert {r["id"]: r["split"] for r in out.items.collect()} == split
    assert out.draws.count() == len(train)
    assert {r["id"] for r in out.draws.collect()} <= {i for i, _ in train}
    assert {r["label"] for r in out.weights.collect()} == set(SIZES)
    two = second_phase(out.items, "id", variants=3)
    held = two.filter("phase_split = 'held_out'")
    assert two.count() - held.count() == 3 * len(train)
    assert held.count() == len(data) - len(train) and {r["style"] for r in held.collect()} == {"pencil"}
