"""Operators whose parts are dealt: models in blocks, sparse reports, published versions, deliveries, answers once, recipes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tagloom.functions import fixed
from tagloom.operators import blocked, evaluation, gate, images, sampling, scoring
from tagloom.plans.deliveries import FingerprintStore, curate_delivery
from tagloom.sources import published, writers

RNG = np.random.default_rng(12)


@pytest.fixture(scope="module")
def model(spark):
    """Forty classes; two pairs of them are equal, so their scores tie."""
    w = RNG.normal(size=(40, 6))
    w[30], w[7] = w[3], w[2]
    names = [f"c{i:02d}" for i in range(40)]
    table = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, w)], "n string, v array<double>").repartition(5)
    items = [(i, None if i % 13 == 0 else RNG.normal(size=6).tolist()) for i in range(300)]
    items += [(1000, w[3].tolist()), (1001, w[2].tolist())]
    return table, spark.createDataFrame(items, "id int, x array<double>").repartition(3)


def answers(df):
    return {r["id"]: None if r["predictions"] is None else [(p["name"], round(p["confidence"], 9)) for p in r["predictions"]] for r in df.collect()}


@pytest.mark.parametrize("classes, k", [(13, 5), (39, 3), (100, 60)])
def test_blocks_of_classes_give_the_whole_models_answer(spark, model, classes, k):
    table, items = model
    whole = scoring.score(items, scoring.prototype_scorer(table, "n", "v", 5.0), "x", k=k)
    dealt = scoring.score(items, scoring.blocked_scorer(table, "n", "v", 5.0, block_bytes=classes * 6 * 8), "x", k=k)
    assert answers(dealt) == answers(whole)
    assert dealt.columns == ["id", "x", "predictions"]


def test_a_model_beyond_a_worker_is_dealt_and_not_refused(spark, model, monkeypatch):
    table, items = model
    want = answers(scoring.score(items, scoring.prototype_scorer(table, "n", "v", 5.0), "x"))
    monkeypatch.setattr("tagloom.operators.sizing.BROADCAST_ROWS", 10)
    monkeypatch.setattr(blocked, "BLOCK_BYTES", 11 * 48)
    big = scoring.prototype_scorer(table, "n", "v", 5.0)
    assert isinstance(big, blocked.BlockedScorer)
    assert answers(scoring.score(items, big, "x")) == want
    probs = {r["id"]: r["p"] for r in big(items, "x", "p").collect()}
    assert all((p is None) == (want[i] is None) and (p is None or abs(sum(p) - 1) < 1e-9) for i, p in probs.items())


def test_gate_by_blocks_equals_the_gate(spark):
    shared, own = RNG.normal(size=(8, 3)), {"a": RNG.normal(size=3), "b": RNG.normal(size=3)}
    prompts = [(c, 0, "target", v.tolist()) for c, v in own.items()]
    prompts += [(None, i + 1, "generic" if i < 5 else "explicit", v.tolist()) for i, v in enumerate(shared)]
    pr = spark.createDataFrame(prompts, "class_name string, slot int, kind string, vec array<double>")
    items = [(i, "abz"[i % 3], ("seed_" if i % 17 == 0 else "card_") + str(i), None if i % 29 == 0 else RNG.normal(size=3).tolist()) for i in range(200)]
    items.append((999, "a", "card_tie", shared[2].tolist()))
    df = spark.createDataFrame(items, "id int, cls string, f string, vec array<double>")

    def decided(**options):
        return {r["id"]: (r["decision"], None if r["p_target"] is None else (round(r["p_target"], 9), round(r["p_explicit"], 9)))
                for r in gate.relevance_gate(df, pr, "cls", "vec", "f", **options).collect()}

    want = decided()
    assert {d for d, _ in want.values()} == {"trusted", "unreadable", "explicit", "off_topic", "keep", "no_prompt"}
    assert decided(block_bytes=24) == decided(block_bytes=48) == want
    assert decided(block_bytes=24, scale=1.0) == decided(scale=1.0)


def test_wide_report_of_many_classes(spark, tmp_path):
    """Names with commas, quotes, backslashes and blanks; classes without rows; every part file has the header."""
    n = 1500
    odd = {0: 'a,"b"', 1: "back\\slash", 2: " blank ", 3: "", 4: 'q"'}
    vocab = spark.createDataFrame([(i, odd.get(i, f"name {i}")) for i in range(n)], "class_idx bigint, class_name string")
    cells = {(i, (i * 7 + k) % n): i % 5 + k for i in range(0, n, 3) for k in range(1, 4)}
    cm = spark.createDataFrame([(odd.get(t, f"name {t}"), odd.get(p, f"name {p}"), c) for (t, p), c in cells.items()], "true string, pred string, n bigint")
    writers.write_reports(cm, evaluation.per_class_accuracy(cm, vocab), vocab, str(tmp_path))
    back = spark.read.option("header", True).option("maxColumns", n + 1).csv(f"{tmp_path}/confusion_matrix").collect()
    assert len(back) == n and len(back[0]) == n + 1
    names = {(odd.get(i, f"name {i}") or None): i for i in range(n)}
    got = {(names[r[0]], j - 1): int(r[j]) for r in back for j in range(1, n + 1) if r[j] != "0"}
    assert got == cells
    assert [c.split("{")[0] for c in back[0].__fields__[6:9]] == ["name 5", "name 6", "name 7"]
    dense = {r["class_idx"]: r["counts"] for r in evaluation.confusion_rows(cm, vocab).collect()}
    assert all(dense[t][p] == c for (t, p), c in cells.items()) and all(len(v) == n for v in dense.values())
    assert sum(map(sum, dense.values())) == sum(cells.values())


def test_wide_columns_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "WIDE_COLUMNS", 2)
    vocab = spark.createDataFrame([(i, f"c{i}") for i in range(3)], "class_idx bigint, class_name string")
    cm = spark.createDataFrame([("c0", "c2", 4)], "true string, pred string, n bigint")
    with pytest.raises(ValueError, match="confusion_rows"):
        evaluation.confusion_wide(cm, vocab)
    assert rows(evaluation.confusion_rows(cm, vocab).select("class_name", "counts")) == [("c0", [0, 0, 4]), ("c1", [0, 0, 0]), ("c2", [0, 0, 0])]


def test_accuracy_fails_on_names_that_nobody_knows(spark):
    vocab = spark.createDataFrame([(0, "a")], "class_idx bigint, class_name string")
    for cell in (("a", "b", 1), ("b", "a", 1), ("a", None, 1)):
        cm = spark.createDataFrame([cell], "true string, pred string, n bigint")
        with pytest.raises(Exception, match="not in the vocabulary"):
            evaluation.per_class_accuracy(cm, vocab).select("accuracy").collect()


def test_counts_come_with_the_write(spark, tmp_path):
    df = spark.range(1000).withColumn("good", F.col("id") % 4 > 0)
    stage = evaluation.counted_stage(df, F.col("good"), F.col("id") % 10 == 0)
    stage.rows.where("good").write.parquet(str(tmp_path / "out"))
    assert stage.numbers == {"before": 1000, "kept": 750, "removed": 250, "flagged": 100}
    empty = evaluation.counted_stage(df.limit(0), F.col("good"), F.lit(False))
    empty.rows.write.parquet(str(tmp_path / "none"))
    assert set(empty.numbers.values()) <= {0}


def test_merged_aliases_are_ranked_again(spark):
    entries = [("x", 40.0), ("a", 30.0), ("b", 25.0), ("c", 5.0)]
    df = spark.createDataFrame([(1, entries), (2, []), (3, None)], "id int, p array<struct<name:string,confidence:double>>")
    aliases = {"b": "a", "c": "x"}
    got = {r["id"]: r["m"] for r in df.select("id", scoring.merge_aliases(F.col("p"), aliases, merge=True).alias("m")).collect()}
    assert [tuple(x) for x in got[1]] == [("a", 55.0), ("x", 45.0)] and got[2] == [] and got[3] is None
    kept = df.where("id = 1").select(scoring.merge_aliases(F.col("p"), aliases).alias("m")).first()["m"]
    assert [x["name"] for x in kept] == ["x", "a", "a", "x"]


def test_published_versions(spark, tmp_path):
    root = str(tmp_path / "set")
    with pytest.raises(ValueError, match="nothing published"):
        published.read_published(spark, root)
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 8, "train").otherwise("val"))
    assert published.publish(df, root, by="split") == 1
    assert published.publish(df.limit(3), root, complete=False) is None
    broken = df.withColumn("id", F.when(F.col("id") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        published.publish(broken, root)
    assert published.read_published(spark, root).count() == 10
    assert published.publish(df.where("id < 4"), root) == 2
    assert published.read_published(spark, root).count() == 4 and published.read_published(spark, root, 1).count() == 10
    assert rows(published.commits(spark, root).select("version", "n_rows")) == [(1, 10), (2, 4)]
    with pytest.raises(ValueError, match="no version 7"):
        published.read_published(spark, root, 7)


def test_deliveries_move_only_the_new_rows(spark):
    store = FingerprintStore(spark, "tagloom_test_store", "g", "fp", buckets=4)
    spark.sql("DROP TABLE IF EXISTS tagloom_test_store")
    try:
        one = spark.createDataFrame([("a", "f1", "2"), ("a", "f1", "1"), (None, "f1", "3"), ("-", "f1", "4"), ("a", None, "9")], "g string, fp string, name string")
        two = spark.createDataFrame([("a", "f1", "0"), ("a", "f2", "5"), (None, "f1", "6"), ("-", "f1", "6"), ("b", "f1", "7"), (None, "f3", "8")], one.schema)
        assert rows(curate_delivery(store, one, "name").select("name")) == [("1",), ("3",), ("4",)]
        plan = store.unseen(two)._jdf.queryExecution().executedPlan().toString()
        side = plan[plan.index("tagloom_test_store") - 600:] if "tagloom_test_store" in plan else plan
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in side
        assert rows(curate_delivery(store, two, "name").select("name")) == [("5",), ("7",), ("8",)]
        assert curate_delivery(store, two, "name").count() == 0 and store.stored().count() == 6
    finally:
        spark.sql("DROP TABLE IF EXISTS tagloom_test_store")


def picture(i, h=9, w=7, channels=1):
    return (f"f{i}", h, w, channels, 0, RNG.integers(0, 256, h * w * channels, dtype=np.uint8).tobytes())


def test_recipes_without_a_kernel_become_pencil(spark):
    recipes = sampling.draw_recipes(spark.range(300).toDF("id"), "id", variants=2).persist()
    plans = {(r["id"], r["variant"]): r for r in images.drawable(recipes, "id").collect()}
    pencil = {(r["id"], r["variant"]): r for r in sampling.draw_recipes(spark.range(300).toDF("id"), "id", variants=2, styles=("pencil",)).collect()}
    assert {p["style"] for p in plans.values()} == {"none", "pencil"}
    for key, p in plans.items():
        assert (p["style"], p["blur_radius"], p["alpha"], p["post_blur"]) == tuple(pencil[key][c] for c in ("style", "blur_radius", "alpha", "post_blur"))
        assert p["lo"] is None and p["block"] is None


def test_recipe_table_into_pixels(spark):
    data = [(i, picture(i, channels=c)) for i, c in ((0, 1), (1, 3), (2, 4))] + [(3, ("bad", -1, -1, -1, -1, b""))]
    df = spark.createDataFrame(data, f"id int, image {images.IMAGE_TYPE}").withColumn("style0", F.lit("x"))
    recipes = spark.createDataFrame(
        [(i, v, s, r, a, p) for i in (0, 1, 2, 3, 8) for v, s, r, a, p in ((5, "pencil", 9.0, 0.5, None), (2, "none", None, None, None), (9, "pencil", 1.5, 0.7, 0.8))],
        "id int, variant int, style string, blur_radius double, alpha double, post_blur double")
    got = {(r["id"], r["variant"]): r for r in images.augment_recipes(df, recipes, "id").collect()}
    assert set(got) == {(i, v) for i in (0, 1, 2) for v in (2, 5, 9)}
    for (i, v), r in got.items():
        _, h, w, c, _, raw = data[i][1]
        px = np.frombuffer(raw, np.uint8).reshape(h, w, c)
        recipe = {5: {"style": "pencil", "blur_radius": 9.0, "alpha": 0.5, "post_blur": None}, 2: {"style": "none"},
                  9: {"style": "pencil", "blur_radius": 1.5, "alpha": 0.7, "post_blur": 0.8}}[v]
        assert r["image"]["data"] == images._draw(px, recipe).tobytes() and r["image"]["nChannels"] == 3 and r["style0"] == "x"


@pytest.mark.parametrize("radius", [4.0, 8.0, 28.0])
def test_stacked_boxes_are_a_gaussian(radius):
    x = RNG.integers(0, 256, (30, 50)).astype(float)
    reach = int(5 * radius)
    taps = np.exp(-0.5 * (np.arange(-reach, reach + 1) / radius) ** 2)
    taps /= taps.sum()

    def along(rows_):
        return np.array([np.convolve(r, taps, "valid") for r in np.pad(rows_, ((0, 0), (reach, reach)), mode="edge")])

    want = along(along(x).T).T
    got = images._blur_rows(images._blur_rows(x, radius).T, radius).T
    assert np.abs(got - want).max() < 1.0
    flat = np.full((5, 9), 77.0)
    assert np.allclose(images._blur_rows(flat, radius), 77.0)


def test_answers_once_over_restarts(spark, tmp_path):
    from tagloom.streaming.scoring import stream_answer_once

    schema = "id int, x array<double>"
    first = scoring.PrototypeScorer(["a", "b"], np.eye(2).tolist(), 10.0)
    options = dict(keys=["id"], features="x", first=first, second=first, members=[], files_per_batch=1)

    def run(items):
        spark.createDataFrame([(i, [1.0, 0.2 * i]) for i in items], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream_answer_once(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, str(tmp_path / "out"), str(tmp_path / "log"), **options)
        assert q.awaitTermination(180)
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run([1, 2, 2, 3]) == [1, 2, 3]
    assert run([3, 4, 1]) == [1, 2, 3, 4]
    # a batch that runs again replaces its answers
    batch = spark.read.parquet(str(tmp_path / "out" / "batch=1"))
    assert sorted(r["id"] for r in batch.collect()) == [4]
    assert fixed.TRUST == 0.55
