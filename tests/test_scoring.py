import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tagloom.functions import fixed, vectors as fn
from tagloom.operators import gate, scoring
from tagloom.operators.head import fit_head
from tagloom.plans.training import two_phase_heads

RNG = np.random.default_rng(3)


def table(spark, matrix, label=None):
    data = [(i, [float(x) for x in v], int(label[i]) if label is not None else 0) for i, v in enumerate(matrix)]
    return spark.createDataFrame(data, "id long, vec array<float>, label int")


def soft(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def column(df, col):
    return np.array([r[0] for r in df.orderBy("id").select(col).collect()])


def test_vector_functions(spark):
    x = RNG.normal(size=(20, 8)).astype(np.float32).astype(float)
    y = RNG.integers(0, 8, 20)
    df = table(spark, x, y)
    v = F.col("vec")
    np.testing.assert_allclose(column(df, fn.l2_normalise(v)), x / np.linalg.norm(x, axis=1, keepdims=True), rtol=1e-9)
    np.testing.assert_allclose(column(df, fn.softmax(v, 3.0)), soft(3 * x), rtol=1e-9)
    np.testing.assert_allclose(column(df, fn.softmax(v, 1000.0)).sum(axis=1), 1)
    assert list(column(df, fn.argmax(v))) == list(x.argmax(axis=1))
    logp = np.log(soft(x))
    plain = -logp[np.arange(20), y]
    np.testing.assert_allclose(column(df, fn.smoothed_cross_entropy(v, F.col("label"), 0.0)), plain, rtol=1e-9)
    np.testing.assert_allclose(
        column(df, fn.smoothed_cross_entropy(v, F.col("label"))), 0.9 * plain + 0.1 * -logp.mean(axis=1), rtol=1e-9)
    mean, std = (np.tile(p, 3)[:8] for p in fixed.IMAGENET_NORM)
    np.testing.assert_allclose(column(df, fn.channel_normalise(v)), (x / 255 - mean) / std, rtol=1e-9)
    np.testing.assert_allclose(
        column(df, fn.channel_restore(fn.channel_normalise(v, fixed.HALF_NORM))), x / 255, rtol=1e-6, atol=1e-9)
    np.testing.assert_allclose(column(df, fn.dot(v, v)), (x * x).sum(axis=1), rtol=1e-9)
    want = ["".join("1" if c > np.median(r) else "0" for c in r) for r in x]
    assert list(column(df, fn.median_bits(v))) == want


def test_matrix_softmax_skips_null(spark):
    w, b = RNG.normal(size=(5, 4)), RNG.normal(size=5)
    x = RNG.normal(size=(9, 4)).astype(np.float32).astype(float)
    df = table(spark, x).withColumn("vec", F.when(F.col("id") % 3 != 0, F.col("vec")))
    got = {r["id"]: r["p"] for r in df.select("id", fn.matrix_softmax(F.col("vec"), w, b).alias("p")).collect()}
    want = soft(x @ w.T + b)
    for i in range(9):
        if i % 3 == 0:
            assert got[i] is None
        else:
            np.testing.assert_allclose(got[i], want[i], rtol=1e-9)
    none = df.filter("vec IS NULL").select(fn.ranked_pairs(fn.matrix_softmax(F.col("vec"), w), 2).alias("p"))
    assert [r["p"] for r in none.collect()] == [None] * 3


@pytest.mark.parametrize("rank", [scoring.top_k, scoring.best_k])
def test_top_k_ties_and_limits(spark, rank):
    df = spark.createDataFrame([(1, [0.2, 0.4, 0.4, 0.0])], "id int, p array<double>")
    names = ["a", "b", "c", "d"]
    got = df.select(rank(F.col("p"), names, 2).alias("t")).first()["t"]
    assert [(r["name"], r["confidence"]) for r in got] == [("b", 40.0), ("c", 40.0)]
    assert len(df.select(rank(F.col("p"), names, 9).alias("t")).first()["t"]) == 4
    with pytest.raises(ValueError):
        rank(F.col("p"), names, 0)


def routed(spark, new, old, **kw):
    """Route rows with given first predictions and given second probabilities."""
    df = spark.createDataFrame(
        [(i, n, o) for i, (n, o) in enumerate(zip(new, old))],
        "id long, predictions array<struct<name:string,confidence:double>>, vec array<double>")

    class Echo:
        names = ["Mime", "MrMime", "Abra"]

        def __call__(self, df, features, out):
            return df.withColumn(out, F.col(features))

    out = scoring.route(df, "predictions", "vec", Echo(), ["Abra", "Mr. Mime"], **kw)
    return {r["id"]: (r["model"], [tuple(p) for p in r["predictions"]]) for r in out.collect()}


def test_route_threshold_members_aliases(spark):
    abra, other = [("Abra", 90.0), ("X", 1.0)], [("X", 90.0), ("Abra", 1.0)]
    edge = fixed.TRUST
    below = float(np.nextafter(edge, 0))
    got = routed(spark, [abra, other, abra, abra], [[edge, 1 - edge, 0.0], [0.9, 0.1, 0.0], [below, 1 - below, 0.0], [0.5, 0.1, 0.4]])
    assert got[0][0] == "legacy-gen1"
    assert [n for n, _ in got[0][1]] == ["Mr. Mime", "Mr. Mime", "Abra"]  # not merged
    assert got[1] == ("gen1-3", other)
    assert got[2][0] == "gen1-3"
    assert got[3] == ("gen1-3", abra)


def test_second_model_sees_members_only(spark, tmp_path):
    """The second scorer is asked for member rows and, once per row, for no others."""
    log = str(tmp_path / "asked")

    def make():
        def predict(x):
            with open(log, "a") as f:
                f.write("x" * len(x))
            return np.tile([[0.7, 0.2, 0.1]], (len(x), 1))
        return predict

    x = RNG.normal(size=(60, 4))
    df = table(spark, x).withColumn("predictions", F.array(F.struct(
        F.when(F.col("id") < 7, "Abra").otherwise("Zed").alias("name"), F.lit(99.0).alias("confidence"))))
    second = scoring.make_scorer("batch", names=["Abra", "b", "c"], make_predict=make, width=4, batch_size=4)
    out = scoring.route(df, "predictions", "vec", second, ["Abra"]).select("id", "model").collect()
    assert sorted(r["id"] for r in out if r["model"] == "legacy-gen1") == list(range(7))
    assert len(out) == 60
    with open(log) as f:
        assert len(f.read()) == 7


def test_score_runs_each_model_once(spark):
    x = RNG.normal(size=(30, 4))
    a = scoring.PrototypeScorer(["a", "b"], RNG.normal(size=(2, 4)))
    b = scoring.LinearScorer(["a", "b"], RNG.normal(size=(2, 4)), [0.0, 0.0])
    out = scoring.route(scoring.score(table(spark, x), a, "vec"), "predictions", "vec", b, ["a"])
    plan = out.select("id", F.posexplode_outer("predictions"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "Exchange" not in plan


def test_unknown_backbone():
    with pytest.raises(ValueError):
        scoring.make_scorer("nothing")


def test_verdict_and_response(spark):
    data = [(0, "m", [("A", 59.994), ("B", 1.0)]), (1, "m", [("A", 59.996)]), (2, "m", [("Ä", 60.0)])]
    df = spark.createDataFrame(data, "id int, model string, predictions array<struct<name:string,confidence:double>>")
    out = scoring.to_response(scoring.verdict(df)).orderBy("id").collect()
    assert [r["verdict"] for r in out] == ["low", "match", "match"]
    assert [r["top_confidence"] for r in out] == [59.99, 60.0, 60.0]
    assert out[0]["message"] == "best guess: A, 60.0%" and out[2]["message"] == "Ä 60.0%"
    assert json.loads(out[0]["response"]) == {
        "model": "m", "predictions": [{"name": "A", "confidence": 59.99}, {"name": "B", "confidence": 1.0}]}


def expected_decision(x, own, shared, explicit_n, name):
    if name.startswith("seed_"):
        return "trusted"
    if x is None:
        return "unreadable"
    w = np.vstack([own, shared])
    w = w / np.linalg.norm(w, axis=1, keepdims=True)
    p = soft((100 * (x / np.linalg.norm(x)) @ w.T)[None])[0]
    if p[-explicit_n:].sum() > 0.15:
        return "explicit"
    return "off_topic" if p[0] < 0.22 or p.argmax() != 0 else "keep"


def test_gate(spark):
    shared = RNG.normal(size=(8, 3))
    own = {"a": RNG.normal(size=3), "b": RNG.normal(size=3)}
    prompts = [(c, 0, "target", v.tolist()) for c, v in own.items()]
    for c in own:  # the same distractors stored once per class
        prompts += [(c, i + 1, "generic" if i < 5 else "explicit", v.tolist()) for i, v in enumerate(shared)]
    x = RNG.normal(size=(300, 3))
    names = [("seed_" if i % 17 == 0 else "card_") + str(i) for i in range(300)]
    cls = ["a" if i % 3 else "b" for i in range(300)]
    items = [(i, cls[i], names[i], None if i % 29 == 0 else x[i].tolist()) for i in range(300)]
    df = spark.createDataFrame(items, "id int, cls string, f string, vec array<double>")
    pr = spark.createDataFrame(prompts, "class_name string, slot int, kind string, vec array<double>")
    got = {r["id"]: r["decision"] for r in gate.relevance_gate(df, pr, "cls", "vec", "f").collect()}
    want = {i: expected_decision(None if v is None else np.array(v), own[c], shared, 3, f) for i, c, f, v in items}
    assert got == want
    assert set(want.values()) == {"trusted", "unreadable", "explicit", "off_topic", "keep"}
    assert gate.kept(gate.relevance_gate(df, pr, "cls", "vec", "f")).count() == sum(
        d in ("trusted", "keep") for d in want.values())


def test_gate_rejects_prompts_that_differ_by_class(spark):
    pr = spark.createDataFrame(
        [("a", 1, "generic", [1.0]), ("b", 1, "generic", [2.0])], "class_name string, slot int, kind string, vec array<double>")
    with pytest.raises(ValueError):
        gate.shared_vectors(pr)


def test_prompt_rows(spark):
    df = gate.prompt_rows(spark.createDataFrame([("Abra",)], "n string"), "n").orderBy("slot")
    got = df.collect()
    assert [r["kind"] for r in got] == ["target"] + ["generic"] * 5 + ["explicit"] * 3
    assert got[0]["prompt"] == "a picture of Abra, a Pokemon"


@pytest.fixture(scope="module")
def clusters(spark):
    centres = RNG.normal(size=(3, 6))
    y = np.concatenate([RNG.integers(0, 3, 300), np.zeros(200, dtype=int)])
    x = (centres[y] + RNG.normal(size=(500, 6))) * [1, 1, 5, 1, 1, 0.1] + 3
    return x, y, table(spark, x, y).withColumn("cls", F.concat(F.lit("c"), F.col("label"))).repartition(5)


def objective(model, x, y, eps, reg, balanced):
    w, b = np.array(model.weights), np.array(model.bias)
    logp = np.log(soft(x @ w.T + b))
    each = -(1 - eps) * logp[np.arange(len(y)), y] - eps * logp.mean(axis=1)
    c = 1 / np.bincount(y)[y] if balanced else np.ones(len(y))
    mean = (c[:, None] * x).sum(axis=0) / c.sum()
    std = np.sqrt((c[:, None] * (x - mean) ** 2).sum(axis=0) / c.sum())
    return (c * each).sum() / c.sum() + reg / 2 * ((w * std) ** 2).sum()


def test_head_agrees_with_exploded_weighted_rows(spark, clusters):
    """Same optimum as the built-in estimator on one weighted row per class."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x, y, df = clusters
    x = x.astype(np.float32).astype(float)
    eps, reg = 0.1, 0.05
    model = fit_head(df, "vec", "cls", eps, reg, balanced=False, max_iter=100, tol=1e-12)
    copies = df.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features"), F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(2)), lambda k: F.struct(
            k.cast("double").alias("label"), F.when(k == F.col("label"), 1 - eps + eps / 3).otherwise(eps / 3).alias("w")))).alias("s"))
    built_in = LogisticRegression(family="multinomial", weightCol="w", regParam=reg, maxIter=200, tol=1e-12).fit(
        copies.select("features", "s.label", "s.w"))
    p = soft(x @ np.array(model.weights).T + np.array(model.bias))
    q = soft(x @ built_in.coefficientMatrix.toArray().T + built_in.interceptVector.toArray())
    np.testing.assert_allclose(p, q, atol=2e-3)


def test_head_optimum_warm_start_and_merge(spark, clusters, monkeypatch):
    x, y, df = clusters
    x = x.astype(np.float32).astype(float)
    model = fit_head(df, "vec", "cls", max_iter=100, tol=1e-12)
    assert model.names == ["c0", "c1", "c2"]
    best = objective(model, x, y, 0.1, 0.05, True)
    for _ in range(30):  # no nearby head is better
        near = scoring.LinearScorer(
            model.names, np.array(model.weights) + RNG.normal(size=(3, 6)) * 0.02, np.array(model.bias) + RNG.normal(size=3) * 0.02)
        assert objective(near, x, y, 0.1, 0.05, True) >= best - 1e-9
    monkeypatch.setattr("tagloom.operators.head.FAN_IN", 2)
    again = fit_head(df, "vec", "cls", max_iter=1, start=model)
    assert objective(again, x, y, 0.1, 0.05, True) <= best + 1e-9
    cold = fit_head(df, "vec", "cls", max_iter=1)
    assert objective(cold, x, y, 0.1, 0.05, True) > best + 1e-3
    first, second = two_phase_heads(df, df.withColumn("vec", F.transform("vec", lambda v: v * 0.9)), "vec", "cls", max_iter=5)
    assert first.names == second.names and first.weights != second.weights
    fewer = scoring.LinearScorer(["c1", "zz"], [model.weights[1], model.weights[0]], [model.bias[1], 0.0])
    assert fit_head(df, "vec", "cls", max_iter=0, start=fewer).weights[0] == [0.0] * 6
    hits = scoring.score(df, model, "vec", k=1).select("cls", F.get("predictions", F.lit(0))["name"].alias("p"))
    assert hits.filter("cls = p").count() > 330
