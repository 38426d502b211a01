import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tagloom.operators import evaluation as ev


def vocab(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "class_idx long, class_name string")


@pytest.fixture(scope="module")
def predictions(spark):
    data = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 3 + [("b", "c")] + [("c", "a")] * 2
    return spark.createDataFrame(data, "true string, pred string"), vocab(spark, ["a", "b", "c", "d"])


def test_confusion_and_reports(spark, predictions):
    df, names = predictions
    cm = ev.confusion(df, "true", "pred")
    assert rows(cm) == [("a", "a", 3), ("a", "b", 1), ("b", "b", 3), ("b", "c", 1), ("c", "a", 2)]
    assert rows(ev.confusion_wide(cm, names)) == [
        (0, "a", 3, 1, 0, 0), (1, "b", 0, 3, 1, 0), (2, "c", 2, 0, 0, 0), (3, "d", 0, 0, 0, 0)]
    per = ev.worst_first(ev.per_class_accuracy(cm, names)).collect()
    assert [(r["class_name"], r["test_samples"], r["accuracy"]) for r in per] == [
        ("c", 2, 0.0), ("d", 0, 0.0), ("a", 4, 0.75), ("b", 4, 0.75)]
    assert [r["class_name"] for r in ev.weakest(ev.per_class_accuracy(cm, names), 3).collect()] == ["c", "d", "a"]
    assert tuple(ev.top1_accuracy(cm).first()) == (6, 10, 0.6)
    assert tuple(ev.top1_accuracy(cm.limit(0)).first()) == (0, 0, 0.0)


def test_wide_form_has_no_limit_on_classes(spark):
    vocab = spark.createDataFrame([(i, f"c{i:04d}") for i in range(300)], "class_idx int, class_name string")
    cm = spark.createDataFrame([("c0000", "c0299", 5)], "true string, pred string, n bigint")
    wide = ev.confusion_wide(cm, vocab)
    assert len(wide.columns) == 302 and wide.filter("class_idx = 0").first()["c0299"] == 5


def test_epoch_metrics(spark):
    data = [("r", 0, 0, 1.0, 16, 32), ("r", 0, 1, 4.0, 4, 8), ("r", 1, 0, 2.0, 0, 0)]
    df = spark.createDataFrame(data, "run string, epoch int, batch int, loss double, correct long, n long")
    got = ev.epoch_metrics(df, ["run", "epoch"], F.col("loss"), F.col("correct"), F.col("n"))
    assert rows(got) == [("r", 0, 40, 1.6, 50.0), ("r", 1, 0, None, None)]


def test_stage_report(spark):
    df = spark.createDataFrame([("a", True, False), ("a", False, True), ("b", True, False)], "c string, k boolean, x boolean")
    assert rows(ev.stage_report(df, "c", F.col("k"), F.col("x"))) == [
        ("a", 0, 2, 1, 1, 1), ("b", 0, 1, 1, 0, 0), (None, 1, 3, 2, 1, 1)]


def stop_by_definition(values, patience):
    """Each epoch is judged from the whole history before it."""
    history = [[0.0] + [v for v in values[:e] if v == v] for e in range(len(values) + 1)]
    up = [v > max(history[e]) for e, v in enumerate(values)]
    quiet = [e for e in range(patience - 1, len(values)) if not any(up[e - patience + 1: e + 1])]
    seen = range(quiet[0] + 1 if quiet else len(values))
    return quiet[0] if quiet else None, max([e for e in seen if up[e]], default=-1), max(history[len(seen)])


@pytest.mark.parametrize("patience, chunk", [(6, 65_536), (6, 4), (3, 1), (1, 5), (2, 7)])
def test_early_stop(spark, patience, chunk):
    rng = random.Random(patience * 100 + chunk)
    runs = {
        "plateau5": [1.0] + [0.5] * 5 + [2.0] + [0.1] * 3,
        "plateau6": [1.0] + [0.5] * 6 + [2.0],
        "plateau7": [1.0] + [0.5] * 7 + [2.0],
        "equal": [3.0] * 12,
        "zero": [0.0] * 12,
        "short": [0.0] * 3,
        "rising": [float(i) for i in range(1, 40)],
        "nan": [1.0, float("nan"), 2.0] + [float("nan")] * 9,
    }
    for k in range(40):
        runs[f"r{k}"] = [round(rng.random() * (1 + e / 9), 1) for e in range(rng.randint(1, 60))]
    data = [(r, e, v) for r, vs in runs.items() for e, v in enumerate(vs)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "run string, epoch int, acc double")
    got = {r["run"]: tuple(r)[1:] for r in ev.early_stop(df, "run", "epoch", "acc", patience, chunk).collect()}
    assert got == {r: stop_by_definition(vs, patience) for r, vs in runs.items()}
