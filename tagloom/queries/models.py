"""Scoring, routing, evaluation and head training on the embeddings table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tagloom.functions.vectors import argmax
from tagloom.operators import evaluation, scoring
from tagloom.operators.head import first_gradient, fit_head
from tagloom.operators.sampling import stratified_split
from tagloom.operators.sizing import settle
from tagloom.queries.registry import query
from tagloom.queries.shared import (
    ALIASES_B, MEMBERS, VECTORS_SQL, first_vectors, model_a, model_b, probs_sql, split_sql, vectors, vocabulary_of,
)

_TOP = """top_{m} AS (SELECT vec_id, rnk, cls AS name, p * 100 AS confidence FROM p_{m} WHERE rnk <= 3)"""
_MEMBER_LIST = ", ".join(f"'{m}'" for m in MEMBERS)

ROUTE_SQL = f"""{VECTORS_SQL}, {probs_sql('a')}, {probs_sql('b')}, {_TOP.format(m='a')}, {_TOP.format(m='b')},
sure AS (SELECT b.vec_id FROM top_b b JOIN top_a a USING (vec_id) WHERE a.rnk = 1 AND b.rnk = 1
  AND a.name IN ({_MEMBER_LIST}) AND b.confidence >= 0.55::DOUBLE * 100),
routed AS (SELECT vec_id, rnk, name, confidence, 'gen1-3' AS model FROM top_a WHERE vec_id NOT IN (SELECT vec_id FROM sure)
  UNION ALL SELECT vec_id, rnk, CASE name WHEN 'c3_old' THEN 'c3' ELSE name END, confidence, 'legacy-gen1' FROM top_b
  WHERE vec_id IN (SELECT vec_id FROM sure))"""


def _ranks(df, *keys):
    return df.select(*keys, F.posexplode_outer("predictions").alias("i", "s")).select(
        *keys, (F.col("i") + 1).alias("rnk"), F.col("s.name").alias("name"), F.round("s.confidence", 4).alias("confidence"))


@query("w4_top_k", f"""WITH {VECTORS_SQL}, {probs_sql('a')}, {_TOP.format(m='a')}
SELECT vec_id, rnk::INT AS rnk, name, round(confidence, 4) AS confidence FROM top_a""")
def top_k(spark, sf):
    v = vectors(spark, sf)
    model = model_a(v)
    ranked = scoring.top_k(F.col("p"), model.names)
    return _ranks(model(v, "embedding", "p").withColumn("predictions", ranked), "vec_id")


@query("m2_score", f"""WITH {VECTORS_SQL}, {probs_sql('a')}
SELECT vec_id, truth, cls AS name, round(p * 100, 4) AS confidence FROM p_a WHERE rnk = 1""")
def score(spark, sf):
    v = vectors(spark, sf)
    best = F.get("predictions", F.lit(0))
    return scoring.score(v, model_a(v), "embedding", k=1).select(
        "vec_id", F.col("cls").alias("truth"), best["name"].alias("name"), F.round(best["confidence"], 4).alias("confidence"))


@query("m2_score_blocked", f"""WITH {VECTORS_SQL}, {probs_sql('a')}, {_TOP.format(m='a')}
SELECT vec_id, rnk::INT AS rnk, name, round(confidence, 4) AS confidence FROM top_a""")
def score_blocked(spark, sf):
    """The best three classes, with the model dealt in blocks of three classes."""
    v = vectors(spark, sf)
    model = scoring.blocked_scorer(first_vectors(v), "cls", "vec", block_bytes=3 * 64 * 8)
    return _ranks(scoring.score(v.select("vec_id", "embedding"), model, "embedding"), "vec_id")


@query("m5_batch_scorer", f"""WITH {VECTORS_SQL}, {probs_sql('a')}
SELECT vec_id, truth, cls AS name, round(p * 100, 4) AS confidence FROM p_a WHERE rnk = 1""")
def batch_scorer(spark, sf):
    """The model of ``m2_score`` behind a loader."""
    v = vectors(spark, sf)
    model = model_a(v)
    w = np.asarray(model.vectors, dtype=np.float64)

    def make():
        unit = w / np.linalg.norm(w, axis=1, keepdims=True)

        def predict(x):
            z = model.scale * (x / np.linalg.norm(x, axis=1, keepdims=True)) @ unit.T
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return predict

    second = scoring.make_scorer("batch", names=model.names, make_predict=make, width=w.shape[1])
    best = F.get("predictions", F.lit(0))
    return scoring.score(v, second, "embedding", k=1).select(
        "vec_id", F.col("cls").alias("truth"), best["name"].alias("name"), F.round(best["confidence"], 4).alias("confidence"))


# The last two classes are outside the vocabulary of these reports.
_PART_SQL = f"""{VECTORS_SQL}, {probs_sql('a')}, part AS (SELECT cls FROM proto_a WHERE idx + 2 < (SELECT count(*) FROM proto_a)),
seen AS (SELECT CASE WHEN truth IN (SELECT cls FROM part) THEN truth ELSE 'other' END AS "true",
  CASE WHEN cls IN (SELECT cls FROM part) THEN cls ELSE 'other' END AS pred FROM p_a WHERE rnk = 1)"""


def _partial(spark, sf):
    cm, vocab = confusion_inputs(spark, sf)
    last = vocab.agg(F.max("class_idx")).scalar()
    return cm, vocab.where(F.col("class_idx") + 1 < last)


@query("a4_confusion_other", f"""WITH {_PART_SQL} SELECT "true" AS class_name, count(*) AS n,
count(CASE WHEN pred = 'other' THEN 1 END) AS other FROM seen GROUP BY 1""")
def confusion_other(spark, sf):
    cm, vocab = _partial(spark, sf)
    wide = evaluation.confusion_wide(cm, vocab, "other")
    cells = [F.col(f"`{c}`") for c in wide.columns if c not in ("class_idx", "class_name")]
    return wide.select("class_name", sum(cells, F.lit(0).cast("bigint")).alias("n"), "other")


@query("a5_accuracy_other", f"""WITH {_PART_SQL} SELECT "true" AS class_name, count(*) AS test_samples,
count(CASE WHEN "true" = pred AND pred <> 'other' THEN 1 END) AS correct FROM seen GROUP BY 1""")
def accuracy_other(spark, sf):
    cm, vocab = _partial(spark, sf)
    return evaluation.per_class_accuracy(cm, vocab, "other").select("class_name", "test_samples", "correct")


PRED_SQL = f"""{VECTORS_SQL}, {probs_sql('a')}, pred AS (SELECT vec_id, truth AS "true", cls AS pred FROM p_a WHERE rnk = 1),
cm AS (SELECT "true", pred, count(*) AS n FROM pred GROUP BY ALL),
per AS (SELECT idx AS class_idx, cls AS class_name, coalesce(t, 0)::BIGINT AS test_samples, coalesce(c, 0)::BIGINT AS correct, coalesce(c / t, 0.0) AS accuracy
  FROM proto_a LEFT JOIN (SELECT "true" AS cls, sum(n)::DOUBLE AS t, sum(CASE WHEN "true" = pred THEN n ELSE 0 END)::DOUBLE AS c FROM cm GROUP BY 1) USING (cls))"""


_MERGE = {"c1": "c0", "c4": "c0", "c7": "c2"}


@query("t4_merge_aliases", f"""WITH {VECTORS_SQL}, {probs_sql('a')}, top AS (SELECT vec_id, rnk, p * 100 AS confidence,
  CASE cls WHEN 'c1' THEN 'c0' WHEN 'c4' THEN 'c0' WHEN 'c7' THEN 'c2' ELSE cls END AS name FROM p_a WHERE rnk <= 4),
merged AS (SELECT vec_id, name, min(rnk) AS place, sum(confidence) AS confidence FROM top GROUP BY vec_id, name)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY confidence DESC, place)::INT AS rnk, name, round(confidence, 4) AS confidence FROM merged""")
def merge_aliases(spark, sf):
    """Four best classes, three of them aliases: entries of one name are added up and ranked again."""
    v = vectors(spark, sf)
    best = scoring.score(v, model_a(v), "embedding", k=4)
    return _ranks(best.withColumn("predictions", scoring.merge_aliases(F.col("predictions"), _MERGE, merge=True)), "vec_id")


@query("a4_confusion_rows", f"""WITH {PRED_SQL} SELECT t.idx AS class_idx, t.cls AS class_name, p.cls AS pred, coalesce(n, 0)::BIGINT AS n
FROM proto_a t CROSS JOIN proto_a p LEFT JOIN cm ON cm."true" = t.cls AND cm.pred = p.cls""")
def confusion_rows(spark, sf):
    """All cells without a column per class."""
    cm, vocab = confusion_inputs(spark, sf)
    cells = evaluation.confusion_rows(cm, vocab).select("class_idx", "class_name", F.posexplode("counts").alias("at", "n"))
    names = vocab.select(F.col("class_idx").alias("i"), F.col("class_name").alias("pred"))
    return cells.join(names, F.col("at") == F.col("i")).select("class_idx", "class_name", "pred", "n")


def routed(spark, sf):
    v = vectors(spark, sf)
    return scoring.route(
        scoring.score(v, model_a(v), "embedding"), "predictions", "embedding", model_b(v), MEMBERS, ALIASES_B)


@query("m3_route", f"WITH {ROUTE_SQL} SELECT vec_id, model, rnk::INT AS rnk, name, round(confidence, 4) AS confidence FROM routed")
def route(spark, sf):
    return _ranks(routed(spark, sf), "vec_id", "model")


@query("j4_route_share", f"""WITH {ROUTE_SQL} SELECT truth, model, count(*) AS items FROM routed JOIN (SELECT vec_id, cls AS truth FROM vecs) USING (vec_id)
WHERE rnk = 1 GROUP BY ALL""")
def route_share(spark, sf):
    return routed(spark, sf).groupBy(F.col("cls").alias("truth"), "model").agg(F.count(F.lit(1)).alias("items"))


_VERDICT = """SELECT vec_id, name AS top_name, round(confidence, 2) AS top_confidence,
CASE WHEN round(confidence, 2) < 60 THEN 'low' ELSE 'match' END AS verdict,
CASE WHEN round(confidence, 2) < 60 THEN 'best guess: ' || name || ', ' ELSE name || ' ' END || format('{:.1f}', round(round(confidence, 2), 1)) || '%' AS message
FROM routed WHERE rnk = 1"""


@query("t11_verdict", f"WITH {ROUTE_SQL} {_VERDICT}")
def verdict(spark, sf):
    return scoring.verdict(routed(spark, sf)).select("vec_id", "top_name", "top_confidence", "verdict", "message")


@query("t12_to_response", f"""WITH {ROUTE_SQL} SELECT vec_id, to_json({{'model': any_value(model), 'predictions':
list({{'name': name, 'confidence': round(confidence, 2)}} ORDER BY rnk)}})::VARCHAR AS response FROM routed GROUP BY vec_id""")
def to_response(spark, sf):
    return scoring.to_response(routed(spark, sf)).select("vec_id", "response")


def confusion_inputs(spark, sf):
    v = vectors(spark, sf)
    model = model_a(v)
    names = F.array(*[F.lit(n) for n in model.names])
    pred = model(v, "embedding", "p").select("cls", F.get(names, argmax(F.col("p"))).alias("pred"))
    return evaluation.confusion(pred, "cls", "pred"), vocabulary_of(model, spark)


@query("a3_confusion", f"WITH {PRED_SQL} SELECT * FROM cm")
def confusion(spark, sf):
    return confusion_inputs(spark, sf)[0]


@query("a4_confusion_wide", f"WITH {PRED_SQL} SELECT idx AS class_idx, a.cls AS class_name, "
       + ", ".join(f"coalesce(sum(CASE WHEN pred = 'c{i}' THEN n END), 0)::BIGINT AS c{i}" for i in range(10))
       + ' FROM proto_a a LEFT JOIN cm ON cm."true" = a.cls GROUP BY 1, 2')
def confusion_wide(spark, sf):
    cm, vocab = confusion_inputs(spark, sf)
    return evaluation.confusion_wide(cm, vocab)


@query("a5_per_class_accuracy", f"WITH {PRED_SQL} SELECT * REPLACE (round(accuracy, 6) AS accuracy) FROM per")
def per_class_accuracy(spark, sf):
    cm, vocab = confusion_inputs(spark, sf)
    return evaluation.worst_first(evaluation.per_class_accuracy(cm, vocab)).withColumn("accuracy", F.round("accuracy", 6))


@query("a6_top1_accuracy", f"""WITH {PRED_SQL} SELECT sum(CASE WHEN "true" = pred THEN n ELSE 0 END)::BIGINT AS correct, sum(n)::BIGINT AS total,
round(sum(CASE WHEN "true" = pred THEN n ELSE 0 END)::DOUBLE / greatest(sum(n), 1), 6) AS accuracy FROM cm""")
def top1_accuracy(spark, sf):
    return evaluation.top1_accuracy(confusion_inputs(spark, sf)[0]).withColumn("accuracy", F.round("accuracy", 6))


@query("w7_weakest", f"WITH {PRED_SQL} SELECT class_name, test_samples, round(accuracy, 6) AS accuracy FROM per ORDER BY per.accuracy, class_idx LIMIT 4")
def weakest(spark, sf):
    cm, vocab = confusion_inputs(spark, sf)
    return evaluation.weakest(evaluation.per_class_accuracy(cm, vocab), 4).select(
        "class_name", "test_samples", F.round("accuracy", 6).alias("accuracy"))


@query("m4_evaluate", f"""WITH {VECTORS_SQL}, {probs_sql('a')}, held AS ({split_sql('vecs', 'cls', 'vec_id')}),
pred AS (SELECT p.vec_id, truth AS "true", p.cls AS pred FROM p_a p JOIN held h USING (vec_id) WHERE rnk = 1 AND h.split = 'test')
SELECT a.idx AS class_idx, a.cls AS class_name, count(pred) AS test_samples, count(CASE WHEN "true" = pred THEN 1 END) AS correct,
round(coalesce(count(CASE WHEN "true" = pred THEN 1 END)::DOUBLE / nullif(count(pred), 0), 0.0), 6) AS accuracy
FROM proto_a a LEFT JOIN pred ON pred."true" = a.cls GROUP BY 1, 2""")
def evaluate(spark, sf):
    v = vectors(spark, sf)
    model = model_a(v)
    held = stratified_split(v, "cls", "vec_id").filter("split = 'test'")
    _, per, _ = evaluation.evaluate(held, model, "embedding", "cls", vocabulary_of(model, spark))
    return per.withColumn("accuracy", F.round("accuracy", 6))


@query("m1_fit_head")
def head(spark, sf):
    """Head trained on the train split; its class per item of the table."""
    v = settle(stratified_split(vectors(spark, sf), "cls", "vec_id"))
    model = fit_head(v.filter("split = 'train'"), "embedding", "cls")
    best = F.get("predictions", F.lit(0))
    return scoring.score(v, model, "embedding", k=1).select(
        "vec_id", "cls", "split", best["name"].alias("name"), F.round(best["confidence"], 2).alias("confidence"))


@query("m1_head_gradient", f"""WITH {VECTORS_SQL}, items AS (SELECT vec_id, cls, embedding::DOUBLE[] AS e, 1.0::DOUBLE / count(*) OVER (PARTITION BY cls) AS w FROM vecs),
long AS (SELECT vec_id, cls, w, unnest(range(len(e))) AS j, unnest(e) AS x FROM items),
moments AS (SELECT j, sum(w) AS total, sum(w * x) / sum(w) AS centre, sqrt(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ^ 2) AS spread FROM long GROUP BY j),
classes AS (SELECT cls AS class_name, count(*) OVER () AS k FROM (SELECT DISTINCT cls FROM items)),
sums AS (SELECT c.class_name, l.j, sum(l.w * (1.0::DOUBLE / c.k - 0.1::DOUBLE / c.k - CASE WHEN l.cls = c.class_name THEN 0.9::DOUBLE ELSE 0 END) * (l.x - m.centre) / m.spread) / any_value(m.total) AS g
  FROM long l JOIN moments m USING (j), classes c GROUP BY 1, 2),
bias AS (SELECT c.class_name, -1 AS j, sum(i.w * (0.9::DOUBLE / c.k - CASE WHEN i.cls = c.class_name THEN 0.9::DOUBLE ELSE 0 END)) / sum(i.w) AS g FROM items i, classes c GROUP BY 1)
SELECT class_name, j::INT AS feature, round(g, 6) + 0.0 AS gradient FROM (SELECT * FROM sums UNION ALL SELECT * FROM bias)""")
def head_gradient(spark, sf):
    """The first step of head training in closed form: uniform answers, smoothed targets, balanced classes, scaled features."""
    return first_gradient(vectors(spark, sf), "embedding", "cls").withColumn("gradient", F.round("gradient", 6) + F.lit(0.0))
