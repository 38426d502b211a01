"""Vector and probability functions on the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import fixed, vectors as fn
from tagloom.operators.gate import relevance_gate
from tagloom.queries.registry import query, table
from tagloom.queries.shared import NAME_SQL, UNIT, VECTORS_SQL, first_vectors, last_vectors, probs_sql, vectors


def _long(df, value: str, digits: int = 4):
    """(vec_id, pos, value) with the value rounded."""
    return df.select("vec_id", F.posexplode_outer(value).alias("pos", "x")).select(
        "vec_id", "pos", F.round("x", digits).alias("value"))


def _long_sql(array: str, digits: int = 4, source: str = "embeddings") -> str:
    return f"""SELECT vec_id, (pos - 1)::INT AS pos, round(a[pos], {digits}) AS value FROM (
  SELECT vec_id, a, unnest(range(1, len(a) + 1)) AS pos FROM (SELECT vec_id, {array} AS a FROM {source}))"""


@query("v1_l2_normalise", _long_sql(UNIT.format(v="embedding")))
def l2_normalise(spark, sf):
    v = table(spark, sf, "embeddings")
    return _long(v.select("vec_id", fn.l2_normalise(F.col("embedding")).alias("a")), "a")


@query("v2_softmax", _long_sql("list_transform(e, lambda x: x / list_sum(e))", 6, """(SELECT vec_id,
  list_transform(embedding::DOUBLE[], lambda x: exp((x - list_max(embedding::DOUBLE[])) * 5.0)) AS e FROM embeddings)"""))
def softmax(spark, sf):
    v = table(spark, sf, "embeddings")
    return _long(v.select("vec_id", fn.softmax(F.col("embedding"), 5.0).alias("a")), "a", 6)


@query("v2_similarity", f"""WITH {VECTORS_SQL}, {probs_sql('a')}
SELECT vec_id, cls, round(p, 4) AS p FROM p_a""")
def similarity(spark, sf):
    v = vectors(spark, sf)
    protos = first_vectors(v).orderBy("cls").collect()
    p = fn.matrix_softmax(F.col("embedding"), [r["vec"] for r in protos], scale=fixed.SIMILARITY_SCALE, unit=True)
    names = F.array(*[F.lit(r["cls"]) for r in protos])
    return v.select("vec_id", F.posexplode_outer(p).alias("i", "p")).select(
        "vec_id", F.get(names, F.col("i")).alias("cls"), F.round("p", 4).alias("p"))


def prompts(v):
    """Targets: first vector of each class. Distractors: last vectors of the first
    eight classes, the last three of them in the explicit part."""
    targets = first_vectors(v).select(
        F.col("cls").alias("class_name"), F.lit(0).alias("slot"), F.lit("target").alias("kind"), "vec")
    slot = F.substring("cls", 2, 2).cast("int") + 1
    shared = last_vectors(v).filter(slot <= 8).select(
        F.lit(None).cast("string").alias("class_name"), slot.alias("slot"),
        F.when(slot <= 5, "generic").otherwise("explicit").alias("kind"), "vec")
    return targets.unionByName(shared)


GATE_SQL = f"""{VECTORS_SQL},
slots AS (SELECT v.vec_id, v.cls, v.file_name, s.slot, 100.0 * list_dot_product(v.u, s.w) AS z FROM vecs v,
  (SELECT NULL AS cls, label + 1 AS slot, arg_max(u, vec_id) AS w FROM vecs WHERE label <= 7 GROUP BY label) s
  UNION ALL SELECT v.vec_id, v.cls, v.file_name, 0, 100.0 * list_dot_product(v.u, a.w) FROM vecs v JOIN proto_a a USING (cls)),
ps AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, slot) AS rnk
  FROM (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM slots)),
gate AS (SELECT vec_id, cls, file_name, max(CASE WHEN slot = 0 THEN p END) AS p_target, sum(CASE WHEN slot >= 6 THEN p END) AS p_explicit,
  max(CASE WHEN rnk = 1 THEN slot END) AS best FROM ps GROUP BY ALL),
gated AS (SELECT vec_id, cls, file_name, CASE WHEN NOT seed THEN round(p_target, 4) END AS p_target, CASE WHEN NOT seed THEN round(p_explicit, 4) END AS p_explicit,
  CASE WHEN seed THEN 'trusted' WHEN p_explicit > 0.15 THEN 'explicit'
       WHEN p_target < 0.22 OR best <> 0 THEN 'off_topic' ELSE 'keep' END AS decision
  FROM (SELECT *, starts_with(file_name, 'seed_') AS seed FROM gate))"""


@query("v3_relevance_gate", f"WITH {GATE_SQL} SELECT vec_id, cls, p_target, p_explicit, decision FROM gated")
def gate(spark, sf):
    v = vectors(spark, sf)
    out = relevance_gate(v, prompts(v), "cls", "embedding", "file_name")
    return out.select(
        "vec_id", "cls", F.round("p_target", 4).alias("p_target"), F.round("p_explicit", 4).alias("p_explicit"), "decision")


@query("v3_gate_blocked", f"WITH {GATE_SQL} SELECT vec_id, cls, p_target, p_explicit, decision FROM gated")
def gate_blocked(spark, sf):
    """The same gate with the distractors met two at a time."""
    v = vectors(spark, sf)
    out = relevance_gate(v, prompts(v), "cls", "embedding", "file_name", block_bytes=2 * 64 * 8)
    return out.select(
        "vec_id", "cls", F.round("p_target", 4).alias("p_target"), F.round("p_explicit", 4).alias("p_explicit"), "decision")


@query("j5_prototype_match", f"WITH {GATE_SQL} SELECT vec_id, slot, round(p, 4) AS p FROM ps")
def prototype_match(spark, sf):
    from tagloom.operators.gate import shared_vectors
    from tagloom.operators.sizing import lookup_join

    v = vectors(spark, sf)
    rows = prompts(v)
    shared, _ = shared_vectors(rows)
    own = rows.filter("kind = 'target'").select(F.col("class_name").alias("cls"), F.col("vec").alias("own"))
    joined = lookup_join(v.select("vec_id", "cls", "embedding"), own, ["cls"])
    p = fn.gate_softmax(F.col("embedding"), F.col("own"), shared)
    return joined.select("vec_id", F.posexplode_outer(p).alias("slot", "p")).withColumn("p", F.round("p", 4))


@query("v4_argmax", """SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings""")
def argmax(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", fn.argmax(F.col("embedding")).alias("best"))


_CE = """list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z)))))"""


@query("v5_smoothed_cross_entropy", f"""SELECT vec_id, round(0.9 * (norm - z[label + 1]) + 0.1 * (norm - list_sum(z) / len(z)), 6) AS smoothed,
round(norm - z[label + 1], 6) AS plain FROM (SELECT *, {_CE} AS norm FROM (SELECT vec_id, label, embedding::DOUBLE[] AS z FROM embeddings))""")
def smoothed_cross_entropy(spark, sf):
    z, y = F.col("embedding"), F.col("label")
    return table(spark, sf, "embeddings").select(
        "vec_id", F.round(fn.smoothed_cross_entropy(z, y), 6).alias("smoothed"),
        F.round(fn.smoothed_cross_entropy(z, y, 0.0), 6).alias("plain"))


_NORM = "(a[pos] / 255.0 - ([0.485, 0.456, 0.406]::DOUBLE[])[(pos - 1) % 3 + 1]) / ([0.229, 0.224, 0.225]::DOUBLE[])[(pos - 1) % 3 + 1]"


@query("v6_channel_normalise", f"""SELECT vec_id, (pos - 1)::INT AS pos, round({_NORM}, 6) AS value, round(a[pos] * 0.5 + 0.5, 6) AS restored
FROM (SELECT vec_id, a, unnest(range(1, len(a) + 1)) AS pos FROM (SELECT vec_id, embedding::DOUBLE[] AS a FROM embeddings))""")
def channel_normalise(spark, sf):
    e = F.col("embedding")
    both = F.arrays_zip(fn.channel_normalise(e).alias("n"), fn.channel_restore(e).alias("r"))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode_outer(both).alias("pos", "b")).select(
        "vec_id", "pos", F.round("b.n", 6).alias("value"), F.round("b.r", 6).alias("restored"))


@query("v7_median_bits", """SELECT vec_id, list_aggregate(list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x > m THEN '1' ELSE '0' END), 'string_agg', '') AS bits
FROM (SELECT vec_id, embedding, (list_sort(embedding::DOUBLE[])[32] + list_sort(embedding::DOUBLE[])[33]) / 2 AS m FROM embeddings)""")
def median_bits(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", fn.median_bits(F.col("embedding")).alias("bits"))
