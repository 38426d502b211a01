"""Inputs that several queries derive from the tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagloom.functions import fixed
from tagloom.functions.text import text_fingerprint
from tagloom.operators.scoring import PrototypeScorer, prototype_scorer
from tagloom.operators.sizing import settle
from tagloom.queries.registry import table

# A file name with a provenance prefix, from a row's id.
NAME_SQL = "(['seed_','card_','ddg_',''])[({id} % 4 + 1)::int] || lpad({id}::varchar, 9, '0') || '.png'"
FINGERPRINT_SQL = r"md5(lower(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'))))"


def item_name(id_col: str) -> Column:
    prefixes = F.array(F.lit("seed_"), F.lit("card_"), F.lit("ddg_"), F.lit(""))
    return F.concat(
        F.get(prefixes, (F.col(id_col) % 4).cast("int")), F.lpad(F.col(id_col).cast("string"), 9, "0"), F.lit(".png"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as labelled items with a provenance key and a fingerprint."""
    return table(spark, sf, "documents").filter("text IS NOT NULL").select(
        "doc_id", "lang", "source", item_name("doc_id").alias("file_name"), text_fingerprint(F.col("text")).alias("fp"))


DOCUMENTS_SQL = f"""docs AS (
  SELECT doc_id, lang, source, {NAME_SQL.format(id='doc_id')} AS file_name, {FINGERPRINT_SQL} AS fp FROM documents WHERE text IS NOT NULL)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.concat(F.lit("c"), F.col("label").cast("string")).alias("cls"), "label", "embedding",
        item_name("vec_id").alias("file_name"))


# Prototypes: the first vector of each class (model A) or the last (model B).
def first_vectors(v: DataFrame) -> DataFrame:
    return settle(v.groupBy("cls").agg(F.min_by("embedding", "vec_id").alias("vec")))


def last_vectors(v: DataFrame) -> DataFrame:
    return settle(v.groupBy("cls").agg(F.max_by("embedding", "vec_id").alias("vec")))


def model_a(v: DataFrame) -> PrototypeScorer:
    return prototype_scorer(first_vectors(v), "cls", "vec")


def model_b(v: DataFrame) -> PrototypeScorer:
    """Knows the first seven classes only, one of them under an alias."""
    known = last_vectors(v).filter("cls <= 'c6'").withColumn(
        "cls", F.when(F.col("cls") == "c3", "c3_old").otherwise(F.col("cls")))
    return prototype_scorer(known, "cls", "vec")


ALIASES_B = {"c3_old": "c3"}
MEMBERS = ["c0", "c1", "c2", "c3", "c4"]

UNIT = "list_transform({v}::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform({v}::DOUBLE[], lambda y: y * y))))"
VECTORS_SQL = f"""vecs AS (
  SELECT vec_id, 'c' || label AS cls, label, embedding, {NAME_SQL.format(id='vec_id')} AS file_name,
         {UNIT.format(v='embedding')} AS u FROM embeddings),
proto_a AS (SELECT cls, arg_min(u, vec_id) AS w, row_number() OVER (ORDER BY cls) - 1 AS idx FROM vecs GROUP BY cls),
proto_b AS (SELECT CASE WHEN cls = 'c3' THEN 'c3_old' ELSE cls END AS cls, w, row_number() OVER (ORDER BY cls) - 1 AS idx FROM (
  SELECT cls, arg_max(u, vec_id) AS w FROM vecs WHERE cls <= 'c6' GROUP BY cls))"""


def probs_sql(model: str) -> str:
    """CTE ``p_<model>``: (vec_id, idx, cls, p) in long form."""
    return f"""z_{model} AS (
  SELECT v.vec_id, v.cls AS truth, m.idx, m.cls, {fixed.SIMILARITY_SCALE} * list_dot_product(v.u, m.w) AS z FROM vecs v, proto_{model} m),
e_{model} AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z_{model}),
p_{model} AS (SELECT vec_id, truth, idx, cls, e / sum(e) OVER (PARTITION BY vec_id) AS p,
  row_number() OVER (PARTITION BY vec_id ORDER BY e DESC, idx) AS rnk FROM e_{model})"""


def vocabulary_of(scorer: PrototypeScorer, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(scorer.names)), "class_idx bigint, class_name string")


def split_sql(source: str, label: str, id_col: str, seed: int = fixed.SEED) -> str:
    """Subquery text: rows of ``source`` with ``split``."""
    return f"""SELECT * EXCLUDE (rn, n, nt, nv), CASE WHEN rn <= nt THEN 'test' WHEN rn <= nt + nv THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, CASE WHEN n > 2 THEN greatest(1, round_even(n * 0.1::DOUBLE, 0))::BIGINT ELSE 0 END AS nt,
             CASE WHEN n > 3 THEN greatest(1, round_even(n * 0.1::DOUBLE, 0))::BIGINT ELSE 0 END AS nv
  FROM (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}:' || {id_col}), {id_col}) AS rn,
               count(*) OVER (PARTITION BY {label}) AS n FROM {source}))"""


def uniform_sql(seed: str, *parts: str) -> str:
    body = " || ':' || ".join(f"({p})::varchar" for p in parts)
    return f"(('0x' || substr(md5('{seed}:' || {body}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
