"""Splits, resampling, recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import fixed
from tagloom.operators import sampling as ops
from tagloom.queries.registry import query, table
from tagloom.queries.shared import split_sql, uniform_sql


def labelled(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang", "source")


@query("s1_stratified_split", split_sql("(SELECT doc_id, lang, source FROM documents)", "source", "doc_id"))
def stratified(spark, sf):
    return ops.stratified_split(labelled(spark, sf), "source", "doc_id")


@query("j6_select_split", "SELECT doc_id, lang, source FROM ("
       + split_sql("(SELECT doc_id, lang, source FROM documents)", "source", "doc_id") + ") WHERE split = 'test'")
def select_split(spark, sf):
    return ops.select_split(ops.stratified_split(labelled(spark, sf), "source", "doc_id"), "test")


def null_split_sql(source: str, label: str, id_col: str, test: str, val: str) -> str:
    """Splits where NULL is one id: rows that stand at one place of the order share the split of the first of them."""
    return f"""SELECT {id_col}, {label}, CASE WHEN place <= {test} THEN 'test' WHEN place <= {test} + {val} THEN 'val' ELSE 'train' END AS split
FROM (SELECT {id_col}, {label}, rank() OVER (PARTITION BY {label} ORDER BY md5(concat_ws(':', '42', {id_col}::VARCHAR)), {id_col} NULLS FIRST) AS place,
             count(*) OVER (PARTITION BY {label}) AS n FROM {source})"""


_TENTH = "CASE WHEN n > {least} THEN greatest(1, round_even(n * 0.1::DOUBLE, 0))::BIGINT ELSE 0 END"


@query("s1_split_null_ids", null_split_sql(
    "(SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id END AS doc_id, source FROM documents)", "source", "doc_id",
    _TENTH.format(least=2), _TENTH.format(least=3)))
def split_null_ids(spark, sf):
    """Half of the ids are NULL."""
    half = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("doc_id")
    return ops.stratified_split(table(spark, sf, "documents").select(half, "source"), "source", "doc_id")


@query("s3_split_null_ids", """SELECT o_orderkey, CASE WHEN place <= floor(0.8::DOUBLE * n) THEN 'train' ELSE 'val' END AS split FROM (
SELECT o_orderkey, rank() OVER (ORDER BY md5(concat_ws(':', '42', o_orderkey::VARCHAR)), o_orderkey NULLS FIRST) AS place, count(*) OVER () AS n
FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS o_orderkey FROM orders))""")
def plain_split_null_ids(spark, sf):
    half = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")).alias("o_orderkey")
    return ops.random_split_exact(table(spark, sf, "orders").select(half), "o_orderkey")


def uniform_null_sql(seed: str, part: str) -> str:
    """A draw for an id that may be NULL: the seed alone is hashed then."""
    return f"(('0x' || substr(md5(concat_ws(':', '{seed}', {part}::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def resample_sql(source: str, label: str, id_col: str, seed: int = fixed.SEED) -> str:
    return f"""SELECT draw, r.{label}, r.{id_col} FROM (
  SELECT t.{id_col} AS draw, floor({uniform_sql(f'{seed}:class', f't.{id_col}')} * (SELECT count(DISTINCT {label}) FROM {source})) AS class_no,
         {uniform_sql(f'{seed}:pick', f't.{id_col}')} AS u FROM {source} t) d
JOIN (SELECT *, row_number() OVER (ORDER BY {label}) - 1 AS class_no FROM (
  SELECT {label}, count(*) AS n FROM {source} GROUP BY {label})) c ON c.class_no = d.class_no
JOIN (SELECT {label}, {id_col}, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}:row:' || {id_col}), {id_col}) - 1 AS row_no
  FROM {source}) r ON r.{label} = c.{label} AND r.row_no = floor(d.u * c.n)"""


@query("s2_balanced_resample", resample_sql("documents", "lang", "doc_id"))
def resample(spark, sf):
    return ops.balanced_resample(labelled(spark, sf), "lang", "doc_id")


@query("s2_resample_null_ids", f"""WITH items AS (SELECT lang, CASE WHEN doc_id % 3 > 0 THEN doc_id END AS doc_id FROM documents WHERE lang IS NOT NULL),
draws AS (SELECT doc_id AS draw, floor({uniform_null_sql('42:class', 'doc_id')} * (SELECT count(DISTINCT lang) FROM items)) AS class_no,
  {uniform_null_sql('42:pick', 'doc_id')} AS u FROM items),
classes AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang) - 1 AS class_no FROM items GROUP BY lang),
numbered AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws(':', '42:row', doc_id::VARCHAR)), doc_id NULLS FIRST) - 1 AS row_no FROM items)
SELECT draw, r.lang, r.doc_id FROM draws d JOIN classes c USING (class_no) JOIN numbered r ON r.lang = c.lang AND r.row_no = floor(d.u * c.n)""")
def resample_null_ids(spark, sf):
    """A third of the ids are NULL: one hash, one draw, many rows."""
    third = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")).alias("doc_id")
    return ops.balanced_resample(table(spark, sf, "documents").select("lang", third), "lang", "doc_id")


@query("s3_random_split_exact", """SELECT o_orderkey, CASE WHEN rn <= floor(0.8::DOUBLE * n) THEN 'train' ELSE 'val' END AS split FROM (
SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS rn, count(*) OVER () AS n FROM orders)""")
def plain_split(spark, sf):
    return ops.random_split_exact(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


def recipes_sql(source: str, id_col: str, variants: int, p: float, styles, seed: int = fixed.SEED) -> str:
    """Rows (id, variant, style, parameters rounded to 4)."""
    def u(field):
        return uniform_sql(f"{seed}:{field}", f"s.{id_col}", "v.variant")

    blocks = ", ".join(str(b) for b in fixed.THRESHOLD_BLOCKS)
    names = ", ".join(f"'{s}'" for s in styles)
    return f"""SELECT {id_col}, variant, style,
  CASE WHEN style = 'pencil' THEN round(8.0 + u_radius * 20.0, 4) END AS blur_radius,
  CASE WHEN style = 'pencil' THEN round(0.35::DOUBLE + u_alpha * (0.75::DOUBLE - 0.35::DOUBLE), 4) END AS alpha,
  CASE WHEN style = 'edge' THEN (40 + floor(u_lo * 61))::INT END AS lo,
  CASE WHEN style = 'edge' THEN (40 + floor(u_lo * 61) + 40 + floor(u_gap * 81))::INT END AS hi,
  CASE WHEN style = 'threshold' THEN ([{blocks}])[floor(u_block * 5)::INT + 1] END AS block,
  CASE WHEN style = 'threshold' THEN (2 + floor(u_c * 8))::INT END AS c,
  CASE WHEN style <> 'none' AND u_soften < 0.3 THEN round(0.5 + u_post, 4) END AS post_blur
FROM (SELECT s.{id_col}, v.variant, CASE WHEN {u('apply')} <= {p} THEN ([{names}])[floor({u('style')} * {len(styles)})::INT + 1] ELSE 'none' END AS style,
  {u('radius')} AS u_radius, {u('alpha')} AS u_alpha, {u('lo')} AS u_lo, {u('gap')} AS u_gap, {u('block')} AS u_block, {u('c')} AS u_c,
  {u('soften')} AS u_soften, {u('post')} AS u_post
  FROM {source} s, (SELECT unnest(range({variants}))::INT AS variant) v)"""


def rounded_recipes(df):
    for c in ("blur_radius", "alpha", "post_blur"):
        df = df.withColumn(c, F.round(c, 4))
    return df


@query("s4_draw_recipes", recipes_sql("documents", "doc_id", 3, 0.9, fixed.SKETCH_STYLES))
def recipes(spark, sf):
    return rounded_recipes(ops.draw_recipes(labelled(spark, sf), "doc_id", variants=3))


@query("s5_preview", """SELECT doc_id, lang, (k // 32)::INT AS batch FROM (SELECT doc_id, lang,
row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS k FROM documents) WHERE k % 32 = 0 AND k <= 128""")
def preview(spark, sf):
    return ops.preview(labelled(spark, sf).select("doc_id", "lang"), "doc_id")
