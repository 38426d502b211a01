"""Sources, sinks, image jobs and the stream, on data derived from the tables.

Files go to the cluster's checkpoint folder and are read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tagloom.functions import fixed
from tagloom.operators import evaluation, gate, images
from tagloom.operators.ranking import class_vocabulary
from tagloom.operators.sizing import scratch_path, settle
from tagloom.plans.curation import class_table
from tagloom.queries.models import PRED_SQL, ROUTE_SQL, confusion_inputs
from tagloom.queries.registry import query, table
from tagloom.queries.shared import ALIASES_B, MEMBERS, model_a, model_b, vectors
from tagloom.sources import readers, writers
from tagloom.streaming.scoring import stream_answer_once, stream_score


@query("snk1_vocabulary", """SELECT row_number() OVER (ORDER BY p_name) - 1 AS class_idx, p_name AS class_name
FROM (SELECT DISTINCT p_name FROM part)""")
def vocabulary(spark, sf):
    """Class names written in order and read back with their line numbers."""
    path = scratch_path(spark, "vocabulary")
    writers.write_vocab(class_vocabulary(table(spark, sf, "part"), "p_name"), path)
    return readers.read_vocab(spark, path)


@query("snk3_mapping", """SELECT c_name AS name, lower(replace(c_name, '#', '-')) || '-' || c_mktsegment AS value FROM customer""")
def mapping(spark, sf):
    path = scratch_path(spark, "mapping")
    slug = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.lit("-"), F.col("c_mktsegment"))
    writers.write_mapping(table(spark, sf, "customer").select("c_name", slug.alias("slug")), path, "c_name", "slug")
    return readers.read_mapping(spark, path)


@query("snk2_reports", f"""WITH {PRED_SQL} SELECT class_name AS "class", test_samples::VARCHAR AS test_samples,
format('{{:.4f}}', round(accuracy, 4)) AS accuracy FROM per""")
def reports(spark, sf):
    cm, vocab = confusion_inputs(spark, sf)
    cm, path = settle(cm), scratch_path(spark, "reports")
    writers.write_reports(cm, evaluation.per_class_accuracy(cm, vocab), vocab, path)
    return spark.read.option("header", True).schema("class string, test_samples string, accuracy string").csv(
        f"{path}/per_class_accuracy")


@query("snk2_wide_report", f"""WITH {PRED_SQL} SELECT a.cls AS class_name, """
       + ", ".join(f"coalesce(sum(CASE WHEN pred = 'c{i}' THEN n END), 0)::VARCHAR AS c{i}" for i in range(10))
       + ' FROM proto_a a LEFT JOIN cm ON cm."true" = a.cls GROUP BY 1')
def wide_report(spark, sf):
    """The wide matrix as written, read back by its header."""
    cm, vocab = confusion_inputs(spark, sf)
    cm, path = settle(cm), scratch_path(spark, "reports")
    writers.write_reports(cm, evaluation.per_class_accuracy(cm, vocab), vocab, path)
    back = spark.read.option("header", True).csv(f"{path}/confusion_matrix")
    return back.toDF("class_name", *back.columns[1:])


@query("src1_labelled_place", """SELECT p_name AS class_name, p_partkey || '+it''s 1.png' AS file_name,
'file:/data/a b/' || p_name || '/' || p_partkey || '+it''s 1.png' AS path FROM part""")
def labelled_place(spark, sf):
    """Label and name from origins with blanks, plus signs and quotes."""
    origin = F.concat(F.lit("file:///data/a%20b/"), F.replace(F.replace("p_name", F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")),
                      F.lit("/"), F.col("p_partkey").cast("string"), F.lit("+it%27s%201.png"))
    return table(spark, sf, "part").select(*readers.labelled_place(origin))


@query("src2_split_unreadable", "SELECT vec_id, (vec_id % 5 = 0)::INT AS unreadable FROM embeddings")
def unreadable(spark, sf):
    """Every fifth image could not be decoded."""
    failed = F.when(F.col("vec_id") % 5 == 0, F.lit(-1)).otherwise(F.col("image.height"))
    good, bad = readers.split_unreadable(tiny_images(spark, sf).withColumn("image", F.col("image").withField("height", failed)))
    return good.select("vec_id", F.lit(0).alias("unreadable")).unionByName(bad.select("vec_id", F.lit(1).alias("unreadable")))


_SHARED_PROMPTS = [("generic", t) for t in fixed.GENERIC_PROMPTS] + [("explicit", t) for t in fixed.EXPLICIT_PROMPTS]


@query("t13_prompt_rows", f"""WITH classes AS (SELECT DISTINCT 'c' || label AS class_name FROM embeddings),
shared AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}', '{t}')" for i, (k, t) in enumerate(_SHARED_PROMPTS, 1))}) t(slot, kind, prompt))
SELECT class_name, 0 AS slot, 'target' AS kind, replace('{fixed.TARGET_PROMPT}', '%s', class_name) AS prompt FROM classes
UNION ALL SELECT class_name, slot, kind, prompt FROM classes, shared""")
def prompt_table(spark, sf):
    return gate.prompt_rows(vectors(spark, sf).select("cls").distinct(), "cls")


@query("p3_class_table", """SELECT c_custkey AS dex, array_to_string(list_transform(string_split(slug, '-'), lambda x: upper(x[1]) || lower(x[2:])), '-') AS name, slug
FROM (SELECT c_custkey, replace(lower(c_name), '#', '-') || 'X' AS slug FROM customer WHERE c_custkey BETWEEN 1 AND (SELECT count(*) FROM customer))""")
def class_table_query(spark, sf):
    customer = table(spark, sf, "customer")
    api = customer.select(F.col("c_custkey").alias("id"), F.concat(
        F.replace(F.lower("c_name"), F.lit("#"), F.lit("-")), F.lit("X")).alias("name"))
    return class_table(api, customer.count())


def tiny_images(spark, sf):
    """Every vector as an 8 x 8 gray image; one byte per coordinate."""
    v = vectors(spark, sf)
    byte = F.transform("embedding", lambda x: F.lpad(F.hex(F.floor((x.cast("double") * 0.5 + 0.5) * 255)), 2, "0"))
    image = F.struct(
        F.col("file_name").alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"),
        F.lit(0).alias("mode"), F.unhex(F.array_join(byte, "")).alias("data"))
    return v.select("vec_id", "cls", "file_name", image.alias("image"))


_BYTES = "list_transform(embedding::DOUBLE[], lambda x: lpad(upper(hex(floor((x * 0.5 + 0.5) * 255)::BIGINT)), 2, '0'))"


@query("i1_crop_top", f"""SELECT vec_id, h AS height, array_to_string(b[1:h * 8], '') AS data FROM (
SELECT vec_id, {_BYTES} AS b, CASE WHEN vec_id % 4 = 1 THEN floor(8 * 0.52)::INT ELSE 8 END AS h FROM embeddings)""")
def crop_top(spark, sf):
    cut = images.crop_top(tiny_images(spark, sf), when=F.col("file_name").startswith("card_"))
    return cut.select("vec_id", F.col("image.height").alias("height"), F.hex("image.data").alias("data"))


@query("i2_phash")
def phash(spark, sf):
    return images.phash(tiny_images(spark, sf))


_WIDE_PIXEL = "({b} * (1 + i // 64 * 7) + (i // 32) * (i % 32) * 13) % 256"


@query("i2_phash_wide", f"""WITH px AS (SELECT vec_id, i // 32 AS y, i % 32 AS x, {_WIDE_PIXEL.format(b='b[i % 64 + 1]')} AS v FROM (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor((x * 0.5 + 0.5) * 255)::BIGINT) AS b FROM embeddings), (SELECT unnest(range(1024)) AS i)),
k AS (SELECT unnest(range(8)) AS k),
across AS (SELECT vec_id, y, k AS u, sum(v * cos(pi() * k * (2 * x + 1) / 64)) AS s FROM px, k GROUP BY ALL),
low AS (SELECT vec_id, k * 8 + u AS place, sum(s * cos(pi() * k * (2 * y + 1) / 64)) AS c FROM across, k GROUP BY ALL),
middle AS (SELECT vec_id, median(c) AS m FROM low GROUP BY vec_id)
SELECT vec_id, string_agg(CASE WHEN c > m THEN '1' ELSE '0' END, '' ORDER BY place) AS bits FROM low JOIN middle USING (vec_id) GROUP BY vec_id""")
def phash_wide(spark, sf):
    """Images of 32 x 32 pixels, so that nothing is resized; the pixels mix the coordinates of a vector with the place."""
    v = vectors(spark, sf)
    b = F.transform("embedding", lambda x: F.floor((x.cast("double") * 0.5 + 0.5) * 255))

    def pixel(i):
        rows, columns = F.floor(i / 32), i % 32
        value = (F.get(F.col("b"), (i % 64).cast("int")) * (1 + F.floor(i / 64) * 7) + rows * columns * 13) % 256
        return F.lpad(F.hex(value.cast("long")), 2, "0")

    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1023)), pixel), ""))
    image = F.struct(F.col("file_name").alias("origin"), F.lit(32).alias("height"), F.lit(32).alias("width"), F.lit(1).alias("nChannels"),
                     F.lit(0).alias("mode"), data.alias("data"))
    wide = v.withColumn("b", b).select("vec_id", image.alias("image"))
    return images.phash(wide).select("vec_id", F.lpad(F.conv("fingerprint", 16, 2), 64, "0").alias("bits"))


def _small_recipes(spark, sf):
    """Two recipes per vector: pencil with a radius below four, or none; the second softens."""
    v = table(spark, sf, "embeddings").select("vec_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("variant"))
    drawn = (F.col("vec_id") + F.col("variant")) % 4 > 0
    return v.select(
        "vec_id", "variant", F.when(drawn, "pencil").otherwise("none").alias("style"),
        F.when(drawn, F.lit(0.5) + ((F.col("vec_id") * 7 + F.col("variant") * 3) % 12) * F.lit(0.25)).alias("blur_radius"),
        F.when(drawn, F.lit(0.35) + (F.col("vec_id") % 9) * F.lit(0.05)).alias("alpha"),
        F.when(drawn & (F.col("variant") == 1), F.lit(0.8)).alias("post_blur"))


def _blur_sql(name: str, source: str, radius: str) -> str:
    """CTEs that smooth ``source`` (vec_id, variant, y, x, v, and columns r) by its taps along x, then y, the edge repeated."""
    taps = f"greatest(1, floor(3 * {radius} + 0.5))::BIGINT"
    weight = f"exp(-0.5 * (t / {radius}) ^ 2)"
    return f"""{name}_t AS (SELECT DISTINCT vec_id, variant, {radius} AS radius, unnest(range(-{taps}, {taps} + 1)) AS t FROM {source}),
{name}_k AS (SELECT *, {weight.replace(radius, 'radius')} / sum({weight.replace(radius, 'radius')}) OVER (PARTITION BY vec_id, variant) AS k FROM {name}_t),
{name}_x AS (SELECT k.vec_id, k.variant, s.y, o.x, sum(k.k * s.v) AS v FROM {name}_k k, (SELECT unnest(range(8)) AS x) o
  JOIN {source} s ON s.vec_id = k.vec_id AND s.variant = k.variant AND s.x = least(greatest(o.x + k.t, 0), 7) GROUP BY ALL),
{name} AS (SELECT k.vec_id, k.variant, o.y, s.x, least(greatest(round_even(sum(k.k * s.v), 0), 0), 255)::BIGINT AS v FROM {name}_k k, (SELECT unnest(range(8)) AS y) o
  JOIN {name}_x s ON s.vec_id = k.vec_id AND s.variant = k.variant AND s.y = least(greatest(o.y + k.t, 0), 7) GROUP BY ALL)"""


@query("i3_augment_recipes", f"""WITH plan AS (SELECT vec_id, variant, (vec_id + variant) % 4 > 0 AS drawn, 0.5::DOUBLE + ((vec_id * 7 + variant * 3) % 12) * 0.25::DOUBLE AS r,
  0.35::DOUBLE + (vec_id % 9) * 0.05::DOUBLE AS alpha FROM embeddings, (SELECT unnest([0, 1]) AS variant)),
px AS (SELECT vec_id, i // 8 AS y, i % 8 AS x, floor((embedding[i + 1]::DOUBLE * 0.5 + 0.5) * 255)::BIGINT AS g FROM embeddings, (SELECT unnest(range(64)) AS i)),
inverse AS (SELECT p.vec_id, p.variant, p.r, y, x, 255 - g AS v FROM px JOIN plan p USING (vec_id) WHERE drawn),
{_blur_sql('dark', 'inverse', 'r')},
pencil AS (SELECT d.vec_id, d.variant, d.y, d.x, floor(g::DOUBLE + p.alpha * ((255 - d.v)::DOUBLE - g::DOUBLE))::BIGINT AS v, 0.8::DOUBLE AS r
  FROM dark d JOIN px USING (vec_id, y, x) JOIN plan p ON p.vec_id = d.vec_id AND p.variant = d.variant),
sharp AS (SELECT * FROM pencil WHERE variant = 1),
{_blur_sql('soft', 'sharp', 'r')},
final AS (SELECT vec_id, variant, y, x, v, 'pencil' AS style FROM pencil WHERE variant = 0 UNION ALL SELECT vec_id, variant, y, x, v, 'pencil' FROM soft
  UNION ALL SELECT p.vec_id, p.variant, y, x, g, 'none' FROM px JOIN plan p USING (vec_id) WHERE NOT drawn)
SELECT vec_id, variant::INT AS variant, style, sum(v)::BIGINT AS total, sum(v * (y * 8 + x + 1))::BIGINT AS placed FROM final GROUP BY ALL""")
def augment_recipes(spark, sf):
    """A table of recipes turned into pixels; two sums over the pixels tell them apart."""
    drawn = images.augment_recipes(tiny_images(spark, sf), _small_recipes(spark, sf), "vec_id")
    hexed = F.hex("image.data")
    # of three equal channels the first
    value = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(hexed.substr(i * 6 + 1, F.lit(2)), 16, 10).cast("long"))
    weighed = F.transform("v", lambda x, i: x * (i + 1))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return drawn.withColumn("v", value).select("vec_id", "variant", "style", add(F.col("v")).alias("total"), add(weighed).alias("placed"))


@query("i3_augment")
def augment(spark, sf):
    drawn = images.augment(tiny_images(spark, sf), "vec_id", variants=2)
    return drawn.select("vec_id", "variant", "style", F.md5("image.data").alias("pixels"))


@query("st1_stream_score", f"""WITH {ROUTE_SQL} SELECT vec_id, model, name AS top_name, round(confidence, 2) AS top_confidence,
CASE WHEN round(confidence, 2) < 60 THEN 'low' ELSE 'match' END AS verdict FROM routed WHERE rnk = 1""")
def stream(spark, sf):
    """The embeddings table as a stream of files, answered once, read back."""
    v = vectors(spark, sf)
    out = scratch_path(spark, "answers")
    run = stream_score(
        spark, f"{sf}/embeddings*.parquet", table(spark, sf, "embeddings").schema, f"{out}/rows", f"{out}/log-{uuid.uuid4().hex}",
        keys=["vec_id"], features="embedding", first=model_a(v), second=model_b(v), members=MEMBERS, aliases=ALIASES_B)
    run.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("vec_id", "model", "top_name", "top_confidence", "verdict")


def _deliveries(spark, sf):
    """The embeddings in two folders of deliveries; the second repeats half of the first's items, and the first repeats some of its own."""
    rows, path = table(spark, sf, "embeddings"), scratch_path(spark, "deliveries")
    one = rows.where(F.col("vec_id") % 2 == 0)
    return path, rows.schema, one.unionByName(one.where(F.col("vec_id") % 3 == 0)), rows.where((F.col("vec_id") % 2 == 1) | (F.col("vec_id") % 4 == 0))


@query("st1_answer_once", f"""WITH {ROUTE_SQL} SELECT vec_id, model, name AS top_name, round(confidence, 2) AS top_confidence FROM routed WHERE rnk = 1""")
def answer_once(spark, sf):
    """Two deliveries that repeat items, with a restart of the query between them."""
    v = vectors(spark, sf)
    path, schema, first, second = _deliveries(spark, sf)
    out = scratch_path(spark, "answers")
    one, two = model_a(v), model_b(v)
    for delivery in (first, second):
        delivery.write.mode("append").parquet(path)
        stream_answer_once(spark, path, schema, f"{out}/rows", f"{out}/log", keys=["vec_id"], features="embedding",
                           first=one, second=two, members=MEMBERS, aliases=ALIASES_B).awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("vec_id", "model", "top_name", "top_confidence")
