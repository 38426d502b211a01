"""Composite jobs: curation, train preparation, catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import fixed
from tagloom.functions.vectors import median_bits
from tagloom.operators.images import augment_recipes
from tagloom.operators.ranking import dedup_first
from tagloom.operators.sampling import stratified_split
from tagloom.operators.sizing import scratch_path, settle
from tagloom.plans.curation import catalogue_items, curate
from tagloom.plans.training import prepare, second_phase
from tagloom.queries.files import tiny_images
from tagloom.queries.ordering import ORDER_PAGES_SQL, order_pages
from tagloom.queries.registry import query, table
from tagloom.queries.sampling import recipes_sql, resample_sql, rounded_recipes
from tagloom.queries.shared import DOCUMENTS_SQL, documents, split_sql, vectors
from tagloom.queries.vectors import GATE_SQL, prompts
from tagloom.sources.writers import write_manifest

_UNIQUE_SQL = f"""{DOCUMENTS_SQL}, uniq AS (SELECT * EXCLUDE (k) FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, fp ORDER BY file_name) AS k FROM docs) WHERE k = 1)"""


@query("curate_split", f"""WITH {_UNIQUE_SQL}
SELECT source, split, count(*) AS items, count(CASE WHEN starts_with(file_name, 'seed_') THEN 1 END) AS seeds
FROM ({split_sql('uniq', 'source', 'doc_id')}) GROUP BY ALL""")
def curate_split(spark, sf):
    """Duplicate drop per language, stratified split per source, counts."""
    unique = settle(dedup_first(documents(spark, sf), ["lang"], "fp", "file_name").select("doc_id", "source", "file_name"))
    return stratified_split(unique, "source", "doc_id").groupBy("source", "split").agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("file_name").startswith("seed_")).alias("seeds"))


def _curated(spark, sf):
    v = vectors(spark, sf).withColumn("fingerprint", median_bits(F.col("embedding")))
    cards = v.filter(F.col("file_name").startswith("card_"))
    others = v.filter(~F.col("file_name").startswith("card_"))
    # the same items come twice: copies under a later name, as a second crawl would bring them
    copies = others.withColumn("file_name", F.concat(F.lit("z_"), "file_name"))
    return curate([cards, others, copies], prompts(v), "cls", "file_name", "fingerprint", "embedding")


_CURATED_SQL = f"""{GATE_SQL}, twice AS (SELECT cls, count(*) + count(CASE WHEN NOT starts_with(file_name, 'card_') THEN 1 END) AS before,
  count(*) AS uniq, count(CASE WHEN decision IN ('trusted', 'keep') THEN 1 END) AS kept, count(CASE WHEN decision = 'explicit' THEN 1 END) AS flagged
  FROM gated GROUP BY ROLLUP (cls))"""


@query("p1_curate", f"WITH {GATE_SQL} SELECT vec_id, cls, file_name, p_target, p_explicit, decision FROM gated")
def curated_manifest(spark, sf):
    return _curated(spark, sf).manifest.select(
        "vec_id", "cls", "file_name", F.round("p_target", 4).alias("p_target"),
        F.round("p_explicit", 4).alias("p_explicit"), "decision")


@query("p1_curate_report", f"""WITH {_CURATED_SQL} SELECT cls, (cls IS NULL)::INT AS is_total, before, before - uniq AS duplicates,
kept, uniq - kept AS gated, flagged FROM twice""")
def curated_report(spark, sf):
    return _curated(spark, sf).report


_TRAIN_SQL = f"tr AS (SELECT * FROM ({split_sql('(SELECT doc_id, lang, source FROM documents)', 'lang', 'doc_id')}) WHERE split = 'train')"


@query("p2_prepare", f"""WITH {_TRAIN_SQL} SELECT draw, lang, doc_id, 1.0::DOUBLE / (SELECT count(*) FROM tr t WHERE t.lang = d.lang) AS weight
FROM ({resample_sql('tr', 'lang', 'doc_id')}) d""")
def prepared(spark, sf):
    out = prepare(table(spark, sf, "documents").select("doc_id", "lang", "source"), "lang", "doc_id")
    return out.weighted_draws().select("draw", "lang", "doc_id", "weight")


@query("p2_prepare_counts", f"""WITH {_TRAIN_SQL} SELECT row_number() OVER (ORDER BY lang) - 1 AS class_idx, lang AS class_name, count(*) AS n
FROM tr GROUP BY lang""")
def prepared_counts(spark, sf):
    return prepare(table(spark, sf, "documents").select("doc_id", "lang", "source"), "lang", "doc_id").train_counts


_SPLIT_SQL = f"sp AS ({split_sql('(SELECT doc_id, lang FROM documents)', 'lang', 'doc_id')})"


@query("p4_second_phase", f"""WITH {_SPLIT_SQL}, held AS (SELECT * FROM sp WHERE split <> 'train'), tr AS (SELECT * FROM sp WHERE split = 'train')
SELECT *, 'train' AS phase_split FROM ({recipes_sql('tr', 'doc_id', 2, 0.9, fixed.SKETCH_STYLES)})
UNION ALL SELECT *, 'held_out' FROM ({recipes_sql('held', 'doc_id', 1, 1.0, ('pencil',))})""")
def phase_two(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return rounded_recipes(second_phase(settle(stratified_split(docs, "lang", "doc_id")), "doc_id", variants=2))


_VEC_SPLIT_SQL = f"sp AS ({split_sql('(SELECT vec_id, label FROM embeddings)', 'label', 'vec_id')})"


@query("p4_drawn", f"""WITH {_VEC_SPLIT_SQL}, held AS (SELECT * FROM sp WHERE split <> 'train'), tr AS (SELECT * FROM sp WHERE split = 'train'),
recipes AS (SELECT * FROM ({recipes_sql('tr', 'vec_id', 2, 0.9, fixed.SKETCH_STYLES)}) UNION ALL SELECT * FROM ({recipes_sql('held', 'vec_id', 1, 1.0, ('pencil',))}))
SELECT vec_id, variant, CASE WHEN style = 'none' THEN 'none' ELSE 'pencil' END AS style, style <> 'none' AS changed, 192 AS bytes FROM recipes""")
def phase_two_drawn(spark, sf):
    """The second phase's recipes turned into pixels: every recipe gives an image, and all but the plain copies differ from theirs."""
    items = settle(stratified_split(table(spark, sf, "embeddings").select("vec_id", "label"), "label", "vec_id"))
    pictures = tiny_images(spark, sf).withColumn("before", F.col("image.data"))
    drawn = augment_recipes(pictures, second_phase(items, "vec_id", variants=2), "vec_id")
    once = F.unhex(F.regexp_replace(F.hex("before"), "(..)", "$1$1$1"))
    return drawn.select("vec_id", "variant", "style", (F.col("image.data") != once).alias("changed"), F.octet_length("image.data").alias("bytes"))


@query("p5_catalogue_items", f"""WITH {ORDER_PAGES_SQL}, wanted AS (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'),
capped AS (SELECT *, 'card_' || o_orderkey || '.png' AS file_name, row_number() OVER (PARTITION BY o_custkey ORDER BY page, pos) AS rn
  FROM paged, scan WHERE page <= reached AND o_orderpriority <> '' AND o_custkey IN (SELECT c_custkey FROM wanted))
SELECT page, pos, o_custkey AS dex, id, file_name FROM (SELECT *, o_orderkey::VARCHAR AS id FROM capped) c
WHERE rn <= 4 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = c.o_orderkey AND l_linenumber = 1)""")
def catalogue(spark, sf):
    pages = order_pages(spark, sf).withColumn("data", F.transform("data", lambda o: F.struct(
        o["o_orderkey"].cast("string").alias("id"), o["o_orderpriority"].alias("setCode"), o["o_custkey"].alias("dex"))))
    wanted = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("dex"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey").hint("merge")  # grows with the stored files: never broadcast
    stored = (
        table(spark, sf, "lineitem").filter("l_linenumber = 1").select("l_orderkey").distinct()
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("dex"), F.concat(F.lit("card_"), "o_orderkey", F.lit(".png")).alias("file_name")))
    items, _ = catalogue_items(pages, wanted, stored, "dex", supertype=None, cap=4)
    return items.select(F.col("page"), F.col("pos").cast("bigint").alias("pos"), "dex", "id", "file_name")


@query("snk4_write_manifest", f"WITH {_UNIQUE_SQL} SELECT doc_id, source, file_name, split FROM ({split_sql('uniq', 'source', 'doc_id')})")
def manifest(spark, sf):
    """Written under the checkpoint folder, partitioned by split, and read back."""
    unique = settle(dedup_first(documents(spark, sf), ["lang"], "fp", "file_name").select("doc_id", "source", "file_name"))
    path = scratch_path(spark, "manifest")
    write_manifest(stratified_split(unique, "source", "doc_id"), path, "split")
    return spark.read.parquet(path)


@query("src5_publish", f"""WITH {ORDER_PAGES_SQL} SELECT page, pos, o_orderkey, 1::BIGINT AS version FROM paged WHERE page % 7 <> 0 OR page <= 7""")
def publish_pages(spark, sf):
    """Three deliveries of a catalogue: a whole one is published, one with a gap is not, a run that dies while it writes leaves no record.
    The whole one holds the pages that are no multiple of seven, from the eighth on, renumbered so that none is missing."""
    from tagloom.operators.catalogue import ingest_pages
    from tagloom.sources.published import commits, publish, read_published

    pages = order_pages(spark, sf).where("page % 7 <> 0 OR page <= 7")
    dense = F.col("page") - F.greatest(F.lit(0), F.floor(F.col("page") / 7).cast("int") - 1)
    whole = pages.select("page", dense.cast("int").alias("nr"), "data")
    last = whole.agg(F.max("nr")).scalar()
    whole = settle(whole.select(F.col("nr").alias("page"), "data", last.alias("last_page"), F.col("page").alias("old")))
    root = scratch_path(spark, "catalogue")
    for delivery in (whole, whole.where("page <> 3")):
        rows, status = ingest_pages(delivery.select("page", "data", "last_page"))
        publish(rows, root, complete=bool(status.first()["is_complete"]))
    broken = whole.select(F.when(F.col("page") == 2, F.raise_error(F.lit("delivery broke off"))).otherwise(F.col("page")).alias("page"))
    try:
        publish(broken, root)
    except Exception:  # the run dies, as meant
        pass
    numbers = whole.select(F.col("page").alias("nr"), "old")
    version = commits(spark, root).agg(F.max("version")).scalar()
    return read_published(spark, root).join(numbers, F.col("page") == F.col("nr")).select(
        F.col("old").alias("page"), F.col("pos").cast("bigint").alias("pos"), "o_orderkey", version.alias("version"))


@query("p1_deliveries", f"""WITH {_UNIQUE_SQL} SELECT lang, file_name, doc_id, fp, CASE WHEN file_name < 'd' THEN 1 ELSE 2 END AS delivery FROM uniq""")
def two_deliveries(spark, sf):
    """Documents that come in two deliveries, by file name: what both add is what one curation keeps."""
    import uuid

    from tagloom.plans.deliveries import FingerprintStore, curate_delivery

    store = FingerprintStore(spark, f"tagloom_seen_{uuid.uuid4().hex}", "lang", "fp", buckets=8)
    docs = documents(spark, sf).select("lang", "file_name", "doc_id", "fp")
    early = F.col("file_name") < "d"
    parts = [curate_delivery(store, docs.where(early), "file_name").withColumn("delivery", F.lit(1)),
             curate_delivery(store, docs.where(~early), "file_name").withColumn("delivery", F.lit(2))]
    return parts[0].unionByName(parts[1])
