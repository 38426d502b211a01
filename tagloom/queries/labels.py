"""Label, name and URL queries; lookups, counts and quotas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.functions import fixed, text
from tagloom.operators import evaluation, labels as ops
from tagloom.operators.catalogue import bucket_catalogue, harvest_urls, pending
from tagloom.operators.ranking import class_vocabulary
from tagloom.operators.sizing import scratch_path, settle
from tagloom.queries.registry import query, table
from tagloom.queries.shared import DOCUMENTS_SQL, NAME_SQL, documents


@query("t1_scope_classes", """SELECT p_partkey AS id, p_name AS name FROM part
WHERE p_partkey BETWEEN 1 AND (SELECT count(*) FROM part) AND lower(p_name) IN ('small ring', 'red widget', 'blue bolt')""")
def scope_classes(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return ops.scope_classes(part, "id", "name", only=["Small Ring", "RED WIDGET", "blue bolt"])


_SLUG = "lower(replace(p_type || ' ' || p_name, ' ', '-'))"


@query("t2_display_name", f"""SELECT p_partkey, CASE WHEN slug = 'promo-red-widget' THEN 'Mr. Widget' ELSE
array_to_string(list_transform(string_split(slug, '-'), lambda x: upper(x[1]) || lower(x[2:])), '-') END AS name
FROM (SELECT p_partkey, {_SLUG} AS slug FROM part)""")
def display_name(spark, sf):
    slug = F.lower(F.replace(F.concat_ws(" ", "p_type", "p_name"), F.lit(" "), F.lit("-")))
    special = {**fixed.DISPLAY_SPECIAL, "promo-red-widget": "Mr. Widget"}
    return table(spark, sf, "part").select("p_partkey", text.display_name(slug, special).alias("name"))


@query("t3_api_slug", r"""SELECT p_partkey, CASE WHEN key = 'promo. red widget''s' THEN 'promo-widget' ELSE
regexp_replace(regexp_replace(key, '[.'']', '', 'g'), '[ \t\r\n\f]+', '-', 'g') END AS slug
FROM (SELECT p_partkey, lower(p_type || '. ' || p_name || '''s') AS key FROM part)""")
def api_slug(spark, sf):
    name = F.concat(F.col("p_type"), F.lit(". "), F.col("p_name"), F.lit("'s"))
    overrides = {**fixed.SLUG_OVERRIDES, "promo. red widget's": "promo-widget"}
    return table(spark, sf, "part").select("p_partkey", text.api_slug(name, overrides).alias("slug"))


@query("t4_canonicalise", """SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'Brand#10' WHEN 'Brand#2' THEN 'Brand#10'
WHEN 'Brand#3' THEN 'Brand Three' ELSE p_brand END AS brand FROM part""")
def canonicalise(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    return ops.canonicalise(part, "brand", {"Brand#1": "Brand#10", "Brand#2": "Brand#10", "Brand#3": "Brand Three"})


@query("t5_harvest_urls", """SELECT page_id, pos, url || tail AS url FROM pages,
(VALUES (0::BIGINT, '.png'), (1::BIGINT, '/dream.png')) t(pos, tail)
UNION ALL SELECT page_id, 2::BIGINT, split_part(url, '?', 1) || '/low.png' FROM pages""")
def harvest(spark, sf):
    u, bare = F.col("url"), F.substring_index("url", "?", 1)
    doc = F.concat(
        F.lit('{"z_front":"'), u, F.lit('.png","back":null,"versions":{"v1":{"front":"'), u,
        F.lit('/old.png"}},"other":{"home":{"front":"'), u, F.lit('.png","big":"'), u,
        F.lit('.PNG"},"dream":{"b":"'), u, F.lit('/dream.png","a":"'), u, F.lit('.svg","list":["'), u,
        F.lit('/list.png"]},"versions":{"x":"'), u, F.lit('/v.png"}},"ftp":"ftp://host/x.png","low":"'), bare,
        F.lit('/low.png"}'))
    out = harvest_urls(table(spark, sf, "pages").select("page_id", doc.alias("doc")), "page_id", "doc")
    return out.withColumn("pos", F.col("pos").cast("bigint"))


_TERMS = (*fixed.BLOCKED_HOST_TERMS, "spam-farm", "cheap-pills", "free-bets")


@query("t5_harvest_deep", """SELECT page_id, 0::BIGINT AS pos, url || '.png' AS url FROM pages WHERE page_id % 50 <> 0""")
def harvest_deep(spark, sf):
    """Documents that are nested too deeply to read give no URLs and do no harm."""
    deep = F.concat(F.repeat(F.lit("["), F.lit(200_000)), F.lit('"'), F.col("url"), F.lit('.png"'), F.repeat(F.lit("]"), F.lit(200_000)))
    doc = F.when(F.col("page_id") % 50 == 0, deep).otherwise(F.concat(F.lit('{"front":"'), F.col("url"), F.lit('.png"}')))
    out = harvest_urls(table(spark, sf, "pages").select("page_id", doc.alias("doc")), "page_id", "doc")
    return out.withColumn("pos", F.col("pos").cast("bigint"))


@query("t6_drop_blocked_odd", f"""SELECT page_id, url FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'http://[{_TERMS[0]}/' || page_id
WHEN 1 THEN 'http://me@X.{_TERMS[0].upper()}:80/' || page_id ELSE url END AS url FROM pages)
WHERE url IS NOT NULL AND url <> '' AND (url LIKE 'http://[%' OR NOT regexp_matches(
lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '{"|".join(_TERMS)}'))""")
def drop_blocked_odd(spark, sf):
    """A blocked name in an authority that cannot be parsed blocks nothing; user, case and port hide nothing."""
    number, kind = F.col("page_id").cast("string"), F.col("page_id") % 3
    url = (F.when(kind == 0, F.concat(F.lit(f"http://[{_TERMS[0]}/"), number))
           .when(kind == 1, F.concat(F.lit(f"http://me@X.{_TERMS[0].upper()}:80/"), number)).otherwise(F.col("url")))
    return ops.drop_blocked(table(spark, sf, "pages").select("page_id", url.alias("url")), "url", _TERMS)


@query("t6_drop_blocked", f"""SELECT page_id, url FROM pages WHERE url IS NOT NULL AND url <> '' AND NOT regexp_matches(
lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '{"|".join(_TERMS)}')""")
def drop_blocked(spark, sf):
    return ops.drop_blocked(table(spark, sf, "pages").select("page_id", "url"), "url", _TERMS)


_EXT_SQL = r"""CASE WHEN lower(regexp_extract(split_part(url, '?', 1), '[^/.][^/]*([.][^/.]*)$', 1)) IN
('.jpg', '.jpeg', '.png', '.webp', '.bmp', '.html') THEN lower(regexp_extract(split_part(url, '?', 1), '[^/.][^/]*([.][^/.]*)$', 1))
ELSE '.jpg' END"""


@query("t7_url_extension", f"SELECT page_id, {_EXT_SQL} AS ext FROM pages")
def url_extension(spark, sf):
    allowed = (*fixed.IMAGE_EXTENSIONS, ".html")
    return table(spark, sf, "pages").select("page_id", text.url_extension(F.col("url"), allowed).alias("ext"))


@query("t8_first_nonempty", """SELECT doc_id, coalesce(nullif(regexp_extract(text, '([0-9]{4,})', 1), ''),
nullif(CASE WHEN lang <> 'en' THEN source END, ''), '') AS value FROM documents""")
def first_nonempty(spark, sf):
    number = F.regexp_extract("text", "([0-9]{4,})", 1)
    other = F.when(F.col("lang") != "en", F.col("source"))
    return table(spark, sf, "documents").select("doc_id", text.first_nonempty(number, other).alias("value"))


_PROV_SQL = """CASE WHEN starts_with(file_name, 'seed_') THEN 'seed' WHEN starts_with(file_name, 'card_') THEN 'card'
WHEN starts_with(file_name, 'ddg_') THEN 'ddg' ELSE 'crawler' END"""


@query("t9_provenance", f"WITH {DOCUMENTS_SQL} SELECT doc_id, {_PROV_SQL} AS provenance FROM docs")
def provenance(spark, sf):
    return documents(spark, sf).select("doc_id", text.provenance(F.col("file_name")).alias("provenance"))


@query("t10_purge", f"WITH {DOCUMENTS_SQL} SELECT doc_id, file_name FROM docs WHERE {_PROV_SQL} IN ('seed', 'card')")
def purge(spark, sf):
    return ops.purge(documents(spark, sf).select("doc_id", "file_name"), "file_name")


@query("t13_expand_templates", "SELECT s_suppkey, engine, slot, replace(template, '%s', s_name) AS query FROM supplier, "
       "(VALUES ('bing'), ('ddg')) e(engine), (VALUES "
       + ", ".join(f"({i}, '{t}')" for i, t in enumerate(fixed.SEARCH_TEMPLATES)) + ") t(slot, template)")
def expand_templates(spark, sf):
    return ops.expand_templates(table(spark, sf, "supplier"), "s_name").select("s_suppkey", "engine", "slot", "query")


@query("t14_item_key", f"""SELECT page_id, md5(url) AS key, 'seed_' || CASE WHEN page_id < 10 THEN '0' ELSE '' END || page_id || '.png' AS seed,
'ddg_' || CASE WHEN page_id < 100000 THEN lpad(page_id::varchar, 5, '0') ELSE page_id::varchar END || {_EXT_SQL.replace(", '.html'", "")} AS ddg,
'card_' || page_id || '.png' AS card FROM pages""")
def item_key(spark, sf):
    n, url = F.col("page_id"), F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", text.url_key(url).alias("key"), text.item_file_name("seed", n).alias("seed"),
        text.item_file_name("ddg", n, text.url_extension(url)).alias("ddg"), text.item_file_name("card", n).alias("card"))


@query("j1_bucket_catalogue", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_returnflag = 'A' AND l_linestatus <> '' AND l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO')""")
def bucket(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    wanted = table(spark, sf, "part").filter("p_type = 'PROMO'").select(F.col("p_partkey").alias("l_partkey"))
    out = bucket_catalogue(rows, wanted, "l_partkey", "A", "l_orderkey", "l_linestatus", "l_returnflag")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("j2_lookup_default", """SELECT c_custkey, coalesce(s_name, lower(c_name)) AS name
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def lookup_default(spark, sf):
    names = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"))
    out = ops.lookup_default(
        table(spark, sf, "customer").select("c_custkey", "c_name"), names, ["c_custkey"], "name", F.lower("c_name"))
    return out.select("c_custkey", "name")


@query("j3_pending", """SELECT o_orderkey, o_totalprice FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def resume(spark, sf):
    stored = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return pending(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), stored, ["o_orderkey"])


@query("u1_union_sources", f"""WITH {DOCUMENTS_SQL} SELECT doc_id AS item_id, lang AS cls, file_name, 'documents' AS origin, NULL::BIGINT AS turns
FROM docs UNION ALL SELECT conv_id, role, NULL, 'conversations', turn FROM conversations""")
def union_sources(spark, sf):
    docs = documents(spark, sf).select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("cls"), "file_name", F.lit("documents").alias("origin"))
    talks = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("item_id"), F.col("role").alias("cls"), F.lit("conversations").alias("origin"),
        F.col("turn").alias("turns"))
    return ops.union_sources(docs, talks)


@query("u2_vocab_diff", """WITH a AS (SELECT DISTINCT p_brand AS n FROM part WHERE p_size > 5),
b AS (SELECT DISTINCT CASE p_type WHEN 'PROMO' THEN 'Brand#7' WHEN 'SMALL' THEN 'Brand#8' ELSE p_type END AS n FROM part)
SELECT n AS class_name, 'a' AS side FROM a WHERE n NOT IN (SELECT n FROM b)
UNION ALL SELECT n, 'b' FROM b WHERE n NOT IN (SELECT n FROM a)""")
def vocab_diff(spark, sf):
    part = table(spark, sf, "part")
    a = part.filter("p_size > 5").select(F.col("p_brand").alias("class_name"))
    b = part.select(F.col("p_type").alias("class_name"))
    return ops.vocab_diff(a, b, aliases={"PROMO": "Brand#7", "SMALL": "Brand#8"})


@query("a1_class_counts", """SELECT row_number() OVER (ORDER BY source) - 1 AS class_idx, source AS class_name, n FROM (
SELECT d.source, count(CASE WHEN l.toxic = 1 AND d.lang = 'de' THEN 1 END) AS n
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source)""")
def class_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    vocab = settle(class_vocabulary(docs, "source"))
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    flagged = docs.filter("lang = 'de'").join(toxic, "doc_id", "left_semi")
    return evaluation.class_counts(flagged, "source", vocab)


@query("a2_class_weights", "SELECT doc_id, lang, 1.0::DOUBLE / count(*) OVER (PARTITION BY lang) AS weight FROM documents")
def class_weights(spark, sf):
    return evaluation.class_weights(table(spark, sf, "documents").select("doc_id", "lang"), "lang")


@query("a7_epoch_metrics", """SELECT l_returnflag AS run, year(l_shipdate)::INT AS epoch, sum(l_quantity::BIGINT)::BIGINT AS "rows",
round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss,
round(100.0::DOUBLE * sum(least(l_quantity::BIGINT, l_linenumber))::DOUBLE / sum(l_quantity), 6) AS accuracy
FROM lineitem GROUP BY 1, 2""")
def epoch_metrics(spark, sf):
    batches = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("run"), F.year("l_shipdate").alias("epoch"), F.col("l_discount").alias("loss"),
        F.col("l_quantity").cast("bigint").alias("n"),
        F.least(F.col("l_quantity").cast("bigint"), F.col("l_linenumber").cast("bigint")).alias("correct"))
    out = evaluation.epoch_metrics(batches, ["run", "epoch"], F.col("loss"), F.col("correct"), F.col("n"))
    return out.withColumn("loss", F.round("loss", 6)).withColumn("accuracy", F.round("accuracy", 6))


@query("a8_stage_report", """SELECT source, grouping(source)::INT AS is_total, count(*) AS before,
count(CASE WHEN quality = 1 THEN 1 END) AS kept, count(CASE WHEN quality IS DISTINCT FROM 1 THEN 1 END) AS removed,
count(CASE WHEN toxic = 1 THEN 1 END) AS flagged FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)""")
def stage_report(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    return evaluation.stage_report(docs, "source", good, F.coalesce(F.col("toxic") == 1, F.lit(False)))


@query("a8_observed", """SELECT count(*) AS before, count(CASE WHEN quality = 1 THEN 1 END) AS kept,
count(CASE WHEN quality IS DISTINCT FROM 1 THEN 1 END) AS removed, count(CASE WHEN toxic = 1 THEN 1 END) AS flagged,
count(CASE WHEN quality = 1 THEN 1 END) AS written FROM documents LEFT JOIN labels USING (doc_id)""")
def observed(spark, sf):
    """The same stage, counted by the job that writes what is kept."""
    docs = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id", "left")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    stage = evaluation.counted_stage(docs, good, F.coalesce(F.col("toxic") == 1, F.lit(False)))
    path = scratch_path(spark, "stage")
    stage.rows.where(good).select("doc_id", "source").write.parquet(path)
    numbers = stage.numbers
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("written")).select(
        *[F.lit(numbers[k]).cast("bigint").alias(k) for k in ("before", "kept", "removed", "flagged")], "written")


@query("a9_plan_quota", f"""WITH {DOCUMENTS_SQL}, have AS (
SELECT source, count(CASE WHEN NOT starts_with(file_name, 'seed_') THEN 1 END) AS existing FROM docs GROUP BY source)
SELECT source, existing, greatest(1, floor((t.target - existing) / 8.0)::BIGINT + 1) AS per_query
FROM have, (SELECT 40 AS target) t WHERE existing < t.target""")
def plan_quota(spark, sf):
    return ops.plan_quota(documents(spark, sf), "source", "file_name", per_class=40)


@query("a9_plan_quota_empty", f"""WITH {DOCUMENTS_SQL}, have AS (
SELECT source, count(CASE WHEN NOT starts_with(file_name, 'seed_') THEN 1 END) AS existing FROM docs
WHERE source <> 'src3' GROUP BY source), classes AS (SELECT DISTINCT source FROM docs WHERE source IS NOT NULL)
SELECT source, coalesce(existing, 0) AS existing, greatest(1, floor((t.target - coalesce(existing, 0)) / 8.0)::BIGINT + 1) AS per_query
FROM classes LEFT JOIN have USING (source), (SELECT 40 AS target) t WHERE coalesce(existing, 0) < t.target""")
def plan_quota_empty(spark, sf):
    """One class has no items at all."""
    docs = documents(spark, sf)
    classes = docs.where("source IS NOT NULL").select("source")
    return ops.plan_quota(docs.where("source <> 'src3'"), "source", "file_name", per_class=40, classes=classes)
