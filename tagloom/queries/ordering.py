"""First-wins, caps, numbering and epoch logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagloom.operators import ranking
from tagloom.operators.catalogue import ingest_pages
from tagloom.operators.evaluation import early_stop
from tagloom.operators.sizing import settle
from tagloom.queries.registry import query, table
from tagloom.queries.shared import DOCUMENTS_SQL, documents


def order_pages(spark, sf):
    """Orders landed as catalogue pages of 100 keys; the array of a page is bounded."""
    size = 100
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    last = orders.agg((F.floor(F.max("o_orderkey") / size) + 1).cast("int")).scalar()
    return settle(
        orders.groupBy((F.floor(F.col("o_orderkey") / size) + 1).cast("int").alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey", "o_orderpriority"))).alias("data"))
        .withColumn("last_page", last)
    )


ORDER_PAGES_SQL = """paged AS (SELECT (o_orderkey // 100 + 1)::INT AS page,
  row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) - 1 AS pos,
  o_orderkey, o_custkey, o_orderpriority FROM orders),
scan AS (SELECT (SELECT max(page) FROM paged) AS expected,
  coalesce((SELECT min(p.page) FROM paged p WHERE p.page + 1 NOT IN (SELECT page FROM paged)), 0) AS reached)"""


@query("src5_ingest_pages", f"""WITH {ORDER_PAGES_SQL} SELECT page, pos, o_orderkey, o_custkey, expected, reached >= expected AS is_complete
FROM paged, scan WHERE page <= reached""")
def ingest(spark, sf):
    rows, status = ingest_pages(order_pages(spark, sf))
    return rows.select(
        "page", F.col("pos").cast("bigint").alias("pos"), "o_orderkey", "o_custkey",
        status.select("expected").scalar().alias("expected"), status.select("is_complete").scalar().alias("is_complete"))


@query("w1_class_index", """WITH v AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS class_idx
FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, source, class_idx FROM documents JOIN v USING (source)""")
def class_index(spark, sf):
    return ranking.class_index(table(spark, sf, "documents").select("doc_id", "source"), "source")


@query("w2_dedup_first", f"""WITH {DOCUMENTS_SQL} SELECT lang, fp, file_name, doc_id FROM (
SELECT *, row_number() OVER (PARTITION BY lang, fp ORDER BY file_name) AS rn FROM docs) WHERE rn = 1""")
def dedup_first(spark, sf):
    docs = documents(spark, sf).select("lang", "fp", "file_name", "doc_id")
    return ranking.dedup_first(docs, ["lang"], "fp", "file_name")


@query("w2_dedup_prefer", f"""WITH {DOCUMENTS_SQL} SELECT lang, fp, file_name, doc_id FROM (SELECT *, row_number() OVER (
PARTITION BY lang, fp ORDER BY CASE WHEN file_name LIKE 'seed\\_%' ESCAPE '\\' THEN 0 ELSE 1 END, file_name) AS rn FROM docs) WHERE rn = 1""")
def dedup_prefer(spark, sf):
    docs = documents(spark, sf).select("lang", "fp", "file_name", "doc_id")
    return ranking.dedup_first(docs, ["lang"], "fp", "file_name", prefer=("seed_",))


_RANKED_LINES = """SELECT p_brand, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY p_brand
ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rn
FROM lineitem JOIN part ON l_partkey = p_partkey"""


def _brand_lines(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"]).drop("p_partkey")


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
_LINE_OUT = ["p_brand", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@query("w3_cap_per_group", f"SELECT * EXCLUDE (rn) FROM ({_RANKED_LINES}) WHERE rn <= 25")
def cap_small(spark, sf):
    return ranking.cap_per_group(_brand_lines(spark, sf), ["p_brand"], _LINE_ORDER, 25).select(*_LINE_OUT)


@query("w3_cap_per_group_large", f"SELECT * EXCLUDE (rn) FROM ({_RANKED_LINES}) WHERE rn <= 1500")
def cap_large(spark, sf):
    return ranking.cap_per_group(_brand_lines(spark, sf), ["p_brand"], _LINE_ORDER, 1500).select(*_LINE_OUT)


@query("w5_ordered_distinct", """SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first_id) - 1 AS pos
FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL)""")
def ordered_distinct(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", F.col("event_id").alias("pos"))
    return ranking.ordered_distinct(events, ["user_id"], "event_type", "pos")


@query("w6_first_n_passing", """SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS kept FROM (
SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS seen FROM documents)
WHERE seen <= 90 AND n_chars > 500) WHERE kept <= 30""")
def first_n_passing(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "doc_id", "n_chars")
    return ranking.first_n_passing(docs, ["lang"], ["doc_id"], 30, F.col("n_chars") > 500)


@query("w8_early_stop", """WITH log AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch, value FROM events),
m AS (SELECT *, greatest(0.0::DOUBLE, coalesce(max(value) OVER (PARTITION BY user_id ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM log),
f AS (SELECT *, coalesce(max(CASE WHEN value > before THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS last_up FROM m),
s AS (SELECT user_id, min(CASE WHEN epoch - last_up >= 6 THEN epoch END) AS stop_epoch FROM f GROUP BY user_id)
SELECT user_id, stop_epoch, max(last_up) AS best_epoch, greatest(0.0::DOUBLE, max(value)) AS best
FROM f JOIN s USING (user_id) WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY user_id, stop_epoch""")
def stop(spark, sf):
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    log = ranking.rank_within(events, ["user_id"], ["ts", "event_id"], "epoch")
    return early_stop(log.withColumn("epoch", F.col("epoch") - 1), "user_id", "epoch", "value")
