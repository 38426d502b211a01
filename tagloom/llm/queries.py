"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.llm.batches import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query()
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    from tagloom.llm.pieces import encode_pieces

    docs = table(spark, folder, "documents")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), {"doc_id": F.col("doc_id")}, ids=False)


@query()
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from tagloom.llm.tokens import count_tokens

    docs = table(spark, folder, "documents")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), {"doc_id": F.col("doc_id")})


@query()
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from tagloom.llm.quality import quality_rules

    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    from tagloom.llm.pii import pii_digest

    return pii_digest(table(spark, folder, "documents"))


MIX_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS place
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight,
         (3 * source_size)::DOUBLE AS stop FROM sums),
shared AS (
  SELECT *, row_number() OVER (ORDER BY stop / weight, source NULLS LAST) AS nr,
         (sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY stop / weight, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM weighted),
firsts AS (SELECT min(nr) AS f, arg_min(share, nr) AS rest FROM shared WHERE share < stop / weight),
plan AS (
  SELECT source, source_size, CASE WHEN f IS NULL OR nr < f THEN stop ELSE weight * rest END AS target
  FROM shared LEFT JOIN firsts ON true),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM plan),
places AS (
  SELECT source, place, sum(size)::BIGINT AS words FROM sized GROUP BY ALL),
run AS (
  SELECT p.*, sum(words) OVER (PARTITION BY p.source ORDER BY place) AS upto, b.target - b.copies * b.source_size AS budget
  FROM places p JOIN budgets b ON p.source IS NOT DISTINCT FROM b.source),
edge AS (SELECT source, min(place) AS least, arg_min(upto, place) AS upto, arg_min(words, place) AS words, any_value(budget) AS budget
         FROM run WHERE upto > budget GROUP BY source),
cuts AS (SELECT source, least + CASE WHEN words - (budget - (upto - words)) < budget - (upto - words) THEN 1 ELSE 0 END AS cut FROM edge)
SELECT s.doc_id, s.size, b.source_size, b.target,
       s.size * (b.copies + CASE WHEN s.place < coalesce(c.cut, 0) THEN 1 ELSE 0 END) AS taken
FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
LEFT JOIN cuts c ON s.source IS NOT DISTINCT FROM c.source
"""


@query(MIX_SQL)
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    from tagloom.llm.mixing import mix_plan

    return mix_plan(table(spark, folder, "documents"))


@query()
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from tagloom.llm.simhash import simhash_groups

    return simhash_groups(table(spark, folder, "documents")).drop("group")


@query()
def op9_substrings(spark: SparkSession, folder: str) -> DataFrame:
    from tagloom.llm.substrings import drop_substrings

    return drop_substrings(table(spark, folder, "documents"), kept_text=False)


@query()
def op5_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    from tagloom.llm.rabitq import near_vectors

    return near_vectors(table(spark, folder, "embeddings"))


@query()
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    from tagloom.llm.language import identify_languages

    return identify_languages(table(spark, folder, "documents"))


@query()
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    from tagloom.llm.licenses import license_digest

    return license_digest(table(spark, folder, "documents"))


@query()
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from tagloom.llm.whitening import whiten

    return whiten(table(spark, folder, "embeddings"))


def manifest_sql(levels: int = 5, source_levels: int = 4) -> str:
    """The manifest level by level: so many levels hold 16^levels documents of a source and 16^source_levels sources."""
    def tree(name: str, keys: str, levels: int) -> str:
        """n_<name>_i: the nodes of level i; s_<name>_i: each node with the others of its run, at the place ``at`` of the run."""
        by, out = (f"{keys}, " if keys else ""), []
        for i in range(levels + 1):
            if i:
                out.append(f"""n_{name}_{i} AS (SELECT {by}pos // 16 AS pos, CASE WHEN any_value(many) THEN sha256(string_agg(node, '' ORDER BY pos))
  ELSE any_value(node) END AS node FROM m_{name}_{i - 1} GROUP BY {by}pos // 16)""")
            over = f"PARTITION BY {keys}" if keys else ""
            out.append(f"m_{name}_{i} AS (SELECT *, count(*) OVER ({over}) > 1 AS many FROM n_{name}_{i})")
            if i < levels:
                out.append(f"""s_{name}_{i} AS (SELECT *, CASE WHEN many THEN coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS before,
  CASE WHEN many THEN coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS after
  FROM m_{name}_{i} WINDOW w AS (PARTITION BY {by}pos // 16 ORDER BY pos))""")
        return ",\n".join(out)

    def enc(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR END"

    def leaf_of(text: str) -> str:
        return "sha256(" + " || ".join(map(enc, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    shift = "t0 AS (SELECT i, i::BIGINT AS c FROM range(256) r(i))"
    for k in range(8):
        shift += f",\nt{k + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM t{k})"
    walk, joins = [], []
    for i in range(levels):
        walk.append((f"a{i}", f"s_doc_{i} a{i} ON a{i}.key = l.key AND a{i}.pos = l.pos // {16 ** i}"))
    for i in range(source_levels):
        walk.append((f"b{i}", f"s_src_{i} b{i} ON b{i}.pos = p.pos // {16 ** i}"))
    joins = "\n".join(f"JOIN {on}" for _, on in walk)
    proof = " || ".join(f"{a}.before || {a}.after" for a, _ in walk)
    steps, last = [], "start"
    for k, (a, _) in enumerate(walk):
        steps.append(f"f{k} AS (SELECT * EXCLUDE (node), CASE WHEN {a}_many THEN sha256({a}_before || node || {a}_after) ELSE node END AS node FROM {last})")
        last = f"f{k}"
    sides = ", ".join(f"{a}.many AS {a}_many, {a}.before AS {a}_before, {a}.after AS {a}_after" for a, _ in walk)
    return f"""WITH {shift},
crcs AS (SELECT list(c ORDER BY i) AS tbl FROM t8),
coded AS (SELECT *, coalesce('=' || source, '-') AS key, {leaf_of('text')} AS leaf,
  {leaf_of("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS changed,
  xor(list_reduce([4294967295] || list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT),
    lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295) AS crc
  FROM documents, crcs),
l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM coded),
n_doc_0 AS (SELECT key, pos, leaf AS node FROM l),
{tree('doc', 'key', levels)},
p AS (SELECT key, node AS subroot, row_number() OVER (ORDER BY encode(key)) - 1 AS pos FROM n_doc_{levels}),
n_src_0 AS (SELECT pos, subroot AS node FROM p),
{tree('src', '', source_levels)},
r AS (SELECT node AS root FROM n_src_{source_levels}),
start AS (SELECT l.doc_id, l.leaf, p.subroot, r.root, sha256({proof}) AS proof_sha256, CASE WHEN l.crc % 5 = 0 THEN changed ELSE leaf END AS node, {sides}
  FROM l JOIN p ON p.key = l.key {joins}, r),
{', '.join(steps)}
SELECT doc_id, leaf, subroot, root, proof_sha256, node AS folded_root, node = root AS verified FROM {last}"""


@query(manifest_sql())
def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    from tagloom.llm.manifest import manifest

    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest(table(spark, folder, "documents"), tampered)


@query()
def op13_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from tagloom.llm.secrets import secrets_digest

    return secrets_digest(table(spark, folder, "documents"))
