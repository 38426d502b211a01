"""From documents to encoded training text: the stages of one corpus run.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last return the columns
of documents. Texts are read whole however long they are; an empty table gives an empty one; extra columns, whatever their names, are passed on
by all stages but the last. Null ids are rows like others, and each row of a repeated id is judged by its own text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.llm.batches import table, written
from tagloom.llm.mixing import mix
from tagloom.llm.pieces import encode_pieces
from tagloom.llm.pii import mask_pii
from tagloom.llm.quality import keep_good
from tagloom.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a promised cutoff reject go. Null and empty texts go, as they have fewer than 20 words; equal
    rows share one verdict and all stay or go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; null and wordless texts are one group, equal rows are
    copies of which one stays, a group without ids keeps one row."""
    return keep_one(docs)


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to the name of their kind. Null texts stay null; every row stays, equal rows alike."""
    return mask_pii(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken none, one, two or three times, so that sources come near their target weights. A null source is one, the
    last; texts without words have size zero and are never multiplied; equal rows share one fate."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and digests of the ids and of the decoded text. A null text is encoded like an empty one."""
    keep = {c: F.col(c) for c in ("doc_id", "lang", "source")}
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("pii_masking", pii_masking),
    ("source_mixing", source_mixing),
    ("encoding", encoding),
]

#: Fingerprints, exact binomial bounds and piece ids have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in order; each one's rows are written and read back before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
