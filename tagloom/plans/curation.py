"""Composite jobs that build a labelled set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tagloom.functions import fixed
from tagloom.functions.text import display_name, item_file_name
from tagloom.operators.catalogue import bucket_catalogue, ingest_pages, pending
from tagloom.operators.gate import kept, relevance_gate
from tagloom.operators.labels import union_sources
from tagloom.operators.ranking import cap_per_group, dedup_first


@dataclass
class Curated:
    """``manifest``: survivors of the duplicate drop with their decision;
    ``items``: the rows that stay; ``report``: counts per class and in total.

    All three are lazy. To use more than one, write the manifest first and take
    the items from what was written."""

    manifest: DataFrame
    items: DataFrame
    report: DataFrame


def curate(
    sources: list[DataFrame], prompts: DataFrame, class_col: str, file_name: str, fingerprint: str, vec: str,
    threshold: float = fixed.KEEP_THRESHOLD, explicit: float = fixed.EXPLICIT_THRESHOLD,
) -> Curated:
    """Union, duplicate drop, relevance gate, accounting; the order is fixed."""
    merged = union_sources(*sources)
    unique = dedup_first(merged, [class_col], fingerprint, file_name)
    manifest = relevance_gate(unique, prompts, class_col, vec, file_name, threshold, explicit)
    # counts of the three stages, tagged and added up in one aggregation
    zero, one = F.lit(0), F.lit(1)
    before = merged.select(class_col, one.alias("b"), zero.alias("u"), zero.alias("k"), zero.alias("x"))
    after = manifest.select(
        class_col, zero.alias("b"), one.alias("u"),
        F.col("decision").isin("trusted", "keep").cast("int").alias("k"),
        (F.col("decision") == "explicit").cast("int").alias("x"))
    report = before.unionByName(after).rollup(class_col).agg(
        F.grouping(class_col).cast("int").alias("is_total"),
        F.sum("b").alias("before"),
        (F.sum("b") - F.sum("u")).alias("duplicates"),
        F.sum("k").alias("kept"),
        (F.sum("u") - F.sum("k")).alias("gated"),
        F.sum("x").alias("flagged"))
    return Curated(manifest, kept(manifest), report)


def catalogue_items(
    pages: DataFrame, wanted: DataFrame, existing: DataFrame, class_col: str,
    supertype: str | None = fixed.CARD_SUPERTYPE, cap: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(targets still to fetch, scan status): ingest, bucket by class, cap, skip
    what is stored, name the files. ``existing`` is (class, file_name)."""
    rows, status = ingest_pages(pages)
    wanted_rows = cap_per_group(bucket_catalogue(rows, wanted, class_col, supertype), [class_col], ["page", "pos"], cap)
    named = wanted_rows.withColumn("file_name", item_file_name("card", F.col("id")))
    return pending(named, existing, [class_col, "file_name"]), status


def class_table(api_rows: DataFrame, max_id: int, id_col: str = "id", slug_col: str = "name") -> DataFrame:
    """(dex, name, slug) for ids 1..max_id."""
    return api_rows.filter(F.col(id_col).between(1, max_id)).select(
        F.col(id_col).alias("dex"), display_name(F.col(slug_col)).alias("name"), F.col(slug_col).alias("slug"))
