"""Paged catalogues, nested documents, resume."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from tagloom.operators.sizing import lookup_join

CATALOGUE_PAGE = T.StructType([
    T.StructField("page", T.IntegerType()),
    T.StructField("last_page", T.IntegerType()),
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("setCode", T.StringType()),
        T.StructField("nationalPokedexNumber", T.IntegerType()),
        T.StructField("supertype", T.StringType()),
    ]))),
])


def page_status(pages: DataFrame) -> DataFrame:
    """One row (expected, reached, is_complete) for pages numbered from 1.

    ``expected`` is the last_page of page 1 (1 if it has none); ``reached`` is the
    last page before the first gap."""
    have = pages.select("page", "last_page").filter("page >= 1")
    numbers = have.select("page").distinct()
    after = numbers.select((F.col("page") - 1).alias("page"))
    last = numbers.join(after, "page", "left_anti").agg(F.min("page").alias("reached"))
    first = have.filter("page = 1").agg(
        F.count(F.lit(1)).alias("starts"),
        F.greatest(F.coalesce(F.max("last_page"), F.lit(1)), F.lit(1)).alias("expected"))
    return first.select(
        "expected",
        F.when(F.col("starts") > 0, F.least(last.select("reached").scalar(), F.col("expected")))
        .otherwise(F.lit(0)).alias("reached"),
    ).withColumn("is_complete", F.col("reached") >= F.col("expected"))


def ingest_pages(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, status): the entries of all pages before the first gap, with
    ``page`` and ``pos`` as catalogue order, and the one-row status."""
    status = page_status(pages)
    rows = (
        pages.filter((F.col("page") >= 1) & (F.col("page") <= status.select("reached").scalar()))
        .select("page", F.posexplode("data").alias("pos", "entry"))
        .select("page", "pos", "entry.*")
    )
    return rows, status


def publish_catalogue(rows: DataFrame, status: DataFrame, path: str) -> bool:
    """Write the rows to a new path if and only if every page was present."""
    complete = bool(status.first()["is_complete"])
    if complete:
        rows.write.mode("errorifexists").parquet(path)
    return complete


def bucket_catalogue(
    rows: DataFrame, wanted: DataFrame, class_col: str, supertype: str | None,
    id_col: str = "id", set_col: str = "setCode", supertype_col: str = "supertype",
) -> DataFrame:
    """Entries of wanted classes with the right supertype, an id and a set."""
    ok = (
        F.col(id_col).isNotNull() & (F.col(id_col).cast("string") != "")
        & F.col(set_col).isNotNull() & (F.col(set_col).cast("string") != "")
    )
    if supertype is not None:
        ok = ok & (F.col(supertype_col) == supertype)
    return lookup_join(rows.filter(ok), wanted.select(class_col), [class_col], how="left_semi")


def pending(targets: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Targets not stored yet. The stored keys are made distinct first, on the map
    side too, so a key stored many times is one row when the sides meet. What is
    stored grows with the input and is never broadcast."""
    return targets.join(existing.select(*keys).distinct().hint("merge"), keys, "left_anti")


def _leaves(node, skip: frozenset, out: list) -> None:
    stack = [node]
    while stack:
        here = stack.pop()
        if isinstance(here, dict):
            stack.extend(v for k, v in reversed(here.items()) if k not in skip)
        elif isinstance(here, str):
            out.append(here)


def _walked(docs: pa.Array, skip: frozenset) -> pa.Array:
    """The leaves of a batch; one document at a time is a Python string, as a batch may hold many long ones."""
    result = []
    for doc in docs:
        found: list[str] = []
        if doc.is_valid:
            try:
                _leaves(json.loads(doc.as_py()), skip, found)
            except (ValueError, RecursionError):  # deeper than a reader can follow
                pass
        result.append(found)
    return pa.array(result, type=pa.list_(pa.string()))


def string_leaves(json_col: Column, skip: Sequence[str] = ("versions",)) -> Column:
    """String leaves reached through objects only, in document order; subtrees
    under a skipped key are left out. Unreadable documents give no leaves."""
    skipped = frozenset(skip)

    @F.arrow_udf("array<string>")
    def walk(docs: pa.Array) -> pa.Array:
        return _walked(docs, skipped)

    return walk(json_col)


def harvest_urls(
    df: DataFrame, id_col: str, json_col: str,
    skip: Sequence[str] = ("versions",), prefix: str = "http", suffix: str = ".png",
) -> DataFrame:
    """(id, pos, url): wanted leaves of each document, first occurrences, in
    document order. One document stays one row until the end: no shuffle."""
    leaves = string_leaves(F.col(json_col), skip)
    wanted = F.array_distinct(F.filter("__leaves", lambda x: x.startswith(prefix) & x.endswith(suffix)))
    # the outer form: the plain one would add a size test that walks each document twice
    return (
        df.select(id_col, leaves.alias("__leaves"))
        .select(id_col, F.posexplode_outer(wanted).alias("pos", "url"))
        .filter("pos IS NOT NULL")
    )
