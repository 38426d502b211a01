"""Numbering, first-wins and top-n operators.

No operator here gives one task an unbounded group. Ranks over a whole table or
over a group of any size are taken from a range-partitioned, written copy:
position inside the partition plus the sizes of the partitions before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tagloom.operators.selection import first_n
from tagloom.operators.sizing import lookup_join, settle

# Spark trims groups on the map side (WindowGroupLimit) up to this many rows.
TRIMMED_CAP = 1000
SALTS = 64

_CHUNK, _SEQ, _OFF = "__chunk", "__seq", "__off"


def _placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """Range-partition and sort by ``keys``, note each row's place, write it."""
    return settle(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(_CHUNK, F.spark_partition_id())
        .withColumn(_SEQ, F.monotonically_increasing_id())
    )


def rank_within(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """1-based rank in ``order`` (unique within a group), for groups of any size.

    ``group`` may be empty: the rank then runs over the whole table."""
    placed = _placed(df, [*group, *order])
    sizes = placed.groupBy(*group, _CHUNK).agg(F.count(F.lit(1)).alias("__n"), F.min(_SEQ).alias("__first"))
    # at most one row per range partition and group; without groups the number
    # of partitions bounds it
    whole = [F.col(g) for g in group] or [F.lit(0)]
    before = W.partitionBy(*whole).orderBy(_CHUNK).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, _CHUNK, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias(_OFF))
    joined = lookup_join(placed, settle(offsets), [*group, _CHUNK], how="inner", null_safe=True)
    return joined.withColumn(name, F.col(_SEQ) + F.col(_OFF) + 1).drop(_CHUNK, _SEQ, _OFF)


def number_in_order(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers from ``start`` over the whole table."""
    return rank_within(df, [], order, name).withColumn(name, F.col(name) - 1 + start)


def dedup_first(df: DataFrame, group: list[str], fingerprint: str, order: str, prefer: Sequence[str] = ()) -> DataFrame:
    """Per group, keep the smallest ``order`` of the rows with an equal fingerprint; NULL is the largest.
    Values that start with one of ``prefer`` come before all others.

    Rows without a fingerprint (unreadable) are dropped. Copies are cut down on
    the map side, so a fingerprint shared by a third of the rows sends one row
    per map task, not the whole pile."""
    readable = df.filter(F.col(fingerprint).isNotNull()) if df.schema[fingerprint].nullable else df
    keys, behind = [*group, fingerprint], F.lit(1)
    for prefix in prefer:
        behind = F.when(F.col(order).startswith(prefix), 0).otherwise(behind)
    if set(df.columns) == {*keys, order}:
        first = F.min_by(order, F.struct(behind, F.col(order).isNull(), F.col(order))) if prefer else F.min(order)
        return readable.groupBy(*keys).agg(first.alias(order)).select(*df.columns)
    w = W.partitionBy(*keys).orderBy(behind, F.col(order).asc_nulls_last())
    return readable.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def cap_per_group(df: DataFrame, group: list[str], order: list[str], cap: int) -> DataFrame:
    """First ``cap`` rows of each group in ``order``; 0 means no cap.

    Small caps: each map task keeps its own first ``cap`` rows, a salted step
    merges them, the last step sees ``SALTS * cap`` rows of a group at most.
    Large caps: the key of the cap-th row is searched and the rows are compared with it."""
    if cap < 0:
        raise ValueError("cap must be 0 or more")
    if cap == 0:
        return df
    if cap > TRIMMED_CAP:
        return first_n(df, group, order, cap)
    salted = df.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    partial = salted.withColumn(
        "__rn", F.row_number().over(W.partitionBy(*group, "__salt").orderBy(*order))
    ).filter(F.col("__rn") <= cap).drop("__rn", "__salt")
    return partial.withColumn(
        "__rn", F.row_number().over(W.partitionBy(*group).orderBy(*order))
    ).filter(F.col("__rn") <= cap).drop("__rn")


def first_n_passing(
    df: DataFrame, group: list[str], order: list[str], n: int, passes: Column, overfetch: int = 3
) -> DataFrame:
    """Of the first ``overfetch * n`` candidates keep the first ``n`` that pass."""
    return cap_per_group(cap_per_group(df, group, order, overfetch * n).filter(passes), group, order, n)


def ordered_distinct(df: DataFrame, group: list[str], value: str, pos: str) -> DataFrame:
    """First occurrence of each value, order kept, renumbered from 0 in ``pos``."""
    first = df.groupBy(*group, value).agg(F.min(pos).alias("__at"))
    return (
        rank_within(first, group, ["__at", value], "__rank")
        .select(*group, value, (F.col("__rank") - 1).alias(pos))
    )


def class_vocabulary(df: DataFrame, label: str) -> DataFrame:
    """(class_idx, class_name): distinct labels numbered from 0 in code-point order."""
    names = df.select(F.col(label).alias("class_name")).filter(F.col(label).isNotNull()).distinct()
    return number_in_order(names, ["class_name"], "class_idx").select("class_idx", "class_name")


def class_index(df: DataFrame, label: str, vocab: DataFrame | None = None) -> DataFrame:
    """Attach ``class_idx`` to every row; NULL for a NULL or unknown label."""
    vocab = vocab if vocab is not None else settle(class_vocabulary(df, label))
    return lookup_join(df, vocab.withColumnRenamed("class_name", label), [label], how="left")
