"""Joins whose small side is measured before it is broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
SALTS = 32


def _checkpoint_folder(spark: SparkSession) -> None:
    """The cluster names a shared folder in spark.checkpoint.dir; only a local
    session without one gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tagloom-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, which all executors can reach."""
    _checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write a derived table to the checkpoint folder once, so that later uses
    read it instead of computing it again; it survives the loss of executors."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_broadcast(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> bool:
    """Count rows and bytes of ``df`` and compare them with the limits."""
    max_rows = BROADCAST_ROWS if max_rows is None else max_rows
    max_bytes = BROADCAST_BYTES if max_bytes is None else max_bytes
    if max_rows <= 0:
        return False
    n, size = df.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))), F.lit(0)),
    ).first()
    return n <= max_rows and size <= max_bytes


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    max_rows: int | None = None,
    null_safe: bool = False,
    small: bool | None = None,
) -> DataFrame:
    """Join ``facts`` with a keyed table that is usually small.

    A measured small table is broadcast: the facts are not shuffled and a key
    that holds a third of them costs nothing (``small`` passes on a measurement the
    caller has made). Beyond the limits the table is
    repeated once per salt and the facts spread over the salts, so that a hot key
    is shared by ``SALTS`` tasks; both sides are shuffled, neither passes the driver. The salt is a hash of the partition's number and the row: equal rows of many
    partitions spread as well, and a task that runs again gives its rows the same salts. ``how`` is inner, left, left_semi or left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    renamed = lookup.withColumnsRenamed({k: f"__r_{k}" for k in on})
    if fits_broadcast(lookup, max_rows) if small is None else small:
        left, right, extra = facts, F.broadcast(renamed), []
    else:
        spread = [F.col(f"`{f.name}`") for f in facts.schema if _can_salt(f.dataType)]
        left = facts.withColumn("__salt", F.pmod(F.xxhash64(F.spark_partition_id(), *spread), F.lit(SALTS)))
        # Spark's own estimate does not know of the repeats nor of compressed files, and would broadcast them
        right = renamed.withColumn("__r_salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))).hint("merge")
        extra = ["salt"]
    test = F.lit(True)
    for k in on:
        a, b = F.col(f"`{k}`"), F.col(f"`__r_{k}`")
        test = test & (a.eqNullSafe(b) if null_safe else a == b)
    for k in extra:
        test = test & (F.col(f"__{k}") == F.col(f"__r_{k}"))
    return left.join(right, test, how).drop("__salt", "__r_salt", *[f"__r_{k}" for k in on])


def _can_salt(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.BooleanType))
