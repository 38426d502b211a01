"""Published versions of a data set: readers see whole versions only.

A version's files go to a folder of their own; the version counts once its commit record is written. A run that
fails on the way leaves no record, so readers keep the newest complete version. Everything goes through Spark's own readers and
writers, whatever store the path is in.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

COMMIT = "version bigint, folder string, n_rows bigint"


def commits(spark: SparkSession, root: str) -> DataFrame:
    """version, folder, n_rows of every complete version."""
    try:
        return spark.read.schema(COMMIT).option("recursiveFileLookup", True).json(f"{root}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMIT)


def newest(spark: SparkSession, root: str):
    """The newest commit record, None before the first."""
    return commits(spark, root).orderBy(F.col("version").desc()).limit(1).first()


def publish(df: DataFrame, root: str, by: str | None = None, complete: bool = True) -> int | None:
    """Write a version and commit it; its number, or None if it is not ``complete`` and readers keep the one before.

    Two runs that publish at once get different folders; of the same number only one record is written, the other run fails."""
    if not complete:
        return None
    spark = df.sparkSession
    folder = f"{root}/versions/{uuid.uuid4().hex}"
    out = df.hint("rebalance", F.col(by)).write.partitionBy(by) if by else df.write
    out.parquet(folder)
    last = newest(spark, root)
    version = 1 if last is None else last["version"] + 1
    n_rows = spark.read.parquet(folder).count()
    record = spark.createDataFrame([(version, folder, n_rows)], COMMIT)
    record.coalesce(1).write.mode("errorifexists").json(f"{root}/commits/{version:012d}")  # one row
    return version


def read_published(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest complete version, or the one with a number."""
    found = newest(spark, root) if version is None else commits(spark, root).where(F.col("version") == version).first()
    if found is None:
        raise ValueError(f"nothing published in {root}" if version is None else f"no version {version} in {root}")
    return spark.read.parquet(found["folder"])
