"""Curation over several deliveries: a store of fingerprints against which only the new delivery moves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagloom.operators.ranking import dedup_first
from tagloom.operators.sizing import settle

BUCKETS = 64


@dataclass
class FingerprintStore:
    """A bucketed table with one row per class and fingerprint seen so far.

    Stored rows lie in buckets by class and fingerprint, so a delivery is hashed to the buckets and meets them there; the store
    itself is read in place and never shuffled."""

    spark: SparkSession
    table: str
    group: str
    fingerprint: str
    buckets: int = BUCKETS

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def stored(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, delivery: DataFrame) -> DataFrame:
        """Rows whose class and fingerprint are not stored; a NULL class is a class. Rows without a fingerprint are dropped."""
        rows = delivery.where(F.col(self.fingerprint).isNotNull())
        if not self.exists():
            return rows
        known = self.stored().withColumnsRenamed({self.group: "__g", self.fingerprint: "__f"}).hint("merge")
        # the test on equality of the keys buckets both sides alike; NULL classes are stored under a key of their own
        return rows.withColumn("__k", _key(F.col(self.group))).join(
            known, (F.col("__k") == F.col("__g")) & (F.col(self.fingerprint) == F.col("__f")), "left_anti").drop("__k")

    def add(self, survivors: DataFrame) -> None:
        """Store the class and fingerprint of rows that stay."""
        keys = survivors.select(_key(F.col(self.group)).alias(self.group), self.fingerprint).repartition(self.buckets, self.group, self.fingerprint)
        keys.write.mode("append").format("parquet").bucketBy(self.buckets, self.group, self.fingerprint).sortBy(
            self.group, self.fingerprint).saveAsTable(self.table)


def _key(group: Column) -> Column:
    """A class as a stored key: NULL apart from every name."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def curate_delivery(store: FingerprintStore, delivery: DataFrame, order: str) -> DataFrame:
    """What a delivery adds: per class the first row of each fingerprint that no earlier delivery brought; it is stored and returned.

    The rows are written before the store grows, so what is returned does not change with it. A delivery that fails in between can be run
    again. What earlier deliveries kept stays, even if a later one has a smaller ``order``."""
    first = dedup_first(delivery, [store.group], store.fingerprint, order)
    added = settle(store.unseen(first))
    store.add(added)
    return added
