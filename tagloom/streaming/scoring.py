"""Continuous scoring: each arriving item is scored, routed and answered once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tagloom.functions import fixed
from tagloom.operators.scoring import Scorer, route, score, to_response, verdict


def answer(
    df: DataFrame, features: str, first: Scorer, second: Scorer, members: Sequence[str],
    aliases: Mapping[str, str] = fixed.LABEL_ALIASES, trust: float = fixed.TRUST, k: int = 3,
) -> DataFrame:
    """Scores, routing, verdict and response; the same for tables and streams."""
    routed = route(score(df, first, features, k), "predictions", features, second, members, aliases, trust, k)
    return to_response(verdict(routed))


def stream_score(
    spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, *,
    keys: Sequence[str], features: str, first: Scorer, second: Scorer, members: Sequence[str],
    files_per_batch: int = 1000, every: str | None = None, **options,
) -> StreamingQuery:
    """Start a query over a folder of parquet files; state is the file log only.

    With ``every`` ("10 seconds") it goes on, otherwise it ends when all files that
    are there have been answered."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    items = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    answered = answer(items, features, first, second, members, **options)
    return (
        answered.select(*keys, "model", "top_name", "top_confidence", "verdict", "response")
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**trigger).start()
    )


def stream_answer_once(
    spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, *,
    keys: Sequence[str], features: str, first: Scorer, second: Scorer, members: Sequence[str],
    files_per_batch: int = 1000, every: str | None = None, **options,
) -> StreamingQuery:
    """Like :func:`stream_score`, but an item that is delivered again, in the same or a later batch, is not answered again.

    The items seen are the state of the query, partitioned by key and checkpointed with the file log. A batch is written to a
    folder of its own number, so a batch that runs again after a restart replaces its own answers. Read ``out`` as one table."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    items = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    answered = answer(items.dropDuplicates(list(keys)), features, first, second, members, **options)
    answered = answered.select(*keys, "model", "top_name", "top_confidence", "verdict", "response")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return answered.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()
