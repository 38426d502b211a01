"""Narrow passes over whole texts, in Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Characters that a kernel gets at once; a longer text comes alone.
SLICE_CHARS = 2_000_000

#: The words of a text: runs of anything but ASCII white space. ``bytes.split()`` cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """Words of a whole text as UTF-8; a null has none."""
    return text.encode().split() if text else []


def slices(texts: Sequence[str | None], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``most`` characters each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    df: DataFrame,
    keep: dict[str, Column],
    text: Column,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[str | None]], dict]],
) -> DataFrame:
    """The columns ``keep`` and those that a kernel derives from each whole text.

    ``make`` runs once per task and returns the kernel: texts of some rows in, one
    sequence per field out, row by row. Columns of ``df`` that are not named do
    not reach the kernel, so their names cannot clash with the new ones.
    """
    chosen = df.select(*[c.alias(k) for k, c in keep.items()], text.cast("string").alias("__text"))
    schema = T.StructType([*chosen.schema.fields[:-1], *fields])
    names, kinds = [f.name for f in fields], [f.type for f in to_arrow_schema(T.StructType(fields))]

    def run(batches):
        kernel = make()
        for batch in batches:
            whole = batch.column(batch.num_columns - 1)
            start = 0
            while start < batch.num_rows:
                # take rows until the slice is full, so that few texts are Python strings at a time
                for a, b in slices(some := whole.slice(start, 256).to_pylist()):
                    made = kernel(some[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [*(c.slice(start + a, b - a) for c in batch.columns[:-1]),
                         *(pa.array(made[n], k) for n, k in zip(names, kinds))],
                        names=[*batch.schema.names[:-1], *names])
                start += len(some)

    return chosen.mapInArrow(run, schema)


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table as Parquet in the shared checkpoint folder and read it
    back: later passes prune its columns, and lost executors cost nothing."""
    from tagloom.operators.sizing import scratch_path

    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sha256_hex(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
