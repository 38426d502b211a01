"""Sinks. Ordered outputs are range-sorted part files: read in name order they
are one sorted file, and no single task writes them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.operators.evaluation import confusion_lines, worst_first


def write_vocab(vocab: DataFrame, path: str) -> None:
    """One class name per line in class order."""
    vocab.orderBy("class_idx").select("class_name").write.text(path)


def write_mapping(df: DataFrame, path: str, name: str = "name", value: str = "value") -> None:
    """JSON object, one entry per line, sorted by name, non-ASCII kept. A repeated
    name keeps its largest value; a NULL name fails the job."""
    spark = df.sparkSession
    df = df.groupBy(F.coalesce(F.col(name), F.raise_error(F.lit("a name is NULL")).cast("string")).alias(name)).agg(F.max(value).alias(value))
    entry = F.to_json(F.create_map(F.col(name), F.col(value)))
    first = df.agg(F.min(name)).scalar()
    comma = F.when(F.col(name) == first, "").otherwise(",")
    lines = df.select(F.lit(1).alias("at"), F.col(name).alias("key"), F.concat(
        comma, entry.substr(F.lit(2), F.length(entry) - 2)).alias("value"))
    ends = spark.createDataFrame([(0, None, "{"), (2, None, "}")], "at int, key string, value string")
    ends.unionByName(lines).orderBy("at", "key").select("value").write.text(path)


def write_reports(cm: DataFrame, per_class: DataFrame, vocab: DataFrame, out: str) -> None:
    """``confusion_matrix`` (first header cell empty) and ``per_class_accuracy``
    (worst first, accuracy to 4 decimals) as CSV folders under ``out``. A line of the matrix is put together from the cells of
    its class that are not zero, so there may be tens of thousands of classes; lines are in class order over the part files."""
    header = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class_idx", "class_name"))), lambda c: _field(c["class_name"])), ",")
    lines = confusion_lines(cm, vocab).select("class_idx", F.concat(_field(F.col("class_name")), F.lit(","), F.col("line")).alias("line"))
    # each part file begins with the header, as readers expect of a folder
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    head = F.concat(F.lit(","), vocab.agg(header).scalar(), F.lit("\n"))
    lines.orderBy("class_idx").select(F.when(first, F.concat(head, F.col("line"))).otherwise(F.col("line")).alias("value")).write.text(
        f"{out}/confusion_matrix")
    worst_first(per_class).select(
        F.col("class_name").alias("class"), "test_samples", F.format_string("%.4f", "accuracy").alias("accuracy"),
    ).write.option("header", True).csv(f"{out}/per_class_accuracy")


def _field(name: Column) -> Column:
    """A name as a field of a CSV line; quoted, quotes with a backslash, where it needs to be."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(name.rlike(r'[",\r\n\\]|^\s|\s$|^$'), quoted).otherwise(name)


def write_manifest(df: DataFrame, path: str, by: str) -> None:
    """Parquet partitioned by class or split. The rebalance lets Spark split a hot
    value over several files and join the small ones."""
    df.hint("rebalance", F.col(by)).write.partitionBy(by).parquet(path)
