"""Sources: labelled image folders, ordered lists, mappings, catalogue pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagloom.functions.text import UNICODE_BLANKS
from tagloom.operators.catalogue import CATALOGUE_PAGE
from tagloom.operators.ranking import number_in_order


def _decoded(origin: Column) -> Column:
    """Undo percent encoding; a plus sign is a plus sign. Local paths are written
    the way the other file sources write them."""
    decoded = F.url_decode(F.replace(origin, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:///", "file:/")


def _place(path: Column) -> list[Column]:
    parts = F.split(path, "/")
    return [F.element_at(parts, -2).alias("class_name"), F.element_at(parts, -1).alias("file_name"), path.alias("path")]


def labelled_place(origin: Column) -> list[Column]:
    """class_name, file_name, path of an image's percent-encoded origin."""
    return _place(_decoded(origin))


def read_labelled_images(spark: SparkSession, root: str, decode: bool = True) -> DataFrame:
    """(class_name, file_name, path, image): label = the parent directory.

    ``image`` is Spark's image struct, or with ``decode=False`` the raw bytes.
    Sort by (class_name, file_name) where the order of the folder matters. A folder
    of very many small files is best read once with ``decode=False`` and written as
    parquet; later jobs then read few large files."""
    if decode:
        src = spark.read.format("image").option("recursiveFileLookup", True).load(root)
        return src.select(*labelled_place(F.col("image.origin")), "image")
    src = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return src.select(*_place(F.col("path")), F.col("content").alias("image"))


def split_unreadable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose image could be decoded, and the others' paths."""
    ok = F.col("image").isNotNull() & (F.coalesce(F.col("image.height"), F.lit(-1)) > 0)
    return df.filter(ok), df.filter(~ok).drop("image")


def read_vocab(spark: SparkSession, path: str, start: int = 0) -> DataFrame:
    """(class_idx, class_name): lines in file order, stripped, blanks skipped,
    numbered from ``start`` after skipping. Reads a file or a written folder."""
    lines = spark.read.text(path).select(
        F.regexp_replace("value", f"^[{UNICODE_BLANKS}]+|[{UNICODE_BLANKS}]+$", "").alias("class_name"),
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__line"))
    numbered = number_in_order(
        lines.filter("class_name <> ''"), ["__file", "__block", "__line"], "class_idx", start)
    return numbered.select("class_idx", "class_name")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(name, value) from a JSON object of strings with whole entries per line,
    indented or compact; the file can be split at any line."""
    body = F.regexp_replace("value", r"^\s*[{,]?\s*|\s*[},]?\s*$", "")
    entry = F.from_json(F.concat(F.lit("{"), body, F.lit("}")), "map<string,string>", {"mode": "FAILFAST"})
    return (
        spark.read.text(path).filter(body != "")
        .select(F.explode(entry).alias("name", "value"))
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed catalogue pages, one JSON document per file, explicit schema."""
    return spark.read.schema(CATALOGUE_PAGE).option("multiLine", True).json(path)
