"""Landed files as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def key_list(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, seq int")


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """pages(name, raw): one row a text file, named by the file without its ending."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("_file"), F.col("value").alias("raw"))
    return files.select(F.regexp_replace("_file", "\\.[^.]*$", "").alias("name"), "raw")


def existing(keys: DataFrame, pages: DataFrame) -> DataFrame:
    """The keys for which a page has landed; the others are passed over."""
    return keys.join(pages, "name", "left_semi")


def listing(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """Names of the files in a folder with an ending, without it; their contents are not read."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"))
    return files.filter(F.endswith("file", F.lit(ending))).select(F.expr(f"left(file, length(file) - {len(ending)})").alias("slug"))


def front_matter_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, title, description, body) of Markdown files that may start with a block of `key: value` lines between dashes."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    block = "(?s)\\A---\\n(.*?)\\n---\\n?"
    head = F.regexp_extract("text", block, 1)

    def field(name: str):
        return F.nullif(F.regexp_extract(head, f"(?m)^{name}:[ ]*(.*?)[ ]*$", 1), F.lit(""))

    return files.select("path", field("sidebar_position").try_cast("int").alias("position"), field("title").alias("title"), field("description").alias("description"), F.regexp_replace("text", block, "").alias("body"))


def first_item(raw: Column, item_schema: str) -> Column:
    """The first of `items` in a JSON reply; null if there is none."""
    return F.get(F.from_json(raw, f"items array<{item_schema}>")["items"], F.lit(0))
