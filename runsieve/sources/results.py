"""Result documents: three accepted shapes, several files per run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsieve.functions.arrays import explode_once
from runsieve.schemas import CASE_RESULT


def read_result_documents(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """One row per document in the ``.json`` files below ``path``: file_path, content.

    One document per file, or one per line: many small documents then share a file, so that opening files
    does not take the time. A document holds one shard, so a whole one per row is bounded.
    """
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(path, wholetext=whole_files)
        .select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))
    )


def parse_result_documents(documents: DataFrame) -> DataFrame:
    """Result rows with file_path and position, from the accepted shapes.

    A list of results; an object with ``metrics`` (one result); an object with a
    ``results`` list. Other documents give no rows.
    """
    doc = F.try_parse_json("content")
    kind = F.schema_of_variant("_v")

    def part(path: str, kind_: str):
        return F.try_variant_get(F.col("_v"), path, kind_)

    items = (
        F.when(kind.startswith("ARRAY"), part("$", "array<variant>"))
        .when(kind.startswith("OBJECT") & part("$.metrics", "variant").isNotNull(), F.array("_v"))
        .when(kind.startswith("OBJECT") & part("$.results", "variant").isNotNull(), part("$.results", "array<variant>"))
    )
    rows = explode_once(documents.withColumn("_v", doc).select("file_path", items.alias("_items")), "_items", "_item", "pos")
    return rows.select(
        "file_path", "pos", F.from_json(F.to_json("_item"), CASE_RESULT).alias("_r")
    ).select("file_path", "pos", "_r.*")


def unreadable_documents(documents: DataFrame) -> DataFrame:
    """Documents that are not JSON at all, for a quarantine table."""
    return documents.filter(F.try_parse_json("content").isNull())
