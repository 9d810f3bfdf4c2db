"""Golden case sets: JSON documents to validated case rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runsieve.functions.arrays import explode_once
from runsieve.functions.text import strip
from runsieve.schemas import GOLDEN


def read_golden(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Datasets from JSON files, plain or packed by gzip: one document per file, or one per line."""
    reader = spark.read.schema(GOLDEN).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,json.gz}")
    return reader.option("multiLine", whole_files).json(path).withColumn("source_path", F.col("_metadata.file_path"))


def write_golden(datasets: DataFrame, path: str) -> None:
    """Datasets as JSON files, one per line. A case repeats its texts as answer, context and trace, so the files
    are packed."""
    datasets.write.option("compression", "gzip").json(path)


def parse_golden(df: DataFrame, text: str) -> DataFrame:
    """Datasets from a column of JSON text."""
    return df.withColumn("_g", F.from_json(text, GOLDEN)).select("*", "_g.*").drop("_g")


def case_rows(datasets: DataFrame, dataset_id: Column) -> DataFrame:
    """One row per case with its position and defaults for absent fields.

    A set is one document, read by one task; its cases are dealt over all tasks by (set, position).
    """
    texts, calls = F.array().cast("array<string>"), "array<struct<name:string,arguments:string,result:string>>"
    rows = datasets.select(
        dataset_id.alias("dataset_id"),
        F.coalesce("version", F.lit("1.0")).alias("version"),
        F.coalesce("name", F.lit("golden")).alias("dataset_name"),
        "cases",
    )
    rows = explode_once(rows, "cases", "_c", "pos").drop("cases").repartition("dataset_id", "pos")
    c = F.col("_c")
    return rows.select(
        "dataset_id",
        "version",
        "dataset_name",
        "pos",
        strip(c["id"]).alias("case_id"),
        F.coalesce(c["suite"], F.lit("hybrid")).alias("suite"),
        c["query"].alias("query"),
        c["expected_answer"].alias("expected_answer"),
        F.coalesce(c["expected_contexts"], texts).alias("expected_contexts"),
        F.coalesce(c["expected_tools"], texts).alias("expected_tools"),
        F.coalesce(c["expected_tool_calls"], F.array().cast(calls)).alias("expected_tool_calls"),
        F.when(c["recorded_trace"].isNotNull(), c["recorded_trace"].withField("tool_calls", F.coalesce(c["recorded_trace"]["tool_calls"], F.array().cast(calls)))).alias("recorded_trace"),
        F.coalesce(c["metadata"], F.lit("{}")).alias("metadata"),
    )
