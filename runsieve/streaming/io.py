"""Stream sources and the idempotent batch log every stream writes to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from runsieve.session import fresh_dir
from runsieve.sources.sinks import append_batch, read_log


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", max_files: int = 1000) -> DataFrame:
    """Files below a path or glob as a stream; timestamps without a zone become UTC instants.

    ``max_files`` bounds a micro-batch; no result depends on it.
    """
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)
    for field in schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            stream = stream.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return stream


def table_glob(folder: str, name: str) -> str:
    """A glob that names one table, kept as a single file or as a directory of part files.

    The stream reader refuses the plain path of a file, and a folder with a file-name filter misses the
    part files of a directory.
    """
    return f"{folder}/{name}.parque[t]"


def drain(stream: DataFrame, label: str, partial: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what has arrived and return its batch log.

    ``partial`` reduces a micro-batch before it is written. Every micro-batch is written under its own id,
    so a batch that is replayed after a failure replaces itself. The log and the checkpoint live in the
    shared folder.
    """
    spark = stream.sparkSession
    root = fresh_dir(spark, label)
    reduced = partial or (lambda batch: batch)
    _start(stream, root, reduced).awaitTermination()
    return read_log(spark, f"{root}/log", reduced(stream).schema)


def _start(stream: DataFrame, root: str, reduced: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    return (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, batch_id: append_batch(reduced(batch), batch_id, f"{root}/log"))
        .start()
    )
