"""Conversion of files as they arrive: a stateless stream, one result row for each part of each file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quern.operators.convert import convert


def watch(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as a stream of (path, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder).select("path", "content")


def convert_stream(files: DataFrame, source: str, target: str, to: str, checkpoint: str, once: bool = True, **options) -> StreamingQuery:
    """Writes results as Parquet; each file is converted exactly once, restarts included."""
    writer = convert(files, source, target, **options).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
