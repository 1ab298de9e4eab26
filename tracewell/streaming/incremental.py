"""Scanning files as they arrive, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.sources import java, kettle


def arriving_texts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, text) of new files below folder, each once."""
    raw = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).format("text").load(folder)
    return raw.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def export_facts(files: DataFrame) -> DataFrame:
    """(edge_type, actor, name, object_type) of Kettle exports, batch or stream."""
    return kettle.step_facts(kettle.sql_steps(kettle.parse_exports(files)))


def method_rows(files: DataFrame) -> DataFrame:
    return java.methods(java.with_module(files))


def write_each(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Gives each batch to `sink` once per batch id, until what is there has been read."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
