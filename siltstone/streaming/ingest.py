"""Continuous ingest of a folder of Markdown files: all work on lines and chunks is within a document, so each micro-batch stands by itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, folder: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs the work on the documents (source_file, text) of each micro-batch and writes its rows under the batch's number, which a batch that runs again after a failure overwrites: each file's rows are there exactly once."""
    texts = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(folder)
    docs = texts.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
