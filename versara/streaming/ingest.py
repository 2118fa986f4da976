"""Incremental indexing: source files that land in a folder enter the index batch by batch (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from versara.operators import index


def landing(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """Documents (edition, doc, text) that land as JSON lines."""
    return spark.readStream.schema("edition string, doc long, text string").option("maxFilesPerTrigger", files_per_batch).json(path)


def index_stream(docs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends postings and document statistics of every batch under its number, so that a batch which runs
    again replaces itself; term statistics come from the postings when they are read."""

    def one(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["edition", "doc"])
        index.postings(fresh).write.mode("overwrite").parquet(f"{target}/postings/batch={number}")
        index.doc_stats(fresh).write.mode("overwrite").parquet(f"{target}/docs/batch={number}")

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_stream_index(spark: SparkSession, target: str) -> index.Index:
    entries = spark.read.parquet(f"{target}/postings").drop("batch")
    return index.Index(entries, index.term_stats(entries), spark.read.parquet(f"{target}/docs").drop("batch"))


def activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type, late ones up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
