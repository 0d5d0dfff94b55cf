"""Structured Streaming: incremental ingest of crawled files with a checkpoint and a dead-letter sink, and a windowed citation counter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tandem.operators.reconcile import split_dead_letters


def crawl_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New NDJSON files of a folder, a bounded number per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def ingest(stream: DataFrame, good: str, dead: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends rows with status 200 to good and the others, with their class, to dead. A batch that is repeated after a failure rewrites its own folders, so
    each row arrives once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        ok, failed = split_dead_letters(batch)
        ok.write.mode("overwrite").parquet(f"{good}/batch={number}")
        failed.write.mode("overwrite").parquet(f"{dead}/batch={number}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and key; rows later than the watermark are dropped by Spark. An extension: the same call works on a batch."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_t", late) if events.isStreaming else rows
    return rows.groupBy(F.window("_t", window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
