"""Streams: idempotent ingest of new documents, and windowed counts of events.  Extensions beyond batch use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import chunker, store


def ingest(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stores each micro-batch's new documents (doc_id, text) and their chunks in one commit; texts that are stored already are skipped."""

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.withColumn("checksum", F.sha2("text", 256)).dropDuplicates(["checksum"])
        spark = batch.sparkSession
        try:
            fresh = store.unseen(fresh, store.committed(spark, path, "documents"))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh = fresh.persist()
        if not fresh.isEmpty():
            store.commit({"documents": fresh, "chunks": chunker.chunked(fresh.select("doc_id", "text"))}, path)
        fresh.unpersist()

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
