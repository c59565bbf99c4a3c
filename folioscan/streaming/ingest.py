"""Streaming ingest (beyond the batch engine): new patch files become page vectors, one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioscan import schema
from folioscan.ingest import page_vectors


def watch_patches(spark: SparkSession, incoming: str, out: str, checkpoint: str) -> StreamingQuery:
    """Pools the pages of each new Parquet file under incoming and appends them to out. A page's patches are to come in one file.

    Each micro-batch replaces its own folder, so that one which runs again after a failure isn't written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        page_vectors(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema.PATCHES).parquet(incoming)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
