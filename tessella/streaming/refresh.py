"""Continuous refresh: archives that arrive in a folder are indexed by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.index import IndexStore


def watch(spark: SparkSession, folder: str, store: IndexStore, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start a stream over the archives of ``folder``; each batch refreshes ``store``, which skips what it has by fingerprint.

    A batch that is run again after a failure finds what was finished current; what was not is indexed anew, in a generation of its own.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)

    def index(batch: DataFrame, _: int) -> None:
        if not batch.select("path").isEmpty():
            store.refresh(folder)

    writer = files.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
