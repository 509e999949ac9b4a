"""Continuous ingest: new tagged files become commits of the store, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from warraq.sources.store import Store
from warraq.sources.tagged import clean


def watch(spark: SparkSession, folder: str, store: Store, tables: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, **trigger) -> StreamingQuery:
    """Follows ``folder`` for whole text files. ``tables`` turns a batch of (key, raw) rows into the rows
    to commit. The store remembers the last batch of each stream, by the id that the checkpoint keeps, so a batch that
    is run again after a failure makes no second state."""
    files = spark.readStream.format("text").option("wholetext", True).load(folder).select(F.input_file_name().alias("key"), clean(F.col("value")).alias("raw"))

    def commit(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.commit(tables(batch), (batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), number))

    return files.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
