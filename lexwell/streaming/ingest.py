"""Continuous ingestion: a stream of entries is added to an index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexwell.api import SearchIndex


def ingest(index: SearchIndex, entries: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that adds each micro-batch of ``entries`` as one segment. A repeated batch replaces itself.

    After each batch small segments are merged, so their number grows with the logarithm of the documents.
    """

    def add(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            index.add_range(batch)
            index.compact()

    return entries.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
