"""Streams into tables: every micro-batch becomes one snapshot, and windowed aggregates take late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.tablelog import Table


def commit_stream(stream: DataFrame, table: Table, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends each batch as a commit, exactly once. The batch's number is part of the commit's document, under the name of the stream's
    checkpoint: a batch that is run again after a failure finds its number there, and one whose commit was lost finds none. Empty batches commit nothing."""

    def one(batch: DataFrame, number: int) -> None:
        table.catch_up()
        if table.batches.get(checkpoint, -1) < number and not batch.isEmpty():
            table.append(batch, (checkpoint, number))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(stream: DataFrame, time: str, late: str, size: str, slide: str | None = None, *keys: str, **aggregates) -> DataFrame:
    """Tumbling or sliding windows over event time with a watermark."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items()))
