"""Change events: debounced bursts, and a watch loop that updates an index from a stream of changed paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def bursts(events: DataFrame, key: str, gap: str = "500 milliseconds", watermark: str | None = None, time: str = "ts") -> DataFrame:
    """One row for each burst of events of a key that a quiet gap ends: (key, burst_start, burst_end, events).

    Works on tables and, with a watermark, on streams, where late events beyond it are dropped.
    """
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    stamped = stamped.withWatermark(time, watermark) if watermark else stamped
    out = stamped.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return out.select(key, F.col("w.start").alias("burst_start"), F.col("w.end").alias("burst_end"), "events")


def watch(events: DataFrame, update: Callable[[DataFrame], object], checkpoint: str, path: str = "path", once: bool = False, interval: str = "500 milliseconds") -> StreamingQuery:
    """Runs update(paths) on each batch's distinct changed paths. once processes what there is and ends."""

    def each(batch: DataFrame, _: int) -> None:
        paths = batch.select(F.col(path).alias("path")).where("path IS NOT NULL").distinct()
        if not paths.isEmpty():
            update(paths)

    writer = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
